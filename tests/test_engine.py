"""Operators of the engine on inline tables with known results."""

import http.server
import json
import random
import threading
import time
from datetime import datetime

import pytest
import yaml
from pyspark.sql import functions as F

from quern.functions import scalar, tables
from quern.functions.similarity import jaro_winkler_batch, jaro_winkler_text
from quern.operators import datamart, dml, match, mdm, profile, scd2
from quern.plans import airflow, engine, pipeline, templates, triggers
from quern.plans.statements import bind_positional, parse_statement
from quern.plans.store import Conflict, Store
from quern.sources import avro, connectors, files, pages, remote
from quern.streaming import events


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.trim_blank(F.lit("\t x ")).alias("a"), scalar.substr(F.lit("hello"), 0, 2).alias("b"), scalar.substr(F.lit("hello"), 9).alias("c"), scalar.substr(F.lit("hello"), 2, -1).alias("d"),
        scalar.split_part(F.lit("a,;b;c"), ",;", 2).alias("e"), scalar.split_part(F.lit("a"), ",", 2).alias("f"), scalar.to_int(F.lit("-2.5")).alias("g"), scalar.to_int(F.lit("x")).alias("h"),
        scalar.to_bool(F.lit("1")).alias("i"), scalar.safe_divide(F.lit(1.0), F.lit(0.0)).alias("j"), scalar.normalize_name(F.lit("  Ivan \n Ivanov ")).alias("k"), scalar.normalize_inn(F.lit("12-34 56")).alias("l"),
    ).first()
    assert tuple(row) == ("x", "he", "", "ello", "b", None, -3, None, True, None, "ivan ivanov", "123456")


@pytest.mark.parametrize(("q", "d", "want"), [("abc", "abc", 1.0), ("abc", "xyz", 0.0), ("Ivanov", "Ivano", 0.75), ("ab", "AB", 1.0), ("a", "abc", 0.0), ("", "", 1.0), (None, "a", None)])
def test_word_similarity(spark, q, d, want):
    scalar.register_functions(spark)
    df = spark.createDataFrame([(q, d)], "q string, d string")
    assert df.select(scalar.word_similarity(F.col("q"), F.col("d"))).first()[0] == want
    assert df.selectExpr("word_similarity(q, d)").first()[0] == want


def test_jaro_winkler(spark):
    assert abs(jaro_winkler_text("martha", "marhta") - 0.9611) < 1e-4 and abs(jaro_winkler_text("alice", "alicia") - 0.893) < 1e-3
    assert jaro_winkler_text("abc", "xyz") == 0 and jaro_winkler_text("", "") == 1 and jaro_winkler_text("", "a") == 0
    assert abs(jaro_winkler_text("red widget", "hot gear") - (0.3 + 0.375 + 0.5) / 3) < 1e-9
    scalar.register_functions(spark)
    assert spark.sql("SELECT round(jaro_winkler('Анна', 'Алла'), 2)").first()[0] == 0.7
    assert spark.sql("SELECT jaro_winkler(NULL, 'a')").first()[0] is None


def plain_jaro_winkler(a, b):
    """By the definition, one character after the other."""
    reach, free, left = max(max(len(a), len(b)) // 2 - 1, 0), list(range(len(b))), []
    for i, c in enumerate(a):
        j = next((j for j in free if b[j] == c and abs(i - j) <= reach), None)
        if j is not None:
            free.remove(j)
            left.append(c)
    right = [c for j, c in enumerate(b) if j not in free]
    m = len(left)
    jaro = 1.0 if not a and not b else (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right)) / 2) / m) / 3 if m else 0.0
    p = 0
    while p < min(len(a), len(b), 4) and a[p] == b[p]:
        p += 1
    return jaro + p * 0.1 * (1 - jaro)


def test_jaro_winkler_batches_match_plain():
    r = random.Random(2)
    text = lambda: "".join(r.choices("abcdéЖ🙂", k=r.randrange(0, 14)))
    pairs = [(text(), text()) for _ in range(3000)] + [("x" * 3000, "x" * 2000 + "y")]
    got = jaro_winkler_batch([a for a, _ in pairs], [b for _, b in pairs])
    assert max(abs(g - plain_jaro_winkler(a, b)) for g, (a, b) in zip(got, pairs)) < 1e-12


@pytest.mark.parametrize("block", [5000, 7])
def test_match_compares_each_pair_of_a_block_once(spark, monkeypatch, block):
    monkeypatch.setattr(match, "BLOCK", block)
    r = random.Random(3)
    rows = [(k, r.choice(["a", "b", "", None]), "".join(r.choices("ab", k=r.randrange(0, 6)))) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, k string, t string")
    got = match.match(df, [match.MatchRule("w", "id", ("k",), ("t",), threshold=0.5), match.MatchRule("l", "id", ("k",), ("t",), "levenshtein", "<=", 1.0), match.MatchRule("j", "id", ("k",), ("t",), "jaro_winkler", ">=", 0.9)]).collect()

    def word(q, d):
        if len(q) < 3:
            return float(q == d) if len(d) < 3 else 0.0
        grams = [q[i : i + 3] for i in range(len(q) - 2)]
        return sum(g in d for g in grams) / len(grams)

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, old = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (c != e)))
        return row[-1]

    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0] and a[1] and a[1] == b[1]]
    want = [(a[0], b[0], "w") for a, b in pairs if word(a[2], b[2]) >= 0.5] + [(a[0], b[0], "l") for a, b in pairs if edits(a[2], b[2]) <= 1] + [(a[0], b[0], "j") for a, b in pairs if plain_jaro_winkler(a[2], b[2]) >= 0.9]
    assert sorted((x.id_a, x.id_b, x.rule_name) for x in got) == sorted(want)


SPEC = scd2.Scd2(key=("id",), deleted="gone", version="v")


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp_ntz")


def rows(spark, *r):
    return spark.createDataFrame(list(r), "id string, city string, gone int")


def test_texts_of_a_block_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(match, "CHUNK", 7)
    monkeypatch.setattr(match, "BLOCK", 40)
    r = random.Random(5)
    rows = [(k, r.choice(["x", "y", None]), r.choice(["ab", "abc", "abd", "zbcd", "", None])) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, t string")
    compared = spark.sparkContext.accumulator(0)

    def measure(a, b):
        compared.add(len(a))
        return a.fillna("").str.len() + b.fillna("").str.len()

    spy = F.pandas_udf(measure, "double")
    got = sorted(map(tuple, match.pairs(df, "id", ["k"], "t", match.Metric(lambda a, b: spy(a("t"), b("t")))).collect()))
    want = sorted((a[0], b[0], float(len(a[2] or "") + len(b[2] or ""))) for a in rows for b in rows if a[1] and a[1] == b[1] and a[0] < b[0])
    assert got == want and compared.value < len(want) / 10
    alone = match.pairs(df, "id", ["k"]).select("a_id", "b_id").collect()
    assert sorted(map(tuple, alone)) == [w[:2] for w in want]


def test_filters_before_metrics_lose_nothing(spark):
    """One edit by shared variants, trigrams by bits; doubles of a text are compared for all their ids."""
    r = random.Random(6)
    rows = [(k, "b", "".join(r.choices("é12", k=r.randrange(0, 7)))) for k in range(150)]
    df = spark.createDataFrame(rows, "id int, k string, t string")
    rules = [match.MatchRule(f"l{op}{n}", "id", ("k",), ("t",), "levenshtein", op, n, "none") for op, n in (("<", 2), ("<=", 1), ("<=", 0), ("<", 0.5), ("<=", 2))]
    rules += [match.MatchRule(f"w{op}{n}", "id", ("k",), ("t",), "word_similarity", op, n, "none") for op, n in ((">=", 0.75), (">", 0.5), ("<", 0.5))]
    df.createOrReplaceTempView("texts")
    scalar.register_functions(spark)
    all_pairs = spark.sql("SELECT a.id, b.id AS other, CAST(levenshtein(a.t, b.t) AS DOUBLE) AS l, word_similarity(a.t, b.t) AS w FROM texts a JOIN texts b ON a.id < b.id").collect()
    holds = {">=": float.__ge__, ">": float.__gt__, "<": float.__lt__, "<=": float.__le__}
    want = [(p.id, p.other, u.name, p[u.name[0]]) for u in rules for p in all_pairs if holds[u.operator](p[u.name[0]], float(u.threshold))]
    assert sorted(map(tuple, match.match(df, rules).collect())) == sorted(want)


def test_exact_median(spark):
    r = random.Random(7)
    for values in ([], [None], [3.0], [1.0, 2.0], [2.0, 2.0, 9.0, None], [r.choice([1.0, 2.0, 5.0]) for _ in range(50)], [float(i * 7919 % 150_001) for i in range(150_001)], [float(i * 7919 % 120_000) for i in range(120_000)], [4.0] * 110_000):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        assert profile.exact_median(df, "x").collect() == df.agg(F.percentile("x", 0.5)).collect()


def test_trigrams_stay_in_the_engine(spark):
    tables.register_tables(spark)
    df = spark.createDataFrame([(1, "añbc"), (2, "ab"), (3, None), (4, ""), (5, "xyz")], "id int, t string")
    df.createOrReplaceTempView("named")
    got = spark.sql("SELECT id, pos, gram FROM named, LATERAL trigrams(t)")
    assert sorted(map(tuple, got.collect())) == [(1, 1, "añb"), (1, 2, "ñbc"), (5, 1, "xyz")]
    assert "Python" not in got._jdf.queryExecution().toString() and got.dtypes[1:] == [("pos", "int"), ("gram", "string")]


def test_scd2_chain_reads_each_side_once(spark):
    h = scd2.apply_scd2(rows(spark, ("1", "A", 0)), None, SPEC, at(1))
    for day, city in ((2, "B"), (3, "B"), (4, "C")):
        h = scd2.apply_scd2(rows(spark, ("1", city, 0), ("2", None, 0)), h, SPEC, at(day))
    plan = h._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 4
    assert sorted((r.id, r.city, r.v, r.is_current) for r in h.collect()) == [("1", "A", 1, False), ("1", "B", 2, False), ("1", "C", 3, True), ("2", None, 1, True)]


def test_scd2_runs(spark):
    count = lambda h: (h.count(), h.filter("is_current").count(), h.filter("valid_to is not null").count())
    h = scd2.apply_scd2(rows(spark, ("1", "A", 0), ("2", "B", 0), ("3", None, 0)), None, SPEC, at(1))
    assert count(h) == (3, 3, 0)
    h = scd2.apply_scd2(rows(spark, ("1", "X", 0), ("2", "B", 0), ("3", None, 0)), h, SPEC, at(2)).cache()
    assert count(h) == (4, 3, 1) and h.filter("id = '1' and is_current").first().v == 2
    again = scd2.apply_scd2(rows(spark, ("1", "X", 0), ("2", "B", 0), ("3", None, 0)), h, SPEC, at(3))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, h.collect()), key=repr)
    h = scd2.apply_scd2(rows(spark, ("3", None, 1)), h, SPEC, at(4))
    assert count(h) == (4, 2, 2)
    # The latest version counts even if it is closed: an unchanged key that comes back is not opened again.
    assert count(scd2.apply_scd2(rows(spark, ("3", None, 0)), h, SPEC, at(5))) == (4, 2, 2)
    for bad in (rows(spark, (None, "A", 0)), rows(spark, ("", "A", 0)), rows(spark, ("1", "A", 0), ("1", "B", 0))):
        with pytest.raises(ValueError):
            scd2.apply_scd2(bad, h, SPEC, at(6))


def test_match_and_golden_records(spark):
    p = spark.createDataFrame([(1, "Ivanov Ivan", "1990", "77"), (2, "IVANOV  ivan", "1990", "77"), (3, "Petrov", "1990", None), (4, "Ivanov Ivan", "1991", "")], "id int, name string, birth string, doc string")
    got = match.match(p, [match.MatchRule("doc", "id", ("doc",), ("name",)), match.MatchRule("jw", "id", ("birth",), ("name",), "jaro_winkler", ">=", 0.95)]).collect()
    assert {(r.id_a, r.id_b, r.rule_name) for r in got} == {(1, 2, "doc"), (1, 2, "jw")}
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "id_a int, id_b int")
    assert {r.id: r.canonical_id for r in mdm.accept_matches(pairs).collect()} == {1: 1, 2: 1, 3: 2, 4: 4, 5: 4}
    docs = spark.createDataFrame([(1, "4500 123456", 1, "P"), (1, "x-1", 2, "P"), (1, "4500-123456", 3, "P"), (1, "no", 4, "Z")], "o int, n string, k int, c string")
    assert mdm.aggregate_documents(mdm.clean_document(docs, "n", "c", ["P"]), "o", "n", "k").first().numbers == "4500123456~X1"


def test_changes_and_transactions(spark, tmp_path):
    t = dml.Table(spark, str(tmp_path / "t"))
    assert not t.exists()
    t.write(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, s string"))
    tx = dml.Transaction(t).update({"s": "z"}, "s = 'a'").delete("s = 'c'")
    assert t.read().count() == 3
    tx.rollback()
    tx.commit()
    assert t.read().count() == 3
    dml.Transaction(t).update({"s": "z"}, "s = 'a'").delete("s = 'c'").insert(spark.createDataFrame([(9, "n")], "id int, s string")).commit()
    assert sorted(map(tuple, t.read().collect())) == [(1, "z"), (2, None), (9, "n")]
    t.append(spark.createDataFrame([(10, "m")], "id int, s string"))
    src = spark.createDataFrame([(1, "q"), (11, "w")], "id int, s string")
    once = dml.upsert(t.read(), src, ["id"])
    assert sorted(map(tuple, dml.upsert(once, src, ["id"]).collect())) == sorted(map(tuple, once.collect()))
    t.read().createOrReplaceTempView("t_mart")
    mart = datamart.Datamart("m", "SELECT count(*) AS n FROM t_mart", str(tmp_path / "m"), "on_write", sources=("t",))
    assert mart.refresh(spark).first().n == 4 and not mart.due() and mart.invalidate("t") and mart.due()


def test_transactions_over_tables_and_conflicts(spark, tmp_path):
    one = lambda *r: spark.createDataFrame(list(r), "id int, s string")
    db = dml.Database(spark, str(tmp_path / "db"))
    db.commit({"a": one((1, "a")), "b": one((1, "b"))})
    tx = dml.Transaction(db).update({"s": "x"}, table="a").delete("id = 1", table="b").upsert(one((1, "y"), (2, "z")), ["id"], table="a")
    assert [r.s for r in tx.preview("a").orderBy("id").collect()] == ["y", "z"] and db.read("b").count() == 1
    other = dml.Transaction(db).update({"s": "lost"}, table="b")
    tx.commit()
    assert [tuple(r) for r in db.read("a").orderBy("id").collect()] == [(1, "y"), (2, "z")] and db.read("b").count() == 0
    with pytest.raises(Conflict):
        other.commit()
    assert db.read("b").count() == 0
    # Appends by two writers and changes of other tables don't conflict.
    late = dml.Transaction(db).delete("id = 2", table="a")
    db.write("b", one((5, "p")), "append")
    db.write("b", one((6, "q")), "append")
    late.commit()
    assert db.read("a").count() == 1 and sorted(r.id for r in db.read("b").collect()) == [5, 6]
    n = len(list((tmp_path / "db" / "a").glob("s-*")))
    assert n > 1 and db.vacuum() >= n - 1 and db.read("a").count() == 1 and db.read("b").count() == 2
    with pytest.raises(KeyError):
        dml.Transaction(db).delete(table="none")
    db.drop("b")
    assert db.tables() == ["a"]


def test_store_keeps_whole_versions(spark, tmp_path):
    st = Store(spark, str(tmp_path / "st"))
    assert st.read("d", 5) == (0, 5) and [st.write("d", k, keep=3) for k in range(6)] == [1, 2, 3, 4, 5, 6]
    assert st.read("d") == (6, 5) and len(list((tmp_path / "st" / "d").glob("0*.json"))) == 3
    with pytest.raises(Conflict):
        st.write("d", 0, base=5)
    stale = Store(spark, str(tmp_path / "st"))
    stale._versions = lambda name: [5]
    with pytest.raises(Conflict):
        stale.write("d", "lost", base=5)
    assert st.read("d") == (6, 5) and st.names() == ["d"] and st.delete("d") and st.names() == []


def test_statements(spark, tmp_path):
    text, values = bind_positional("SELECT $2, '$1', \"a$1\", -- $1\n /* $9 */ $1", ["x", 7])
    assert text == "SELECT ?, '$1', \"a$1\", -- $1\n /* $9 */ ?" and values == [7, "x"]
    with pytest.raises(ValueError):
        bind_positional("SELECT $2", [1])
    assert parse_statement("UPDATE `t` SET a = coalesce(b, 'x, WHERE'), b = 1 WHERE c IN (SELECT 1 WHERE TRUE);").values == {"a": "coalesce(b, 'x, WHERE')", "b": "1"}
    assert parse_statement("delete t where a = ';'").where == "a = ';'"
    assert parse_statement("INSERT INTO t (a, b) SELECT 1, 2").columns == ("a", "b")
    for bad in ("", "SELECT 1; SELECT 2", "UPDATE t a = 1", "DELETE FROM t x", "UPDATE t SET a"):
        with pytest.raises(ValueError):
            parse_statement(bad)
    db = dml.Database(spark, str(tmp_path / "db"))
    db.write("st_t", spark.createDataFrame([(1, "a", "u"), (2, "b", "v")], "id int, s string, owner string"))
    policy = engine.Policy({"st_t": "owner = {user_id}"}, (("user", "st_*", frozenset({"select", "update"})),))
    e, who = engine.Engine(spark, policy, db), engine.Principal("u", "user")
    told = []
    e.written.append(told.append)
    e.execute("UPDATE st_t SET s = upper(s) || '!'", principal=who)
    assert sorted(tuple(r) for r in e.sql("SELECT id, s FROM st_t").collect()) == [(1, "A!"), (2, "b")] and told == ["st_t"]
    with pytest.raises(PermissionError):
        e.execute("DELETE FROM st_t", principal=who)
    e.execute("BEGIN")
    e.execute("INSERT INTO st_t VALUES (3, 'c', 'w')")
    e.execute("INSERT INTO st_t (id) SELECT id + 10 FROM st_t")
    assert e.sql("SELECT * FROM st_t").count() == 2
    e.execute("ROLLBACK")
    e.execute("DELETE FROM st_t WHERE nullif(id, 1) > 0")
    assert [r.id for r in e.execute("SELECT id FROM st_t").collect()] == [1]
    for bad in ("COMMIT", "INSERT INTO st_t (id, s) VALUES (1)", "INSERT INTO st_t (nope) VALUES (1)", "UPDATE st_t SET nope = 1"):
        with pytest.raises(ValueError):
            e.execute(bad)
    assert e.sql("SELECT id FROM st_t WHERE '$2' <> s AND id = $1", [1]).count() == 1
    assert e.arrow("SELECT id FROM st_t").to_pydict() == {"id": [1]}
    with pytest.raises(ValueError):
        e.arrow("SELECT id FROM st_t", limit=0)


def test_ingest_results_and_catalog(spark, tmp_path):
    e = engine.Engine(spark, database=dml.Database(spark, str(tmp_path / "db")))
    (tmp_path / "a.csv").write_bytes("id;имя\n1;привет мир\n2;\n".encode("cp1251"))
    assert e.ingest_csv("in_t", str(tmp_path / "a.csv")) == 2 and e.sql("SELECT * FROM in_t").columns == ["id", "имя"]
    assert files.read_csv(spark, str(tmp_path / "a.csv"), encoding="cp1251").count() == 2
    (tmp_path / "b.csv").write_text('id\n""\n')
    assert e.ingest_csv("in_t", str(tmp_path / "b.csv")) == 1
    assert sorted((tuple(r) for r in e.sql("SELECT * FROM in_t").collect()), key=repr) == [("", None), ("1", "привет мир"), ("2", None)]
    (tmp_path / "c.csv").write_text("id,nope\n1,2\n")
    (tmp_path / "d.csv").write_text('id\n1\nx"y\n')
    for bad in "cd":
        with pytest.raises(Exception):
            e.ingest_csv("in_t", str(tmp_path / f"{bad}.csv"))
    assert e.sql("SELECT * FROM in_t").count() == 3
    spark.range(4).write.parquet(str(tmp_path / "p"))
    assert e.ingest_parquet("in_t", str(tmp_path / "p")) == 4
    e.information_schema()
    assert [tuple(r) for r in e.sql("SELECT column_name, ordinal_position, data_type FROM information_schema_columns WHERE table_name = 'in_t'").collect()] == [("id", 1, "bigint")]
    k = e.save_result("r", "SELECT count(*) AS n FROM in_t")
    e.ingest_parquet("in_t", str(tmp_path / "p"))
    assert e.result(k).first().n == 4 and e.results()[0]["sql"].startswith("SELECT") and e.results()[0]["n_rows"] == 1
    e.delete_result(k)
    with pytest.raises(KeyError):
        e.result(k)


def test_templates_and_pipelines(spark):
    assert templates.render("{a} {a_raw} {{x}} {@now} {b} IN ({@step:s:c}) {@prev}", {"a": "it's", "b": 1.5}, {"now": "2024-01-01", "prev": "p"}, lambda i, c: [f"{i}.{c}", 2, None]) == "'it\\'s' it's {x} '2024-01-01' 1.5 IN ('s.c', 2, NULL) p"
    assert templates.render("{@step:s:c}", {}, {}, lambda i, c: []) == "NULL"
    for bad in ("1; DROP", "a--b", "../x"):
        with pytest.raises(ValueError):
            templates.render("{a_raw}", {"a": bad})
    for bad in ("{q}", "{@prev}"):
        with pytest.raises(KeyError):
            templates.render(bad, {}, {"prev": None})
    assert templates.fill_vars("{{ a }} {{b}}", {"a": 1}) == "1 {{b}}"
    p = pipeline.Pipeline.from_yaml("name: p\nvars: {n: 3}\nsteps:\n- {id: b, sql: 'SELECT n * 2 AS m FROM {@prev}', deps: [a]}\n- {id: a, sql: 'SELECT {{ n }} AS n'}\n", {"n": 5})
    assert p.run(spark).first().m == 10 and p.log == [("a", "ok"), ("b", "ok")] and p.preview(spark, "a").first().n == 5
    with pytest.raises(Exception):
        pipeline.Pipeline("c", [pipeline.Step("a", "SELECT 1", deps=("b",)), pipeline.Step("b", "SELECT 1", deps=("a",))]).order()
    for bad in ({"id": "a", "sqll": ""}, {"id": "a", "fn": "none"}):
        with pytest.raises(ValueError):
            pipeline.Step.from_dict(bad)


def test_retries_stop_where_they_cannot_help(spark):
    tries = []

    def flaky(error, good):
        def run():
            tries.append(1)
            if len(tries) < good:
                raise error
            return spark.range(1)

        return run

    waits = []
    pipeline.Pipeline("r", [pipeline.Step("x", fn=flaky(OSError("reset"), 3), retries=2)]).run(spark, wait=waits.append)
    assert waits == [1.0, 2.0]
    for error in (ValueError("x"), RuntimeError("password is wrong"), FileNotFoundError("f")):
        tries.clear()
        with pytest.raises(type(error)):
            pipeline.Pipeline("r", [pipeline.Step("x", fn=flaky(error, 3), retries=5)]).run(spark, wait=waits.append)
        assert len(tries) == 1
    tries.clear()
    waits.clear()
    with pytest.raises(OSError):
        pipeline.Pipeline("r", [pipeline.Step("x", fn=flaky(OSError("reset"), 99), retries=50)]).run(spark, wait=waits.append)
    assert sum(waits) == pipeline.MAX_WAIT


def test_pipelines_remember_runs_and_cursors(spark, tmp_path):
    db, state = dml.Database(spark, str(tmp_path / "db")), Store(spark, str(tmp_path / "st"))
    seen = []

    def run(rows, fail=False, now=1_700_000_000.0):
        steps = [
            pipeline.Step("read", source=lambda s: s.createDataFrame(rows, "id int, at timestamp_ntz"), cursor="at", target="rows", mode="append"),
            pipeline.Step("last", sql="SELECT {@last_run} AS t, {@now} AS n", deps=("read",)),
            pipeline.Step("end", fn=lambda df: (_ for _ in ()).throw(RuntimeError("boom")) if fail else seen.append(tuple(df.first())) or df, deps=("last",)),
        ]
        pipeline.Pipeline("p", steps, database=db, state=state).run(spark, now=now)

    at_ = lambda d: datetime(2024, 1, d, 1, 2, 3, 456789)
    run([(1, at_(1)), (2, at_(2))])
    run([(1, at_(1)), (2, at_(2)), (3, at_(3))], now=1_700_000_100.0)
    with pytest.raises(RuntimeError):
        run([(3, at_(3)), (4, at_(4))], fail=True, now=1_700_000_200.0)
    run([(4, at_(4))], now=1_700_000_300.0)
    assert sorted(r.id for r in db.read("rows").collect()) == [1, 2, 3, 4]
    assert [t for t, _ in seen] == ["1970-01-01 00:00:00", "2023-11-14 22:13:20", "2023-11-14 22:15:00"]
    assert [r["status"] for r in state.read("pipeline-p")[1]["runs"]] == ["ok", "ok", "failed", "ok"]


def test_history_and_match_steps(spark, tmp_path):
    db = dml.Database(spark, str(tmp_path / "db"))
    text = "name: h\nsteps:\n- {id: h, sql: 'SELECT 1 AS id, {city} AS city', scd2: {key: [id], version: v}, target: hist}\n- {id: m, sql: 'SELECT * FROM VALUES (1, 2, 3), (2, 2, 3) AS t(id, k, t)', match: [{name: r, id_column: id, scan_columns: [k], test_columns: [t], metric: equal, threshold: 1.0}], target: pairs}\n"
    for k, city in enumerate(("A", "B", "B")):
        pipeline.Pipeline.from_dict(yaml.safe_load(text) | {"vars": {"city": city}}, database=db).run(spark, now=1000.0 * k)
    assert sorted((r.city, r.v, r.is_current) for r in db.read("hist").collect()) == [("A", 1, False), ("B", 2, True)]
    assert [(r.id_a, r.id_b) for r in db.read("pairs").collect()] == [(1, 2)]


def test_triggers(spark, tmp_path):
    t = time.struct_time((2024, 1, 7, 10, 30, 0, 6, 7, 0))
    assert [triggers.cron_matches(c, t) for c in ("*/15 * * * *", "30 10 * * 0", "30 10 * * 7", "0-29 * * * *", "@hourly", "30 9-11 1,7 * *", "30 10 1 * 0", "30 10 1 * 1")] == [True, True, True, False, False, True, True, False]
    for bad in ("* * * *", "61 * * * *", "*/0 * * * *", "5-1 * * * *"):
        with pytest.raises(ValueError):
            triggers.cron_matches(bad, t)
    ran, state = [], Store(spark, str(tmp_path / "st"))

    def make():
        r = triggers.Runner(spark, state)
        p = lambda name: pipeline.Pipeline(name, [pipeline.Step("x", fn=lambda: ran.append(name) or spark.range(1))])
        r.add(p("cron"), triggers.Trigger("cron", "cron", "*/2 * * * *"))
        r.add(p("file"), triggers.Trigger("file", "file", str(tmp_path / "in" / "*.csv")))
        r.add(p("table"), triggers.Trigger("table", "table", "orders"))
        r.add(p("each"), triggers.Trigger("each", "interval", "100"), triggers.Trigger("each", "webhook", "secret"))
        return r

    (tmp_path / "in").mkdir()
    r = make()
    assert r.tick(120.0) == ["cron", "each"] and r.tick(130.0) == []
    (tmp_path / "in" / "a.csv").write_text("x")
    assert make().tick(190.0) == ["file"] and make().tick(200.0) == []
    assert make().tick(245.0) == ["cron", "each"]
    r.table_written("orders")
    assert r.webhook("each", "secret") and ran[-2:] == ["table", "each"]
    with pytest.raises(PermissionError):
        r.webhook("each", "guess")
    told = []
    r.metrics.listeners.append(told.append)
    r.add(pipeline.Pipeline("bad", [pipeline.Step("x", sql="SELECT nope")]))
    assert not r.run("bad") and told[0]["status"] == "failed" and r.metrics.summary()["bad"]["failed"] == 1
    spark.range(3).createOrReplaceTempView("mart_src")
    r.marts["m"] = datamart.Datamart("m", "SELECT count(*) AS n FROM mart_src", str(tmp_path / "m"), "on_write", sources=("orders",), stale=False)
    r.table_written("orders")
    assert not r.marts["m"].stale


def test_airflow_files():
    text = """
from airflow import DAG
with DAG("daily", schedule="@daily") as dag:
    a = PostgresOperator(task_id="load", sql="SELECT 1", retries=2)
    b = [BashOperator(task_id=f, bash_command="x") for f in names]
    c = PythonOperator(task_id="calc", python_callable=run)
    d = EmptyOperator(task_id="end")
    e = PostgresOperator(task_id="more", sql="SELECT 2")
    a >> [c, e] >> d
    d.set_upstream(a)
"""
    got = airflow.import_dag(text)
    assert got["name"] == "daily" and got["cron"] == "0 0 * * *"
    assert [(s["id"], s["deps"], s.get("sql"), s.get("retries")) for s in got["steps"]] == [("load", [], "SELECT 1", 2), ("calc", ["load"], None, None), ("end", ["calc", "more", "load"], None, None), ("more", ["load"], "SELECT 2", None)]
    assert got["notes"] == {"calc": "PythonOperator: python_callable=run"}
    assert [s.id for s in pipeline.Pipeline.from_dict({k: got[k] for k in ("name", "steps")}).order()] == ["load", "calc", "more", "end"]
    with pytest.raises(ValueError):
        airflow.import_dag("x = 1")


def test_security_covers_every_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b'")], "id int, owner string").write.parquet(str(tmp_path / "t"))
    e = engine.Engine(spark, engine.Policy({"sec_t": "owner = {user_id}"}, (("user", "sec_*", frozenset({"select"})),)))
    e.register("sec_t", str(tmp_path / "t"))
    who = engine.Principal("b'", "user")
    assert e.sql("SELECT * FROM (SELECT * FROM sec_t UNION ALL SELECT * FROM sec_t WHERE id IN (SELECT id FROM sec_t))", principal=who).count() == 2
    assert e.sql("SELECT * FROM sec_t", principal=engine.Principal("x", "admin")).count() == 2
    with pytest.raises(Exception):
        e.sql("SELECT * FROM sec_t", principal=engine.Principal("x", "guest")).count()
    assert e.sql("SELECT id FROM sec_t WHERE owner = :o", {"o": "b' OR '1'='1"}).count() == 0
    assert e.page("SELECT * FROM sec_t", 1)[1] and e.tables() == ["sec_t"]
    e.drop("sec_t")
    assert e.tables() == []


def test_profile_and_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "bb")], "i int, s string")
    for exact in (True, False):
        assert {tuple(r) for r in profile.profile(df, exact=exact).collect()} == {("i", 3, 1, 1, "1", "1"), ("s", 3, 1, 2, "a", "bb")}
    assert [tuple(r) for r in profile.profile(df.limit(0), ["i"]).collect()] == [("i", 0, 0, 0, None, None)]
    assert "Expand" not in profile.profile(df)._jdf.queryExecution().toString()
    c = profile.Check
    got = {r.check_name: r.n_failed for r in profile.run_checks(df, [c("n", "NOT_NULL", "i"), c("u", "UNIQUE", "i"), c("r", "RANGE", "i", (2, 3)), c("x", "REGEX", "s", ("^a",)), c("c", "CUSTOM", "", ("i = 1",))]).collect()}
    assert got == {"n": 1, "u": 1, "r": 2, "x": 1, "c": 0}


def test_strict_csv_is_split(spark, tmp_path):
    r = random.Random(8)
    rows = [(str(i), r.choice([None, "", 'q"', "é\n\n\"x\",\r\n" * r.randrange(1, 40), "plain"]), "z" * r.randrange(0, 30) or None) for i in range(1500)]
    df = spark.createDataFrame(rows, "id string, b string, c string")
    files.write_csv(df.coalesce(2), str(tmp_path / "out"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1k", "4k", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = files.read_csv(spark, str(tmp_path / "out"), ",", strict=True)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        assert files.read_csv(spark, str(tmp_path / "out"), ",", strict=True).rdd.getNumPartitions() > 20
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(files.head(spark, str(tmp_path / "out"), 5)) == 5


def test_csv_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;name;note\n1;;""\n2;"x;""y""\nz"\n3;null;q\n', encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), strict=True, nulls=("null",))
    assert [tuple(r) for r in got.collect()] == [("1", None, ""), ("2", 'x;"y"\nz', None), ("3", None, "q")]
    (tmp_path / "l.csv").write_text('a,b\n1,\n"","x,""y"\n\n3\n', encoding="utf-8")
    for lines in (True, False):
        got = files.read_csv(spark, str(tmp_path / "l.csv"), strict=True, lines=lines)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == [("", 'x,"y'), ("1", None), ("3", None)]
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "a.csv"), strict=True, lines=True).collect()
    for bad in ('a,b\n1,2,3\n', 'a,b\n"x"y,1\n', 'a,b\n"x,1\n', 'a,b\nx"y,1\n'):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(Exception):
            files.read_csv(spark, str(tmp_path / "bad.csv"), ",", strict=True).collect()
    assert files.read_csv(spark, str(tmp_path / "a.csv")).count() == 3
    assert files.detect_encoding("привет, мир как дела".encode("cp1251")) == "cp1251" and files.detect_encoding("привет".encode()) == "utf-8"
    assert files.detect_encoding("привет, мир как дела".encode("cp866")) == "cp866" and files.detect_encoding("привет, мир как дела".encode("koi8-r")) == "koi8-r"


def test_remote_sources_with_fakes(spark):
    pages = {0: [{"id": 1, "x": {"n": 1}}, {"id": 2, "x": None}], 2: [{"id": 3, "x": True}]}
    fake = lambda url, body, headers: json.dumps({"data": {"rows": pages[int(url.split("offset=")[1].split("&")[0])]}}).encode()
    assert [tuple(r) for r in remote.read_json_http(spark, "http://x/y", "data.rows", 2, fetch=fake).collect()] == [("1", ""), ("2", None), ("3", "true")]
    soap = lambda url, body, headers: b'<s:Envelope xmlns:s="u"><s:Body><r><row><a>1</a></row></r></s:Body></s:Envelope>'
    assert remote.read_soap(spark, "u", "{StartRow}/{PageSize}", "row", fetch=soap).first().a == "1"
    assert remote.xml_records(b"<r><h/><i><a>1</a></i><i><a>2</a></i></r>") == [{"a": "1"}, {"a": "2"}]
    eai = lambda url, body, headers: json.dumps({"items": [{"k": 1}] if "StartRowNum=0" in url else []}).encode()
    assert remote.read_eai(spark, "u", "items", 1, fetch=eai).count() == 1
    late = lambda url, body, headers: json.dumps([{"a": 1}, {"a": 2, "b": 3}]).encode()
    assert [tuple(r) for r in remote.read_json_http(spark, "u", fetch=late).collect()] == [("1", None), ("2", "3")]
    assert 'ON CONFLICT ("id") DO UPDATE SET "a" = EXCLUDED."a"' in remote.Jdbc("u").merge_statement("t", "s", ["id", "a"], ["id"])
    assert remote.Jdbc("u").merge_statement("t", "s", ["id"], ["id"]).endswith("DO NOTHING")
    assert "HOLDLOCK" in remote.Jdbc("u", "mssql").merge_statement("t", "s", ["id", "a"], ["id"])
    assert remote.Jdbc("u").options("t", ("id", 0, 9, 3), ("ts", 5))["numPartitions"] == "3"
    assert "ts > TIMESTAMP '2024-01-02 03:04:05'" in remote.Jdbc("u").options("t", watermark=("ts", datetime(2024, 1, 2, 3, 4, 5)))["dbtable"]
    assert remote.sql_literal("it's") == "'it''s'" and remote.sql_literal(None) == "NULL" and remote.sql_literal(True, "oracle") == "1"
    assert [remote.dialect_of(u) for u in ("jdbc:postgresql://h/d", "jdbc:sqlserver://h", "jdbc:derby:memory:x", "u")] == ["postgresql", "mssql", "derby", "postgresql"]
    assert remote.to_messages(spark.createDataFrame([(1, None)], "a int, b string")).first().value == '{"a":1,"b":null}'
    assert "&lt;" in remote.soap_envelope([{"a": "<"}], "op") and remote.kafka_options("s", "t", "g")["kafka.group.id"] == "g"


def test_stream_resumes(spark, tmp_path):
    seen, schema = [], "id int, ts timestamp"
    spark.sql("SELECT 1 AS id, TIMESTAMP '2024-01-01 00:00:00' AS ts").write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: events.run_available(events.file_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "c"), lambda df, k: seen.extend(r.id for r in df.collect()))
    go()
    go()
    assert seen == [1]
    spark.sql("SELECT 2 AS id, TIMESTAMP '2024-01-01 00:00:00' AS ts").write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert seen == [1, 2]


def test_database_connector(spark):
    c = connectors.open_connector(spark, "jdbc", url="jdbc:derby:memory:conn;create=true")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, s string, at timestamp")
    t0, t1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    c.write(rows((1, "a", t0), (2, None, t1)), "people", mode="overwrite")
    c.write(rows((2, "b", t1), (3, "it's", t1)), "people", key=("id",))
    want = [(1, "a", t0), (2, "b", t1), (3, "it's", t1)]
    assert sorted(tuple(r) for r in c.read("people").collect()) == want
    c.write(rows((2, "b", t1), (3, "it's", t1)), "people", key=("id",))
    assert sorted(tuple(r) for r in c.read("people").collect()) == want
    with pytest.raises(ValueError):
        c.write(rows((4, "x", t1), (4, "y", t1)), "people", key=("id",))
    with pytest.raises(Exception):
        c.jdbc.execute(spark, ["DELETE FROM people", "DELETE FROM nope"])
    assert c.read("people").count() == 3 and "PEOPLE" in c.entities() and not any("STAGE" in e.upper() for e in c.entities())
    assert c.jdbc.read(spark, "people", watermark=('"at"', t0)).count() == 2 and c.jdbc.read(spark, "SELECT \"id\" AS x FROM people", partition=("X", 1, 3, 2)).count() == 3
    assert [n for n, _ in c.describe("people")] == ["id", "s", "at"] and c.preview("people", 1).count() == 1 and c.ping() == (True, "")
    assert not connectors.open_connector(spark, "jdbc", url="jdbc:derby:memory:none").ping()[0]


def test_file_and_service_connectors(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    for kind in ("csv", "parquet", "xml"):
        c = connectors.open_connector(spark, kind, path=str(tmp_path / kind))
        c.write(df, f"x.{kind}", mode="overwrite")
        assert c.entities() == [f"x.{kind}"] and c.ping()[0]
        assert sorted((str(r.id), r.s) for r in c.read(f"x.{kind}").collect()) == [("1", "a"), ("2", None)]
        with pytest.raises(ValueError):
            c.write(df, "x", key=("id",))
    assert not connectors.open_connector(spark, "csv", path=str(tmp_path / "none")).ping()[0]
    with pytest.raises(ValueError):
        connectors.open_connector(spark, "nope")
    connectors.register_connector("own", lambda s, n: connectors.Connector(s))
    assert connectors.open_connector(spark, "own", n=1).entities() == []
    (tmp_path / "g.xml").write_text("<r><h/><i><a>1</a></i><i><a>2</a></i></r>")
    assert connectors.open_connector(spark, "xml", path=str(tmp_path / "g.xml")).read().count() == 2
    out = str(tmp_path / "sent")

    def send(url, body, headers):
        with open(out, "a") as f:
            f.write(body.decode() + "\n")
        return b"{}"

    connectors.open_connector(spark, "eai", url="u", fetch=send).write(df.coalesce(1), "Account")
    connectors.open_connector(spark, "soap", url="u", fetch=send, operation="Put").write(df.coalesce(1))
    connectors.open_connector(spark, "json_http", url="u", fetch=send).write(df.coalesce(1))
    lines = open(out).read().splitlines()
    assert json.loads(lines[0]) == {"Account": [{"id": "1", "s": "a"}, {"id": "2", "s": None}]} and "<Put><row><id>1</id>" in lines[1] and json.loads(lines[2])[1] == {"id": 2, "s": None}


def test_message_formats(spark):
    schema = json.dumps({"type": "record", "name": "R", "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "d", "type": "double"}, {"name": "b", "type": "boolean"}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["x", "y"]}}, {"name": "l", "type": {"type": "array", "items": "int"}}, {"name": "m", "type": {"type": "map", "values": "E"}}]})
    body = bytes([0x03, 0x02, 0x04]) + b"hi" + bytes.fromhex("000000000000f83f") + bytes([1, 2, 4, 2, 3, 0, 2, 2]) + b"k" + bytes([0, 0])
    df = spark.createDataFrame([(7, bytearray(body)), (8, bytearray(b"\x00\x00\x00\x00\x01" + body)), (9, bytearray(body[:-1])), (10, None), (11, bytearray())], "offset long, value binary")
    got = [tuple(r) for r in remote.parse_messages(df, schema, "avro").collect()]
    assert got[:2] == [(k, -2, "hi", 1.5, True, "y", "[1, -2]", '{"k": "x"}') for k in (7, 8)]
    assert all(r[1:] == (None,) * 7 for r in got[2:])
    r = avro.Reader(bytes([0xFE, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0x01, 0x80, 0x02]))
    assert r.long() == 2**63 - 1 and r.long() == 128
    text = spark.createDataFrame([(1, "a,2"), (2, "bad json")], "offset long, value string")
    assert tuple(remote.parse_messages(text, "x string, y int", "csv").first()) == (1, "a", 2)
    assert [r.value for r in remote.parse_messages(text, "", "text").collect()] == ["a,2", "bad json"]
    assert [r.x for r in remote.parse_messages(text, "x string").collect()] == [None, None]


def test_slot_changes(spark):
    rows = [("0/FF", "BEGIN 7"), ("0/1A", "table public.t: INSERT: id[integer]:1 \"Na me\"[character varying]:'it''s [x]:1' ok[boolean]:true"), ("1/0", "table public.t: UPDATE: old-key: id[integer]:1 new-tuple: id[integer]:2 \"Na me\"[text]:null"), ("0/2", "table public.other: DELETE: id[integer]:9"), ("0/3", "table public.t: DELETE: id[integer]:2")]
    got = events.parse_changes(spark.createDataFrame(rows, "lsn string, data string"), "public.t", ["id", "Na me", "ok"]).orderBy("lsn").collect()
    assert [(int(r.lsn), r.op, r.id, r["Na me"], r.ok) for r in got] == [(3, "DELETE", "2", None, None), (26, "INSERT", "1", "it's [x]:1", "true"), (2**32, "UPDATE", "2", None, None)]


def test_consumer_hands_batches_over(spark, tmp_path):
    seen = []
    spark.range(3).write.parquet(str(tmp_path / "in"))
    q = events.consume(events.file_stream(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "c"), lambda df: seen.extend(r.id for r in df.collect()), "1 second")
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [0, 1, 2]


def test_anomaly_chunks_match_whole_partitions(spark):
    r = random.Random(4)
    rows = [(k, r.choice(["a", None]), k // 7, r.random() * (50 if k % 97 == 0 else 1)) for k in range(1200)]
    df = spark.createDataFrame(rows, "id int, g string, h int, v double")
    want = {x.id: x.z for x in profile.anomalies(df, ["g"], ["id"], "v", window=20).collect()}
    for chunk in (20, 33, 10_000):
        got = {x.id: x.z for x in profile.anomalies(df, ["g"], ["id"], "v", window=20, split=F.col("h"), chunk=chunk).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert sum(x.is_anomaly for x in profile.anomalies(df, ["g"], ["id"], "v", window=20).collect()) >= 5


def test_paged_services(spark):
    rows = [{"id": k, "s": None if k % 3 else f"t{k}", "x": {"y": k}} for k in range(95)]
    posted = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(p.split("=") for p in self.path.split("?")[1].split("&"))
            at, n = int(q["offset"]), int(q["limit"])
            self.reply({"data": rows[at : at + n]})

        def do_POST(self):
            posted.extend(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.reply({})

        def reply(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/r"
        spark.dataSource.register(pages.PagedJson)
        read = lambda total: spark.read.format("quern_pages").schema("id long, s string, x string").options(url=url, total=total, page_size=10, pages_per_task=3, data_path="data").load()
        df = read(95)
        assert df.rdd.getNumPartitions() == 4
        assert sorted(tuple(r) for r in df.collect()) == [(r["id"], r["s"], json.dumps(r["x"])) for r in rows]
        with pytest.raises(Exception):
            read(120).collect()
        df.select("id", "s").write.format("quern_pages").mode("append").options(url=url, batch=7).save()
        assert sorted(r["id"] for r in posted) == list(range(95))
    finally:
        server.shutdown()


def test_connections_and_specs(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "st"))
    monkeypatch.setenv("QUERN_TEST_DIR", str(tmp_path / "in"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string").write.parquet(str(tmp_path / "in"))
    c = connectors.Connections(spark, store)
    c.save("lake", "parquet", path="${QUERN_TEST_DIR}")
    assert c.names() == ["lake"] and c.open("lake").read().count() == 2 and "QUERN_TEST_DIR" in str(store.read("connection-lake"))
    specs = pipeline.Specs(store)
    specs.save("copy", "name: copy\nvars: {least: 1}\nsteps:\n- {id: a, source: {connection: lake}}\n- {id: b, sql: 'SELECT * FROM a WHERE id > {{ least }}', deps: [a], sink: {connector: csv, path: " + str(tmp_path / "out") + "}}\n")
    assert specs.names() == ["copy"] and specs.load("copy", {"least": 0}, connections=c).run(spark).count() == 2
    specs.load("copy", connections=c).run(spark)
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out")).collect()] == [("2", "b")]
    with pytest.raises(ValueError):
        specs.load("copy").run(spark)
    assert specs.delete("copy") and c.delete("lake")
    for bad in (lambda: c.open("lake"), lambda: specs.text("copy")):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(ValueError):
        c.save("x", "nope")


def test_slots_xml_services_and_catalog_numbers(spark, tmp_path):
    assert "peek_changes('it''s', NULL, 5)" in remote.slot_query("it's", 5) and "'0/1'::pg_lsn" in remote.confirm_statement("s", "0/1")
    out = str(tmp_path / "sent")

    def send(url, body, headers):
        if body:
            with open(out, "a") as f:
                f.write(body.decode())
        return b"<r><i><a>1</a></i><i><a>2</a><b>x</b></i></r>"

    c = connectors.open_connector(spark, "xml_http", url="u", fetch=send)
    assert [tuple(r) for r in c.read().collect()] == [("1", None), ("2", "x")] and c.ping()[0]
    c.write(spark.createDataFrame([(1, "<")], "a int, b string"))
    assert open(out).read() == '<?xml version="1.0" encoding="UTF-8"?><rows><row><a>1</a><b>&lt;</b></row></rows>'
    e = engine.Engine(spark, database=dml.Database(spark, str(tmp_path / "db")))
    e.database.write("cat_t", spark.range(1))
    e.information_schema()
    assert [tuple(r) for r in e.sql("SELECT relname, nspname FROM pg_class JOIN pg_namespace n ON relnamespace = n.oid").collect()] == [("cat_t", "public")]


def test_stream_progress_is_told(spark, tmp_path):
    p, told = events.Progress(), []
    p.listeners.append(told.append)
    spark.streams.addListener(p)
    try:
        spark.range(3).write.parquet(str(tmp_path / "in"))
        events.run_available(events.file_stream(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "c"), lambda df, k: df.count())
        for _ in range(100):
            if told and told[-1]["event"] == "ended":
                break
            time.sleep(0.1)
        assert [t["event"] for t in told][0] == "started" and told[-1]["event"] == "ended" and sum(t.get("rows", 0) for t in told) == 3
    finally:
        spark.streams.removeListener(p)
