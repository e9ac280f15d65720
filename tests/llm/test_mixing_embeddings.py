import numpy as np
import pytest
from helpers import SF, awkward, roots

from quern.llm import embeddings, mixing, queries
from quern.llm.common import table


def test_targets_share_by_weight_under_caps():
    got = mixing.targets([10, 100, 1000, 5], [3, 1, 2, 3], 1.5, 2)
    assert abs(sum(got) - 1.5 * 1115) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in zip(got, [10, 100, 1000, 5]))
    assert got[0] == 20 and got[3] == 10
    free = [(t, w) for t, s, w in zip(got, [10, 100, 1000, 5], [3, 1, 2, 3]) if t < 2 * s]
    assert all(abs(t / w - free[0][0] / free[0][1]) < 1e-6 for t, w in free)
    assert mixing.targets([], [], 1.5, 2) == [] and mixing.targets([0, 0], [3, 1], 1.5, 2) == [0, 0]


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 500):
        size, p = rng.integers(1, 1000, n), rng.random(n)
        got = mixing.fly(size, p, np.random.default_rng(1))
        assert ((got > 0) & (got < 1)).sum() <= 2
        assert abs(got.sum() - p.sum()) < 1e-6 and abs((got * size).sum() - (p * size).sum()) < 1e-4
    same = mixing.fly(np.full(10, 7), np.full(10, 0.5), np.random.default_rng(2))
    assert same.sum() == 5 and set(same) <= {0.0, 1.0}


def test_flight_keeps_inclusion_chances():
    size, p = np.array([1, 2, 3, 4, 50, 60]), np.array([0.3, 0.5, 0.7, 0.2, 0.6, 0.4])
    got = np.mean([mixing.land(size, mixing.fly(size, p, np.random.default_rng(k)), np.random.default_rng(k + 9)) for k in range(4000)], axis=0)
    assert np.abs(got - p).max() < 0.04


@pytest.mark.parametrize("block", [20_000, 12])
def test_mix_reaches_targets_and_agrees(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    a, b = (sorted(tuple(r) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert a == b and len(a) == docs.count()
    by = {}
    for doc, size, source, source_size, target, copies, taken in a:
        assert size == len(docs_words(docs, doc)) and taken == copies * size <= 2 * size
        by.setdefault(source, [0, source_size, target, 0])
        by[source][0] += size
        by[source][3] = max(by[source][3], size)
        by[source].append(taken)
    assert abs(sum(v[2] for v in by.values()) - 1.5 * sum(v[0] for v in by.values())) < 1e-3
    for size, source_size, target, largest, *taken in by.values():
        assert size == source_size and abs(sum(taken) - target) <= 2 * largest


def test_every_outcome_keeps_the_totals():
    """All outcomes of small flights and landings against all subsets: totals as near as two documents allow."""
    rng = np.random.default_rng(8)
    for trial in range(30):
        size, p = rng.integers(1, 60, 6), rng.random(6)
        subsets = [np.array([k >> i & 1 for i in range(6)]) for k in range(64)]
        fits = {tuple(s) for s in subsets if abs(s.sum() - p.sum()) < 2 and abs(s @ size - p @ size) <= 2 * size.max()}
        for k in range(60):
            got = mixing.land(size, mixing.fly(size, p, np.random.default_rng([trial, k])), np.random.default_rng([trial, k, 1]))
            assert tuple(got.astype(int)) in fits


@pytest.mark.parametrize("block", [20_000, 12])
def test_mix_balances_documents_and_words_in_each_block(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    docs = table(spark, SF, "documents")
    by = {}
    for r in mixing.mix(docs).collect():
        by.setdefault(r.source, []).append((r["size"], r.copies, r.target / r.source_size if r["size"] else 0.0))
    for rows in by.values():
        assert all(int(rate + 1e-9) <= copies <= int(rate + 1e-9) + 1 for _, copies, rate in rows)
        # Only the last two documents of a source are settled by a draw.
        assert abs(sum(c for _, c, _ in rows) - sum(rate for _, _, rate in rows)) < 2 + 1e-6
        assert abs(sum(s * c for s, c, _ in rows) - sum(s * rate for s, _, rate in rows)) <= 2 * max(s for s, _, _ in rows)


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 3)
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(k, "a b", str(k)) for k in range(4)], "doc_id long, text string, source string"))


_words: dict = {}


def docs_words(docs, doc):
    if not _words:
        _words.update({r.doc_id: (r.text or "").split() for r in docs.collect()})
    return _words[doc]


def test_awkward_mix(spark):
    docs = awkward(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(r.taken <= 2 * r["size"] for r in got)
    assert {r.source for r in got} == {"a", "b", "ü", None}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert len(queries.op6_source_mixing(spark, SF).columns) == 5


def brute(rows, cosine=0.93):
    """n_links of each row and links, by all pairs."""
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])]
    n, links = {}, []
    for i, a in enumerate(ok):
        x = np.array(a[1], float)
        for b in ok[:i]:
            y = np.array(b[1], float)
            if a[2] == b[2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                n[a[0]], n[b[0]] = n.get(a[0], 0) + 1, n.get(b[0], 0) + 1
                links.append((a[0], b[0]))
    return n, roots({r[0] for r in rows}, links)


@pytest.mark.parametrize("block", [2048, 24])
def test_near_vectors_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 32))
    x = np.concatenate([np.repeat(base, 12, 0) + 0.2 * rng.standard_normal((480, 32)), np.repeat(base[:1], 60, 0), base[1] + 0.05 * rng.standard_normal((120, 32))])
    rows = [(k, v.astype(np.float32).tolist(), k % 3) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    n, of = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert all(r.kept == (r.vec_id == r.component_id) and r.n_links <= n.get(k, 0) for k, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n.values())
    assert sum(got[k].component_id == of[k] for k in of) >= 0.98 * len(of)


def test_given_vectors_recall(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    n, of = {}, {}
    pdf = df.toPandas()
    links = []
    for _, g in pdf.groupby("label"):
        x = np.stack(g.embedding.to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        i, j = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
        ids = g.vec_id.to_numpy()
        links += list(zip(ids[i].tolist(), ids[j].tolist()))
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.99 * 2 * len(links)
    of = roots(pdf.vec_id.tolist(), links)
    assert sum(got[k].component_id == v for k, v in of.items()) >= 0.99 * len(of)


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 0.0], 1, 0), (2, [2.0, 0.0], 1, 0), (2, [2.0, 0.0], 1, 0), (3, [1.0, 0.0], None, 0), (4, None, 1, 0), (5, [0.0, 0.0], 1, 0), (6, [1.0, None], 1, 0), (7, [float("nan"), 1.0], 1, 0), (8, [float("inf"), 1.0], 1, 0), (9, [], 1, 0), (None, [1.0, 0.0], 1, 0), (10, [1.0, 0.0, 0.0], 1, 0), (11, [-0.0, 1.0], 2, 0), (12, [0.0, 1.0], 2, 0), (13, [1.0, 0.0], 2, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, h1 int")
    got = sorted((tuple(r) for r in embeddings.near_vectors(df).collect()), key=lambda r: (r[0] is None, r[0]))
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *[(k, 0, k, True) for k in range(3, 11)], (11, 1, 11, True), (12, 1, 11, False), (13, 0, 13, True), (None, 0, None, True)]
    assert got == want
    assert embeddings.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("dim", "n"), [(64, 300), (64, 6_000), (64, 200_000), (8, 5_000), (2, 100), (1, 10)])
def test_filters_meet_their_recall_and_size(dim, n):
    f = embeddings.Filters(dim, n, 0.93)
    rng = np.random.default_rng(12)
    a, z = rng.standard_normal((2, 1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * z if dim > 1 else a
    assert f._met(a, b)[0] >= 0.975
    assert n * f.mean / (f.turns * f.codes) <= embeddings.TARGET and f.mean < 30
    # Decoding finds exactly the directions whose inner product reaches the height.
    if f.codes <= 4_096:
        row, code = f.decode(a[:50])
        want = set()
        for t, cuts in enumerate(f.cuts):
            dots = a[:50] @ cuts[0]
            for c in cuts[1:]:
                dots = (dots[:, :, None] + (a[:50] @ c)[:, None, :]).reshape(50, -1)
            i, j = np.nonzero(dots >= f.height - 1e-12)
            want |= set(zip(i.tolist(), (j + t * f.codes).tolist()))
        got = set(zip(row.tolist(), code.tolist()))
        assert got <= want and len(want) - len(got) <= 2
