import re
import zlib

import numpy as np
import pytest
from helpers import SF, awkward, roots

import corpus_pipeline
from quern.llm import language, mixing, quality, queries
from quern.llm.common import table


def plain_kneser_ney(counts, alphabet):
    """p(character | history) by the interpolated definition, from the counts of one language's longest n-grams."""
    levels = {4: dict(counts)}
    for k in (3, 2, 1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1

    def p(history, c):
        if len(history) + 1 > 4:
            history = history[-3:]
        k = len(history) + 1
        seen = levels[k]
        ones, twos = (sum(v == w for v in seen.values()) for w in (1, 2))
        d = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.05), 0.95)
        lower = p(history[1:], c) if k > 1 else 1 / (len(alphabet) + 1)
        after = {g: v for g, v in seen.items() if g[:-1] == history}
        total = sum(after.values())
        if not total:
            return lower
        return max(after.get(history + c, 0) - d, 0) / total + d * len(after) / total * lower

    return p


def model_p(m, history, c, k):
    """The probability that the stored tables give, by backing off."""
    back, codes = 0.0, history + c
    for order in range(4, 0, -1):
        keys, logs = m.grams[order - 1]
        h = np.uint64(language._gram_hash(codes[-order:]))
        at = np.searchsorted(keys, h)
        if at < len(keys) and keys[at] == h:
            return np.exp(logs[at][k] + back)
        if order > 1:
            keys, logs = m.back[order - 2]
            h = np.uint64(language._gram_hash(codes[-order:-1]))
            at = np.searchsorted(keys, h)
            if at < len(keys) and keys[at] == h:
                back += logs[at][k]
    return np.exp(m.floor[k] + back)


def test_models_are_kneser_ney():
    rng, counts = np.random.default_rng(3), {}
    for lang, letters in (("a", "xyz "), ("b", "yzw "), ("c", "x ")):
        text, counts[lang] = "   " + "".join(rng.choice(list(letters), 300)), {}
        for i in range(len(text) - 3):
            counts[lang][text[i : i + 4]] = counts[lang].get(text[i : i + 4], 0) + 1
    m, alphabet = language.kneser_ney(counts), "xyzw "
    for k, lang in enumerate("abc"):
        p = plain_kneser_ney(counts[lang], alphabet)
        for history in ("   ", "  x", " xy", "xyz", "zzz", "www", "w x", "qqq"):
            got = [model_p(m, history, c, k) for c in alphabet + "q"]
            assert np.allclose(got, [p(history, c) for c in alphabet + "q"], rtol=1e-4)
            # With the unseen characters, whose mass stands for one more, the probabilities sum to one.
            assert abs(sum(got) - 1) < 1e-4


def test_predictions_match_a_walk_over_characters(spark):
    docs = table(spark, SF, "documents")
    m, rows = queries.language_model(docs), docs.limit(40).collect()
    got = {r.doc_id: r for r in language.identify(docs, m).collect()}
    for r in rows:
        codes = language._codes(r.text or "").tobytes().decode("utf-32-le")
        if len(codes) < 4:
            assert got[r.doc_id].lang_pred == "und"
            continue
        whole_text = len(codes) <= 400
        codes = codes if whole_text else codes[: codes.rindex(" ", 0, 400) + 1]
        bits = [-sum(np.log2(model_p(m, codes[i - 3 : i], codes[i], k)) for i in range(3, len(codes))) / (len(codes) - 3) for k in range(len(m.langs))]
        if whole_text:
            assert got[r.doc_id].lang_pred == m.langs[int(np.argmin(bits))] and abs(got[r.doc_id].bits - min(bits)) < 1e-3
        assert np.allclose(m.entropies([codes[3:]])[0][0], bits, atol=1e-3)


def test_long_texts_are_scored_in_parts(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    m, texts = queries.language_model(docs), [r.text for r in docs.limit(20).collect()] + [None, "", "a", "12"]
    whole = m.entropies(texts)
    monkeypatch.setattr(language, "PLACES", 57)
    parts = m.entropies(texts)
    assert np.allclose(whole[0], parts[0], atol=1e-4) and (whole[1] == parts[1]).all()


def test_held_out_accuracy_and_contract(spark):
    rows = queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)


def test_rejects_other_languages(spark):
    m = queries.language_model(table(spark, "/root/testdata/sf0.01", "documents"))
    odd = spark.createDataFrame([(1, "zqxj wvkp qqzx jjvw xkcd zzpq " * 30)], "doc_id long, text string")
    assert language.identify(odd, m).first().rejected
    assert language.keep_identified(odd, m).count() == 0


def invented(letters, n, seed, words=120):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(60)]
    return [" ".join(rng.choice(stems, words)) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 8, 30, 90])
def test_rare_languages_reject(spark, n):
    rare = invented("klmnopqr", n + 10, 1)
    rows = [(k, t, "common") for k, t in enumerate(invented("abcdefghij", 900, 2))] + [(5000 + k, t, "rare") for k, t in enumerate(rare[:n])]
    m = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.langs == ["common", "rare"] and np.isfinite(m.limits).all()
    odd = invented("klmnopqrstuvwxyz", 5, 3) + ["zqxj wvkp qqzx jjvw xkcd zzpq " * 30]
    assert language._predict(m, odd)[3].all()
    if n >= 8:
        assert not language._predict(m, rare[n:])[3].any()


def test_many_languages_have_limits(spark):
    names = [chr(97 + k) + chr(98 + k) + chr(99 + k) for k in range(22)]
    rows = [(1000 * i + k, t, x) for i, x in enumerate(names) for k, t in enumerate(invented(x, 160, i, 20))]
    assert np.isfinite(language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).limits).all()


@pytest.mark.parametrize("n", [None, 0])
def test_awkward_languages(spark, n):
    docs = awkward(spark) if n is None else awkward(spark).limit(n)
    got = language.identify(docs, queries.language_model(docs)).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got if r.doc_id}
    for k in (3, 4, 5, 7) if got else ():
        assert by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected
    unlabelled = docs.withColumn("lang", language.F.lit(None).cast("string"))
    assert queries.language_model(unlabelled) is None
    assert all(r.lang_pred == "und" for r in language.identify(unlabelled, None).collect())
    assert language.keep_identified(unlabelled, None).count() == 0


def plain_statistics(text):
    words, cur = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words += [cur] * bool(cur)
            cur = ""
        else:
            cur += c
    words += [cur] * bool(cur)
    seen, dups = [], 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dups += line in seen
            seen.append(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = set()
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    for i, g in enumerate(grams):
        if count[g] > 1:
            inside |= set(range(i, i + 8))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(inside)]


def test_statistics_match_plain(spark):
    texts = [None, "", "a b", "x\ny\nx \nx\n\n \n", "é ü #1 $$ <b>&|%*", "a b c d e f g h i a b c d e f g h", "w " * 40, "  　 x\x1cy\x85z"]
    texts += [r.text for r in table(spark, SF, "documents").limit(60).collect()]
    for t in texts:
        assert quality.statistics(t)[0] == plain_statistics(t)


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) - x[:, 1] + 0.03 * rng.standard_normal(2000) > 0).astype(float)
    t = quality.fit_trees(x, y, [1, -1, 0])
    assert ((t.score(x) > 0) == (y > 0)).mean() > 0.93
    grid = np.tile(x[:50], (40, 1))
    for f, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, f] = np.repeat(np.linspace(0, 1, 40), 50)
        s = t.score(g).reshape(40, 50)
        assert (np.diff(s, axis=0) * sign >= -1e-9).all()
    # One row walked by hand.
    row, total = x[7], t.prior
    for node in t.roots:
        while t.feature[node] >= 0:
            node = t.left[node] if row[t.feature[node]] <= t.cut[node] else t.right[node]
        total += t.value[node]
    assert abs(total - t.score(x[7:8])[0]) < 1e-9
    assert quality.fit_trees(x, np.ones(2000), [0, 0, 0]) is None


def test_quality_keeps_good_and_drops_bad(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert len(got) == table(spark, sf, "documents").count()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got.values())
    good = [got[d] for d, q in labels.items() if q == 1 and not got[d].base_failed]
    bad = [got[d] for d, q in labels.items() if q == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.7 * len(bad)


def plain_features(text):
    """The trees' features, from words and lines."""
    n, chars, symbols, dups, repeats = plain_statistics(text)
    text = text or ""
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", text) if w]
    lines = sum(1 for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r"))
    c, w, has = max(chars, 1), max(n, 1), lambda kinds: sum(x in kinds for x in text)
    return [np.log1p(n), chars / w, symbols / c, dups / max(lines, 1), repeats / w, has("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / c, has("0123456789") / c, has("!?,;:.\"'()-") / c, n / max(lines, 1), len(set(words)) / w, min(max((len(x.encode()) for x in words), default=0), 1000), has(".!?") / w]


def test_whole_query_matches_plain_rules_and_walked_trees(spark):
    docs = table(spark, SF, "documents")
    t = quality.fit_quality(docs, table(spark, SF, "labels"))
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        base, x, score = plain_statistics(r.text), plain_features(r.text), t.prior
        for node in t.roots:
            while t.feature[node] >= 0:
                node = t.left[node] if x[t.feature[node]] <= t.cut[node] else t.right[node]
            score += t.value[node]
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        q = got[r.doc_id]
        assert [q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words] == base and q.base_failed == failed
        assert q.kept == (not failed and score >= t.threshold) or abs(score - t.threshold) < 1e-9


def test_threshold_comes_from_rows_the_trees_have_not_seen():
    rng = np.random.default_rng(2)
    x, y = rng.random((4000, 4)), (rng.random(4000) < 0.7).astype(float)
    t = quality.fit_trees(x, y, [0] * 4, trees=60, keep=0.9)
    held = np.random.default_rng(1).permutation(4000) % 5 == 0
    assert abs((t.score(x[held & (y == 1)]) >= t.threshold).mean() - 0.9) < 0.01 or t.threshold == 0
    assert quality.fit_trees(x[:60], y[:60], [0] * 4) is not None


def test_awkward_quality(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (6, None)], "doc_id long, quality int")
    for d in (docs, docs.limit(0)):
        for lab in (labels, labels.limit(0)):
            trees = quality.fit_quality(d, lab)
            got = quality.judge_quality(d, trees)
            assert got.count() == d.count()
            assert quality.keep_quality(d, trees).count() == got.filter("kept").count()
    assert all(r.base_failed and r.n_words == 0 for r in quality.judge_quality(docs, None).filter("doc_id in (3, 4, 5)").collect())


def test_stages_take_awkward_documents(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for k, docs in enumerate((awkward(spark), awkward(spark).limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "pieces":
                assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{k}{name}")


def test_pipeline_matches_stages_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = docs.collect()
    model = queries.language_model(docs)
    kept = [r for r, bad in zip(rows, language._predict(model, [r.text for r in rows])[3]) if not bad]
    now = corpus_pipeline.identify_language(spark, docs, SF)
    assert sorted(r.doc_id for r in now.collect()) == sorted(r.doc_id for r in kept)
    trees = quality.fit_quality(now, table(spark, SF, "labels"))
    good = []
    for r in kept:
        base = plain_statistics(r.text)
        if base[0] >= 20 and 100 * base[4] <= 30 * base[0] and trees.score(np.array([plain_features(r.text)]))[0] >= trees.threshold:
            good.append(r)
    now = corpus_pipeline.apply_quality(spark, now, SF)
    assert sorted(r.doc_id for r in now.collect()) == sorted(r.doc_id for r in good)
    sets = []
    for r in good:
        w = [x for x in re.split("[\\x20\\x09-\\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)) if x]
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    of = roots(range(len(good)), [(i, j) for i in range(len(good)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    least = {}
    for i, r in enumerate(good):
        least[of[i]] = min(least.get(of[i], r.doc_id), r.doc_id)
    now = corpus_pipeline.drop_near_duplicates(spark, now, SF)
    assert sorted(r.doc_id for r in now.collect()) == sorted(least.values())
    copies = {r.doc_id: r.copies for r in mixing.mix(now).collect()}
    mixed = [r.doc_id for r in corpus_pipeline.mix_sources(spark, now, SF).collect()]
    assert {d: mixed.count(d) for d in copies} == copies
    texts, vocabulary = {r.doc_id: r.text for r in rows}, queries.piece_vocabulary()
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(mixed)
    assert all(r.ids == vocabulary.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids) and r.decoded_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in out)
