import random
import time

import numpy as np
import pytest
import xxhash
from helpers import SF, awkward, roots

import corpus_pipeline
from quern.llm import simhash
from quern.llm.common import table
from quern.llm.components import connected_components


def test_components_match_union_find(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500, 500 + k) for k in range(1, 80)] + [(k, k + 1) for k in range(900, 960)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame([*links, (7, None), (None, None), (8, 8)], "src long, dst long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots(nodes, [x for x in links if x[0] != x[1]])
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert {x.node: x.component for x in connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")).collect()} == {"a": "a", "b": "a", "c": "a"}


def plain_fingerprint(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def mixed(h):
    """One step of SplitMix64 in plain integers."""
    h = (h + 0x9E3779B97F4A7C15) % 2**64
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
    return h ^ h >> 31


def plain_halves(text, n):
    words = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))] if words else []
    return [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in k) > len(k)) for k in (hs, [mixed(h) for h in hs])]


@pytest.mark.parametrize("words", [1, 5])
def test_halves_match_plain(words):
    for text in (None, "", "A b", "a B c d e", "one two\tthree\x0bfour five six É é " * 9):
        assert simhash.halves(text, words, looks=2) == plain_halves(text, words)
        assert simhash.fingerprint(text, words) == plain_fingerprint(text, words)


def test_fingerprint_matches_plain_and_spark_hash(spark):
    for text in (None, "", "  ", "A b", "a B c d", "one two\tthree\x0bfour five six É é " * 9):
        assert simhash.fingerprint(text) == plain_fingerprint(text, 4)
    assert spark.sql("select xxhash64('a b c d')").first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("make", [lambda s: table(s, SF, "documents"), awkward, lambda s: awkward(s).limit(0)])
def test_near_duplicates_match_all_pairs(spark, make):
    docs = make(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fp = [plain_fingerprint(t, 4) for _, t in rows]
    of = roots(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[of[i]] = min(least.get(of[i], d), d)
    want = sorted(((d, fp[i], least.get(of[i])) for i, (d, _) in enumerate(rows)), key=repr)
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == want


@pytest.mark.parametrize(("radius", "parts", "block"), [(4, None, 4096), (4, 3, 16), (7, 4, 64), (10, 4, 4096), (3, 2, 8)])
def test_links_keep_components(spark, monkeypatch, radius, parts, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, radius + 2), replace=False)) for b in np.repeat(base, 8)]
    hot = [int(base[0]) ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False)) for _ in range(200)]
    fps = sorted({*map(int, base), *near, *hot})
    want = roots(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius])
    signed = [((f - 2**64) if f >> 63 else f,) for f in fps]
    got = [(r.src & (2**64 - 1), r.dst & (2**64 - 1)) for r in simhash.links(spark.createDataFrame(signed, "fp long"), radius, parts).collect()]
    assert len(got) < len(fps) * len(fps) / 8
    assert roots(fps, got) == want


@pytest.mark.parametrize("block", [4096, 16])
def test_links_of_two_halves(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (40, 2), np.uint64)
    flip = lambda x, n: int(x) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False))
    fps = sorted({(flip(a, rng.integers(0, 9)), flip(b, rng.integers(0, 9))) for a, b in np.repeat(base, 6, 0)})
    near = lambda x, y: (x[0] ^ y[0]).bit_count() <= 6 and sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True)) <= 11
    names = [a ^ b for a, b in fps]
    want = roots(names, [(a ^ b, c ^ d) for i, (a, b) in enumerate(fps) for c, d in fps[:i] if near((a, b), (c, d))])
    signed = [tuple(v - 2**64 if v >> 63 else v for v in f) for f in fps]
    got = [(r.src & (2**64 - 1), r.dst & (2**64 - 1)) for r in simhash.links(spark.createDataFrame(signed, "fp long, other long"), 6, wide=11).collect()]
    assert roots(names, got) == want
    assert len(set(want.values())) < len(names)


def test_thresholds_are_a_least_cost_pigeonhole():
    costs = [[0, 5, 9, 40], [0, 1, 2, 3], [0, 7, 8, 90]]
    got = simhash.allocate(costs, 4)
    assert sum(t + 1 for t in got) == 5
    every = [(a, b, c) for a in range(4) for b in range(4) for c in range(4) if a + b + c == 5]
    assert sum(r[t + 1] for r, t in zip(costs, got)) == min(costs[0][a] + costs[1][b] + costs[2][c] for a, b, c in every)


def keys_each(n, radius):
    """Partitions, and keys of a fingerprint of random bits."""
    cost = simhash.weighed(n, radius)
    parts = min(cost, key=cost.get)
    groups = [list(range(64))[i::parts] for i in range(parts)]
    got = simhash.allocate(simhash._costs(n, np.full(64, 0.5), groups, radius), radius)
    assert sum(t + 1 for t in got) == radius + 1
    return parts, sum(simhash._probes(len(g) / 2, t) for g, t in zip(groups, got) if t >= 0)


@pytest.mark.parametrize(("radius", "most"), [(4, 160), (10, 16_000)])
def test_partitions_reach_the_radius_at_any_size(radius, most):
    keys = [keys_each(n, radius) for n in (1_000, 10**5, 320_000, 10**6, 10**7, 51_000_000, 60_000_000, 10**8, 10**9, 10**10, 10**12)]
    assert [p for p, _ in keys] == sorted((p for p, _ in keys), reverse=True) and [k for _, k in keys] == sorted(k for _, k in keys)
    assert keys[-1][1] <= most and all(keys_each(n, radius) for n in (0, 1, 2))


def test_pairs_keep_within_the_wide_radius():
    """Fingerprints of both halves at a similarity of 0.8 stay far within what is compared."""
    rng, bits = np.random.default_rng(6), []
    for _ in range(400):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 94)]
        other = words[:84] + [f"o{x}" for x in rng.integers(0, 1 << 40, 10)]
        a, b = (set(simhash.shingles(" ".join(t), 5).tolist()) for t in (words, other))
        assert 0.79 < len(a & b) / len(a | b) < 0.81
        bits.append(sum((x ^ y).bit_count() for x, y in zip(*(simhash.halves(" ".join(t), 5, looks=2) for t in (words, other)), strict=True)))
    # The mean is 19.4 and the deviation 4.1, so 40 bits are 5 deviations above it.
    assert abs(np.mean(bits) - 19.4) < 1 and np.std(bits) < 4.6 and max(bits) < 36


@pytest.mark.parametrize("shingles", [1_000_000, 3_000])
def test_verified_duplicates_match_all_pairs(spark, monkeypatch, shingles):
    monkeypatch.setattr(simhash, "SHINGLES", shingles)
    monkeypatch.setattr(simhash, "MOST_SHINGLES", 2 * shingles)
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fp, sets = [plain_halves(t, 5) for _, t in rows], [set(simhash.shingles(t, 5).tolist()) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    bits = {(i, j): [(a ^ b).bit_count() for a, b in zip(fp[i], fp[j], strict=True)] for i, j in pairs}
    coarse = roots(range(len(rows)), [p for p in pairs if min(bits[p]) <= 10 and sum(bits[p]) <= 32])
    alike = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    links = [(i, j) for i, j in alike if coarse[i] == coarse[j] and sum(bits[i, j]) <= 32]
    assert len(links) >= 0.95 * len(alike)
    of = roots(range(len(rows)), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[of[i]] = min(least.get(of[i], d), d)
    assert {r.doc_id: r.component_id for r in simhash.verified_duplicates(docs).collect()} == {d: least[of[i]] for i, (d, _) in enumerate(rows)}


def test_verified_duplicates_of_awkward_rows(spark):
    got = {r.doc_id: r.component_id for r in simhash.verified_duplicates(awkward(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8}
    assert simhash.verified_duplicates(awkward(spark).limit(0)).count() == 0


def planted(bands, each, seed=3):
    """Pairs of texts of 60 to 400 words whose second one has words replaced at random places or at the end, and their similarities."""
    rng, texts, likeness = np.random.default_rng(seed), [], []
    for band in bands:
        for k in range(each):
            n = int(rng.integers(60, 400))
            words = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
            gone = max(1, round((n - 4) * (1 - band) / (1 + band)))
            other = [*words[: n - gone], *(f"o{x}" for x in rng.integers(0, 1 << 40, gone))]
            if k % 2:
                other = list(words)
                for i in rng.choice(n, max(1, gone // 5), replace=False):
                    other[i] = f"p{rng.integers(0, 1 << 40)}"
            texts += [" ".join(words), " ".join(other)]
            a, b = (set(simhash.shingles(t, 5).tolist()) for t in texts[-2:])
            likeness.append(len(a & b) / len(a | b))
    return texts, np.array(likeness)


def test_every_lone_pair_at_the_similarity_is_found(spark):
    texts, likeness = planted((0.78, 0.81, 0.84, 0.87, 0.91, 0.96), 500)
    got = {r.doc_id: r.component_id for r in simhash.verified_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)):
        assert ((likeness >= low) & (likeness < high)).sum() > 200
    assert got == {i: i - 1 if i % 2 and likeness[i // 2] >= 0.8 else i for i in range(len(texts))}


@pytest.mark.parametrize("block", [2, 7, 40])
def test_frequent_keys_are_dealt_out_in_blocks(spark, monkeypatch, block):
    """Groups far above a block, over many partitions, against all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHINGLES", 500)
    monkeypatch.setattr(simhash, "MOST_SHINGLES", 900)
    rng, rows = np.random.default_rng(9), []
    base = [[f"w{x}" for x in rng.integers(0, 1 << 40, 60)] for _ in range(4)]
    shared = [f"s{x}" for x in range(40)]
    for k in range(160):
        words = list(base[k % 4])
        for i in rng.choice(60, k % 3, replace=False):
            words[i] = f"x{rng.integers(0, 1 << 40)}"
        rows.append((k, " ".join(words if k % 5 else shared + [f"y{x}" for x in rng.integers(0, 1 << 40, 30)])))
    sets = [set(simhash.shingles(t, 5).tolist()) for _, t in rows]
    of = roots(range(160), [(i, j) for i in range(160) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    got = {r.doc_id: r.component_id for r in simhash.verified_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()}
    assert got == of and len(set(of.values())) < 80


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_first_shingles_meet(size):
    rng = np.random.default_rng(size)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 63, 3 * size, np.uint64))
        a = pool[:size]
        b = np.sort(np.append(rng.choice(a, size - size // 9, replace=False), pool[size : size + size // 9]))
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
        common = np.sort(rng.choice(pool, size))
        assert len(np.intersect1d(simhash._prefix(a, common, 0.8), simhash._prefix(b, common, 0.8)))


def test_rows_of_repeated_and_null_ids_are_compared_by_text(spark):
    one, two, three = (" ".join(f"{p}{k}" for k in range(60)) for p in "abc")
    rows = [(7, one, "x"), (7, two, "x"), (7, two, "x"), (7, three + " end", "x"), (3, three, "x"), (None, one, "x"), (None, one + " end", "x"), (None, "words of no other row", "x"), (None, "words of no other row", "x"), (9, None, "x"), (9, "", "x")]
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()]
    assert sorted((r[:2] for r in got if r[1]), key=repr) == sorted([(7, one), (7, two), (3, three), (None, "words of no other row")], key=repr)
    assert len(got) == 5


def by_hand(texts, similarity=0.8, within=None):
    """Smallest position reachable by links of similar texts; with ``within`` only inside components of fingerprints so close."""
    sets, fp = [set(simhash.shingles(t, 5).tolist()) for t in texts], [plain_fingerprint(t, 5) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    coarse = roots(range(len(texts)), [(i, j) for i, j in pairs if (fp[i] ^ fp[j]).bit_count() <= within]) if within is not None else dict.fromkeys(range(len(texts)))
    return roots(range(len(texts)), [(i, j) for i, j in pairs if coarse[i] == coarse[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])])


def test_the_pipeline_probes_fingerprints_and_verifies(spark, monkeypatch):
    """What the pigeonhole search links is in the result without the search for the rest, and the rest is added to it."""
    texts, plans, plan = planted((0.8, 0.84, 0.9, 0.97), 30, seed=8)[0], [], simhash.plan
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    monkeypatch.setattr(simhash, "plan", lambda *a: plans.append(plan(*a)) or plans[-1])
    kept = lambda: {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept() == set(by_hand(texts).values())
    assert [sum(t + 1 for t in thresholds) for _, thresholds in plans] == [simhash.RADIUS + 1]
    none = spark.createDataFrame([], "src long, dst long")
    monkeypatch.setattr(simhash, "_prefix_links", lambda *a: none)
    probed = set(by_hand(texts, within=simhash.RADIUS).values())
    assert kept() == probed and len(set(by_hand(texts).values())) < len(probed) < len(texts) - 30


@pytest.mark.parametrize("radius", [2, 8])
def test_rest_joins_what_probing_labelled(spark, monkeypatch, radius):
    """Chains of near copies, of which probing links some and the exact search the others, in groups of many blocks."""
    monkeypatch.setattr(simhash, "SHINGLES", 300)
    monkeypatch.setattr(simhash, "MOST_SHINGLES", 600)
    rng, texts = np.random.default_rng(12), []
    for _ in range(6):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 120)]
        for _ in range(20):
            texts.append(" ".join(words))
            words = list(words)
            for i in rng.choice(120, rng.integers(1, 4), replace=False):
                words[i] = f"x{rng.integers(0, 1 << 40)}"
    want = by_hand(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert {r.doc_id: r.component_id for r in simhash.verified_duplicates(docs, radius=radius).collect()} == want
    assert len(set(by_hand(texts, within=radius).values())) > len(set(want.values())) > 3


def shuffle_files(spark):
    got = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {x for x in got if "/shuffle_" in x}


def test_steps_free_their_shuffles(spark):
    r = random.Random(11)
    texts = [" ".join(r.choice("abcdefghij") * 3 + str(r.randrange(40)) for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame([(2 * i + k, t + tail) for i, t in enumerate(texts) for k, tail in enumerate(("", " x"))], "doc_id long, text string")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), shuffle_files(spark)
    got = simhash.drop_copies(docs)
    until = time.monotonic() + 5
    while (left := shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(key) == setting
    assert sorted(x.doc_id for x in got.collect()) == list(range(0, 120, 2))
