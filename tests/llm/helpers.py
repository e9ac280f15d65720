"""Brute-force counterparts and documents with every awkward case."""

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, block string"


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns whose names clash with inner ones."""
    long = "lorem ipsum dolor " * 40_000 + "x" * 100_000
    rows = [
        (1, "The cat sat on the mat and looked at the small bird. " * 6, "en", "a", 1, "q", 5, "b"),
        (1, "The cat sat on the mat and looked at the small bird. " * 6, "en", "a", 1, "q", 5, "b"),
        (2, "The cat sat on the mat and looked at the small bird. " * 6, "en", None, 1, "q", 5, "b"),
        (3, None, "en", "a", None, None, None, None),
        (4, "", None, "a", 0, "", 0, ""),
        (5, " \n\t ", "de", "b", 4, "", 0, ""),
        (6, long, "de", "b", len(long), "", 0, ""),
        (7, "### $$$ 123 456", None, None, 3, "", 0, ""),
        (8, "日本語 のテスト 🙂 ▁ Ünïcödé", "xx", "ü", 3, "", 0, ""),
        (None, "No id here but some words", "en", "a", 3, "", 0, ""),
        (None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def roots(nodes, links):
    """Smallest reachable node of every node."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}
