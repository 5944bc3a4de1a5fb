"""Brute-force versions that the operators are compared with."""

from pyspark.sql import functions as F


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


class Groups:
    def __init__(self, ids):
        self.parent = {i: i for i in ids}

    def of(self, i):
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, a, b):
        a, b = self.of(a), self.of(b)
        self.parent[max(a, b)] = min(a, b)


def jaccard_groups(texts, k, num, den):
    """{id: (size of its set, smallest id reachable)} of (id, text) rows."""
    sets = {i: shingles(t, k) for i, t in texts}
    groups, lists = Groups(sets), {}
    for i, own in sets.items():
        for g in own:
            lists.setdefault(g, []).append(i)
    for i, own in sets.items():
        common = {}
        for g in own:
            for j in lists[g]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if den * n >= num * (len(own) + len(sets[j]) - n):
                groups.link(i, j)
    return {i: (len(own), groups.of(i)) for i, own in sets.items()}


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with an extra column of a name that operators use inside."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.withColumns({"n": F.lit("x"), "component": F.lit(1), "bucket": F.lit(None).cast("string")})


#: Nulls everywhere, empty and long texts, ties, a repeated row.
EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, "word " * 30_000, None, "a"),
    (4, "one two three four five six", "en", "b"),
    (4, "one two three four five six", "en", "b"),
    (5, "ONE two\tthree\nfour five six", "de", "b"),
    (6, " \t\n", None, None),
    (None, "one two three four five six", "en", "b"),
    (7, "short", "fr", "c"),
    (8, "12 34 !!", None, ""),
]
