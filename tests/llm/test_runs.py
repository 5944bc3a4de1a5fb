import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from claimweir.llm.queries import op12_periodic_runs
from claimweir.llm.runs import Grammar, find_runs, grid, periodic_runs
from claimweir.llm.shared import table
from tests.llm.helpers import EDGES, documents


def plain_runs(words, least=12):
    """Sorted (start, period, length): every stretch of each period, the smallest period of equal stretches."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e - s) for (s, e), q in found.items())


def plain_row(doc_id, text):
    """A row of op12 by its definition."""
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    dropped = {i for s, q, length in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    four = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def drawn(draw):
    kinds, n = draw.choice([1, 2, 3, 30]), draw.choice([0, 1, 5, 12, 40, 150])
    words = [draw.randrange(kinds) for _ in range(n)]
    if n and draw.random() < 0.5:
        a = draw.randrange(n)
        p = draw.randint(1, n - a)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words + words + words[: draw.randint(0, n)] if draw.random() < 0.3 else words


def test_runs_equal_brute_force():
    draw = random.Random(1)
    for _ in range(150):
        texts, least = [drawn(draw) for _ in range(draw.randint(1, 12))], draw.choice([12, 12, 2, 4, 5])
        with np.errstate(over="ignore"):
            text, start, length, period = find_runs([np.array(t, np.int64) for t in texts], least)
        for i, words in enumerate(texts):
            here = text == i
            assert list(zip(start[here].tolist(), period[here].tolist(), length[here].tolist(), strict=True)) == plain_runs(words, least)


def test_extensions_equal_a_plain_comparison():
    draw = random.Random(4)
    texts = [[draw.randrange(2) for _ in range(200)], [7] * 90, [1, 2, 3] * 50, list(range(60))]
    symbols = [-1]
    for k, t in enumerate(texts):
        symbols += [*t, -2 - k]
    with np.errstate(over="ignore"):
        grammar = Grammar(np.array(symbols))
    assert max(len(s) for s in grammar.symbols[-1:]) <= 9 * (len(texts) + 1)
    pairs = [(x, y) for x in range(0, len(symbols), 3) for y in range(x + 1, len(symbols), 7) if all(s >= 0 for s in symbols[x : y + 1])]
    x, y = (np.array(c) for c in zip(*pairs, strict=True))
    for step in (1, -1):
        for a, b, n in zip(x, y, grammar.extension(x, y, step), strict=True):
            plain = 0
            while symbols[a + plain * step] == symbols[b + plain * step]:
                plain += 1
            assert n == plain


def test_the_grid_meets_every_period_in_pieces(monkeypatch):
    whole = [np.concatenate(c) for c in zip(*grid(500, 12), strict=True)]
    monkeypatch.setattr("claimweir.llm.runs.CANDIDATES", 40)
    parts = list(grid(500, 12))
    assert len(parts) > 20 and all((np.concatenate(c) == w).all() for c, w in zip(zip(*parts, strict=True), whole, strict=True))
    assert set(whole[1]) == set(range(1, 251)) and (whole[0] + whole[1]).max() < 500


def test_small_pieces_do_not_change_runs(monkeypatch):
    draw = random.Random(8)
    texts = [np.array(drawn(draw), np.int64) for _ in range(60)]
    with np.errstate(over="ignore"):
        whole = find_runs(texts)
        monkeypatch.setattr("claimweir.llm.runs.CANDIDATES", 25)
        assert all((a == b).all() for a, b in zip(whole, find_runs(texts), strict=True))


def test_query_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, sf).collect()}
    assert found == {r.doc_id: plain_row(r.doc_id, r.text) for r in docs}
    assert sum(r[1] > 0 for r in found.values()) > 10


def test_edges(spark):
    rows = [*EDGES, (20, "a b " * 40_000 + "c", "en", "a"), (21, "x " * 11, "en", "a"), (22, "x\x0b" * 12, "en", "a"), (23, "ü é " * 12, None, None)]
    docs = documents(spark, rows).withColumn("runs", F.lit("clash"))
    found = {r.doc_id: r for r in periodic_runs(docs).collect()}
    runs = {i: [tuple(x) for x in r.runs] for i, r in found.items()}
    assert runs[3] == [(0, 30_000, 1)] and found[3].collapsed == "word"
    assert runs[20] == [(0, 80_000, 2)] and found[20].collapsed == "a b c" and found[20].n_words == 80_001
    assert runs[21] == [] and found[21].collapsed == " ".join("x" * 11)
    assert runs[22] == [(0, 12, 1)] and runs[23] == [(0, 12, 1)] and found[23].collapsed == "ü é"
    for i in (1, 2, 6):
        assert (found[i].n_words, runs[i], found[i].collapsed) == (0, [], "")
    assert found[None].n_words == 6 and found[None].collapsed == "one two three four five six"
    assert periodic_runs(docs).count() == len(rows)
    assert periodic_runs(docs.filter("false")).collect() == []
