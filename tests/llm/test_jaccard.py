import random

import numpy as np
import pyarrow as pa
import pytest

from claimweir.llm.bits import bit_array
from claimweir.llm.components import components
from claimweir.llm.jaccard_join import FREQUENT, FREQUENT_ROOM, LOW, Places, bits_apart, choose_boundary, jaccard_join, least_common, parity_of, place_bits, subset_sizes, tokens_of, wants_more
from claimweir.llm.shared import Scratch, arrow_rows, table
from claimweir.llm.shingles import joined, shingle_sets, word_hashes
from tests.llm.helpers import EDGES, Groups, documents, jaccard_groups, words


def test_words_and_shingles_are_those_of_a_plain_split():
    texts = ["A b\x0bC d e", None, "", "über Über ÜBER x", "x" * 5_000_000 + " y", "a b c d e"]
    hashes, bounds = word_hashes(texts)
    assert [b - a for a, b in zip(bounds[:-1], bounds[1:], strict=True)][:4] == [len(words(t)) for t in texts[:4]]
    own = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert (own[0] == own[5]).all()
    assert own[3][1] == own[3][2] != own[3][0]
    assert len({int(h) for h in own[0]}) == 5
    sets = shingle_sets(["a b c", "A  b c", "a b c a b c", "a b"], 3, True)
    assert (sets[0] == sets[1]).all() and len(sets[2]) == 3 and len(sets[3]) == 1
    assert len(joined(own[0], 6)) == 0


def test_a_word_longer_than_the_window_is_one_word():
    texts = ["A b\x0bC d e", None, "über Über ÜBER x", "x" * 5_000_000 + " y", "a b c d e", "z " + "X" * 5_000_000, "q" * ((1 << 19) + 1), "q" * (1 << 19) + " q"]
    hashes, bounds = word_hashes(texts)
    assert np.diff(bounds).tolist() == [len(words(t)) for t in texts]
    own = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert own[3][0] == own[5][1] and own[6][0] != own[7][0] != own[7][1]
    assert all((word_hashes([t])[0] == x).all() for t, x in zip(texts, own, strict=True))


def test_windows_do_not_change_hashes(monkeypatch):
    texts = ["hello worldwideweb x", "abcdefghijklmnopqrstuvw", None, "seven77 seven7 eight888  "]
    whole = word_hashes(texts)
    monkeypatch.setattr("claimweir.llm.shingles._powers", {})
    monkeypatch.setattr("claimweir.llm.shingles.WINDOW", 7)
    for x, y in zip(whole, word_hashes(texts), strict=True):
        assert (x == y).all()


def test_similar_sets_share_a_token():
    draw = random.Random(3)
    nothing = np.zeros(1 << 10, np.uint8)
    some = np.random.default_rng(1).integers(0, 256, 1 << 10).astype(np.uint8)
    everything = Places(~nothing, ~nothing)
    for _ in range(400):
        num, den = draw.choice([(85, 100), (8, 10)])
        boundary = draw.choice([0, 6, 9, 14])
        base = [draw.getrandbits(64) for _ in range(draw.randint(1, 40))]
        other = [x for x in base if draw.random() > 0.08] + [draw.getrandbits(64) for _ in range(draw.randint(0, 2))]
        a, b = (np.unique(np.array(x, np.uint64)) for x in (base, other))
        both = len(np.intersect1d(a, b))
        if len(b) and den * both >= num * (len(a) + len(b) - both):
            assert bits_apart([parity_of(a)], [parity_of(b)])[0] <= len(a) + len(b) - 2 * both
            for frequent in (Places(nothing, nothing), everything, Places(some, some), Places(some, nothing)):
                (x, i), (y, j) = (tokens_of(s, boundary, num, den, everything, frequent) for s in (a, b))
                mine, theirs = (dict(zip(t.tolist(), p.tolist(), strict=True)) for t, p in ((x, i), (y, j)))
                need = num * (len(a) + len(b))
                # of the tokens that both have, one stands early enough in either
                assert any(min(len(a) - mine[t], len(b) - theirs[t]) * (num + den) >= need for t in mine.keys() & theirs.keys()), (len(a), len(b), boundary)


def test_parity_sketches_of_different_sizes_bound_the_difference():
    draw = np.random.default_rng(6)
    a = np.unique(draw.integers(0, 1 << 63, 4200).astype(np.uint64))
    b = np.unique(np.concatenate([a[:4000], draw.integers(0, 1 << 63, 60).astype(np.uint64)]))
    c = np.unique(draw.integers(0, 1 << 63, 3900).astype(np.uint64))
    sketches = [parity_of(x) for x in (a, b, c)]
    assert [len(s) for s in sketches] == [1024, 512, 512] and len(parity_of(a[:0])) == 128
    near, far = bits_apart([sketches[0], sketches[0]], [sketches[1], sketches[2]])
    assert near <= len(np.setxor1d(a, b)) and far > 1500


def test_places_are_the_same_in_spark_and_in_numpy(spark):
    hashes = np.unique(np.random.default_rng(4).integers(0, 1 << 64, 4_000, dtype=np.uint64))
    rows = spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "shingle long")
    bits, low = place_bits(100), hashes < LOW
    assert place_bits(0) == place_bits(100) == 20 and place_bits(1 << 20) == 24 and place_bits(1 << 60) == 28
    half = [bit_array(rows.filter(f"pmod(shingle, 2) = 0 AND ({side})").select(Places.column(is_low, bits)), 1 << bits) for is_low, side in ((True, f"shingle >= 0 AND shingle < {int(LOW)}"), (False, f"shingle < 0 OR shingle >= {int(LOW)}"))]
    assert low.sum() > 800
    found = Places(*half).has(hashes)
    assert found[hashes % 2 == 0].all() and found[hashes % 2 == 1].mean() < 0.02


def test_prefixes_of_sets_with_many_frequent_shingles_hold_few_of_them():
    draw = np.random.default_rng(9)
    base = np.unique(draw.integers(0, 1 << 64, 400, dtype=np.uint64))
    own = np.unique(np.concatenate([base, draw.integers(0, 1 << 64, 80, dtype=np.uint64)]))
    arrays = []
    for side in (base[base < LOW], base[base >= LOW]):
        bits = np.zeros(1 << 20, bool)
        shift = 62 - 20 if len(side) and side[0] < LOW else 64 - 20
        bits[(side >> np.uint64(shift)).astype(int)] = True
        arrays.append(np.packbits(bits, bitorder="little"))
    frequent, everything = Places(*arrays), Places(*(np.full(1 << 17, 255, np.uint8),) * 2)
    assert wants_more(own, 10, 85, 100, frequent) and not wants_more(np.setdiff1d(own, base), 10, 85, 100, frequent)
    tokens, at = tokens_of(own, 10, 85, 100, everything, frequent)
    assert len(tokens) == 73 and not np.isin(tokens, base).any() and (at == np.arange(73)).all()
    assert FREQUENT == 16


def test_boundary_follows_cost():
    assert choose_boundary(85, 100, 1.0) <= choose_boundary(85, 100, 50.0) <= choose_boundary(85, 100, 5000.0)
    assert least_common(6, 7, 85, 100) == 6
    assert (6, 7, 6) in subset_sizes(6, 10, 85, 100)


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 8, 10)])
def test_join_equals_brute_force(spark, sf, k, num, den):
    docs = table(spark, sf, "documents")
    found = {r[0]: (r[1], r[2]) for r in jaccard_join(docs, k, num, den).collect()}
    assert found == jaccard_groups([(r.doc_id, r.text) for r in docs.collect()], k, num, den)


def test_join_of_near_copies_and_shared_passages_equals_brute_force(spark):
    draw = random.Random(5)
    word = lambda: "w%d" % draw.randint(0, 3000)
    passage, base = [word() for _ in range(25)], [word() for _ in range(60)]
    rows = []
    for i in range(260):
        if i % 3 == 0:
            text = [w if draw.random() > 0.012 else word() for w in base]
        elif i % 3 == 1:
            text = [word() for _ in range(draw.randint(0, 30))] + passage
        else:
            text = [word() for _ in range(draw.randint(1, 9))] * draw.randint(1, 2)
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, rows[i % 9][1]) for i in range(90)]
    rows += [(2000 + i, " ".join(["p", "q", "r", "s"][: draw.randint(1, 4)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for k, num, den in ((4, 85, 100), (5, 8, 10)):
        found = {r[0]: (r[1], r[2]) for r in jaccard_join(docs, k, num, den).collect()}
        assert found == jaccard_groups(rows, k, num, den)


def test_join_edges(spark):
    docs = documents(spark, EDGES)
    found = sorted(((r[0], r[1], r[2]) for r in jaccard_join(docs, 4, 85, 100).collect()), key=lambda r: (r[0] is None, r))
    assert found == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 3, 4), (4, 3, 4), (5, 3, 4), (6, 0, 6), (7, 1, 7), (8, 1, 8), (None, 3, None)]
    assert jaccard_join(docs.filter("false")).collect() == []


def test_components_of_chains_and_stars(spark):
    draw = random.Random(1)
    chain = list(range(300))
    draw.shuffle(chain)
    links = [(a, b) for a, b in zip(chain, chain[1:], strict=False)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    groups = Groups({x for link in links for x in link})
    for a, b in links:
        groups.link(a, b)
    found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    assert {r.id: r.component for r in found.collect()} == {i: groups.of(i) for i in groups.parent if i != 5000}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []


def test_batches_that_go_to_python_are_small_inside_only(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def most():
        count = spark.range(0, 5_000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
        return max(r.n for r in count.collect())

    with pytest.raises(ValueError), arrow_rows(spark, 1_000):
        assert most() <= 1_000
        raise ValueError
    assert spark.conf.get(name) == before and most() > 1_000
    with arrow_rows(spark, 10**9):
        assert spark.conf.get(name) == before


def test_the_join_sends_small_batches(spark, monkeypatch):
    seen = set()
    own = Scratch.write

    def write(self, frame):
        seen.add(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return own(self, frame)

    monkeypatch.setattr(Scratch, "write", write)
    assert jaccard_join(documents(spark, EDGES[3:6]), k=4).count() == 3
    assert seen and max(seen) <= 1_000


def test_few_frequent_places_take_few_bits():
    assert place_bits(10_000_000, FREQUENT_ROOM) <= 28 and place_bits(1_000, FREQUENT_ROOM) == 20 < place_bits(1_000_000)
