import hashlib
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from claimweir.llm import align
from claimweir.llm.align import Aligner, align_tokens, units
from claimweir.llm.perfect_hash import PerfectHash
from claimweir.llm.queries import op11_token_alignment
from claimweir.llm.shared import table
from tests.llm.helpers import EDGES, documents

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    """(ids of A, ids of B, links, groups) of a whole text, without cutting it into units."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    char = {c: i for i, c in enumerate(_alphabet())}

    def tokens(text):
        if not text:
            return [], [], [], ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(char[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return [], [], [], ""
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        begin_a, begin_b = (np.concatenate([[0], e[:-1]]) for e in (ends_a, ends_b))
        links = np.argwhere(np.maximum.outer(begin_a, begin_b) < np.minimum.outer(ends_a, ends_b)).tolist()
        groups, x, y = [], 0, 0
        for cut in np.intersect1d(ends_a, ends_b):
            i, j = np.searchsorted(ends_a, cut) + 1, np.searchsorted(ends_b, cut) + 1
            groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
            x, y = i, j
        return ids_a, ids_b, [(ids_a[i], ids_b[j]) for i, j in links], ";".join(groups)

    return tokens


def _alphabet():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def plain_rows(rows, tokens):
    found = [(i, *tokens(t)) for i, t in rows]
    counts = Counter(p for r in found for p in r[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(i, len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), g) for i, a, b, links, g in found]


TEXTS = [
    "plain words, here", " leading", "trailing ", "two  spaces   three", "line\nbreak \n and\ttab", "nul \x00 and \x1c sep", "a▁b", "▁", " ", "   ", "\n", "<s>x</s><unk> <|endoftext|>",
    "don't you'll I'M", "über Straße naïve", "数字と漢字 🙂🙂 mixed", "1234567 89,01 3.14", " em space nbsp", "x" * 300, "é combining ́ alone", ");\r\n{\r", "a" + " " * 40 + "b", "", None,
]


def test_tokens_by_units_are_those_of_whole_texts(plain):
    tokenizers = Aligner(A, B)
    draw = random.Random(1)
    some = ["".join(draw.choice("ab '’sS1²½ \n\t\r\x0b\x1c\x85\xa0 é\u0301字🙂Ⅷ_-.!?\u200b\x00▁<|>") for _ in range(draw.randint(0, 12))) for _ in range(3_000)]
    for text in [*TEXTS, *some]:
        found = tokenizers.align(units(text or ""), with_groups=True)
        a, b, links, groups = plain(text)
        if not found.right.all():
            assert not a, text
            continue
        assert (found.n_a.sum(), found.n_b.sum()) == (len(a), len(b)), text
        assert ";".join(found.groups) == groups
        assert [(int(k) >> align.B_BITS, int(k) & ((1 << align.B_BITS) - 1)) for k in found.links] == links


@pytest.mark.parametrize("text", [" " * 400_000 + "a", "a" * 400_000, "字" * 100_000, "!" * 400_000, "\n" * 400_000, "a b" * 200_000])
def test_long_runs_end(text):
    began = time.perf_counter()
    found = Aligner(A, B).align(units(text))
    assert time.perf_counter() - began < 20 and (not found.right.all() or found.n_a.sum() > 0)


def test_perfect_hash_is_minimal_and_verified():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 5_000):
        keys = np.unique(draw.integers(0, 1 << 40, n))
        made = PerfectHash.from_bytes(*PerfectHash.of(keys).to_bytes())
        assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(draw.integers(0, 1 << 40, 2_000), keys)
        assert (made.slots(others) == -1).all()
    assert len(made.words) * 64 < 6 * 5_000


def test_query_equals_brute_force(spark, sf, plain):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect() if len(r.text or "") < 4_000]
    whole = {r[0]: r for r in plain_rows(docs, plain)}
    import tempfile

    folder = tempfile.mkdtemp(prefix="align-")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id: tuple(r) for r in op11_token_alignment(spark, folder).collect()}
    assert found == {i: (*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for i, r in whole.items()}


def test_small_chunks_ranges_and_a_tree_of_vectors_give_the_same(spark, plain, monkeypatch):
    for name, value in (("CHUNK_BYTES", 60), ("RANGE_PAIRS", 40), ("FAN", 2)):
        monkeypatch.setattr(align, name, value)
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "plain words, here"), (3, "plain words, here"), (3, "plain words, here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit("x"), "keys": F.lit(1)}).repartition(5)
    found = sorted((tuple(r) for r in align_tokens(docs, A, B).collect()), key=str)
    assert found == sorted(plain_rows(rows, plain), key=str)


def test_edges(spark, plain):
    docs = documents(spark, [r for r in EDGES if r[0] != 3])
    found = sorted((tuple(r) for r in align_tokens(docs, A, B).collect()), key=str)
    assert found == sorted(plain_rows([(r[0], r[1]) for r in EDGES if r[0] != 3], plain), key=str)
    long = documents(spark, [(1, "word other " * 100_000, "en", "a"), (2, None, "en", "a")])
    first, second = sorted(align_tokens(long, A, B).collect())
    assert (first.n_a, first.n_b, first.n_groups, first.n_links, first.n_best, first.count_sum) == (200_001, 200_001, 200_001, 200_001, 200_001, 2 * 100_000**2 + 1)
    assert tuple(second)[1:] == (0, 0, 0, 0, 0, 0, "")
    assert align_tokens(docs.filter("false"), A, B).collect() == []
