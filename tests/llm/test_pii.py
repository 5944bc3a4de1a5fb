import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweir.llm.boosting import bin_edges, calibrated, fit_trees, threshold
from claimweir.llm.pii import CARD, EMAIL, IP, KINDS, PHONE, Recogniser, base_spans, candidates, find_personal_data, rewritten, train_recogniser
from claimweir.llm.queries import op13_personal_data
from claimweir.llm.shared import table
from tests.llm.helpers import EDGES, documents

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain_spans(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            right = (
                kind == EMAIL
                or kind == IP and all(int(p) <= 255 for p in m.group().split("."))
                or kind == CARD and 14 <= len(digits) <= 19 and plain_luhn(digits)
                or kind == PHONE and 10 <= len(digits) <= 15
            )
            if right:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_plain_forms_are_those_of_the_patterns():
    draw = random.Random(5)
    parts = ["a.b@c.d", "@", "x@y", "e.f_g@h.i-j.k", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111111", "+1 (743) 555-3824", "+12", "+1234567890", " ", "  ", "-", ".", "+", "word", "é", "9", "00", "🙂", "%", "_"]
    for _ in range(4_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert base_spans(text) == plain_spans(text), text
    for _ in range(4_000):
        text = "".join(draw.choice("a1.@+- 42(5)%") for _ in range(draw.randint(0, 40)))
        assert base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1 " * 60_000, "1." * 60_000, "a@" * 100_000, "+1" * 100_000, "a.b@c." * 50_000, "+1" + " " * 200_000, "(1) " * 50_000, " at" * 100_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.perf_counter()
    base_spans(text)
    candidates(text)
    assert time.perf_counter() - began < 8


def test_trees_learn_and_are_calibrated():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(6_000, 4))
    chance = 1 / (1 + np.exp(-4 * (x[:, 0] * x[:, 1] > 0.2) + 2))
    y = (draw.random(6_000) < chance).astype(float)
    model = calibrated(fit_trees(x[:4_000], y[:4_000]), x[4_000:5_000], y[4_000:5_000])
    found, truth = model.chance(x[5_000:]), chance[5_000:]
    assert ((found > 0.5) == (truth > 0.5)).mean() > 0.9
    for low, high in ((0, 0.3), (0.3, 0.7), (0.7, 1)):
        near = (found >= low) & (found < high)
        assert abs(found[near].mean() - truth[near].mean()) < 0.1


def test_bin_edges_of_counts_are_those_of_the_rows():
    x = np.random.default_rng(4).geometric(0.05, (5_000, 3)).astype(float)
    counts = np.stack([np.bincount(column.astype(int), minlength=1024) for column in x.T])
    for got, column in zip(bin_edges(counts), x.T, strict=True):
        assert (got == np.unique(np.quantile(column, np.linspace(0, 1, 32)[1:-1], method="lower"))).all()


def test_every_text_counts_for_the_recogniser(spark):
    """Far more texts than 4,000; only those that such a choice by hash leaves out have addresses."""
    texts = spark.range(9_000).select(F.concat(F.lit("word "), "id").alias("text"))
    ordered = [r.text for r in texts.orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 32))).collect()]
    late = [(f"mail {t.split()[1]} to anna.b{i}@mail{i % 7}.example.org or 10.{i % 250}.3.4 today",) for i, t in enumerate(ordered[8_000:])]
    late = [r for r, h in zip(late, spark.createDataFrame(late, "text string").select(F.pmod(F.xxhash64("text"), F.lit(1 << 32)).alias("h")).collect(), strict=True) if h.h > 0.6 * (1 << 32)]
    model = train_recogniser(spark.createDataFrame([(t,) for t in ordered[:8_000]] + late, "text string"))
    assert model.trees is not None


def test_threshold_holds_its_precision():
    p = np.array([0.9, 0.8, 0.8, 0.7, 0.6, 0.3])
    y = np.array([1, 1, 0, 1, 0, 1])
    assert (threshold(p, y, 0.99), threshold(p, y, 0.7), threshold(p, 0 * y, 0.5)) == (pytest.approx(0.85), pytest.approx(0.65), 1.01)
    assert threshold(p[:1], y[:1], 0.99) == 0.5
    assert threshold(np.empty(0), np.empty(0), 0.9) == 1.01


@pytest.fixture(scope="module")
def model(spark):
    return train_recogniser(table(spark, "/root/testdata/sf0.1", "documents"))


def test_rewritten_data_is_found_and_lookalikes_are_left(spark, model):
    """Held out: spans and surroundings that the model has not seen."""
    draw = random.Random(11)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    right, wrong, hit, false = 0, 0, 0, 0
    while right < 400 or wrong < 400:
        body = "4" + digits(14)
        card = next(body + str(c) for c in range(10) if plain_luhn(body + str(c)))
        span = [f"{draw.choice(['anna', 'li.wu', 'kim_9'])}{draw.randint(1, 99)}@mail{draw.randint(1, 9)}.example.{draw.choice(['org', 'com', 'net'])}", ".".join(str(draw.randint(1, 255)) for _ in range(4)), card, f"+{draw.randint(1, 99)} ({draw.randint(200, 999)}) 555-{digits(4)}"]
        kind = draw.randrange(4)
        form, good = rewritten(kind, span[kind], draw.getrandbits(30))
        text = f"{draw.choice(['call', 'see', 'from the', 'und der'])} {form} {draw.choice(['today', 'ereth on', 'le temps'])}"
        at = (text.index(form), kind, text.index(form) + len(form))
        if at in base_spans(text):
            continue
        found = [s[:3] for s in model.find(text)]
        right, wrong, hit, false = right + good, wrong + (not good), hit + (good and at in found), false + (not good and any(s[1] == kind and s not in base_spans(text) for s in found))
    assert hit / right > 0.9 and false / wrong < 0.05, (hit / right, false / wrong)


def test_clean_texts_have_none(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    clean = [r.text for r in docs if r.text and not plain_spans(r.text)]
    assert sum(bool(model.find(t)) for t in clean) <= 0.01 * len(clean)


def test_plain_forms_stay_and_selected_spans_overlap_nothing(spark, model):
    for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect():
        text = (r.text or "")[:20_000] + " 4111 1111 1111 1112 (310) 555-4510, ann (at) mail.example.org"
        found = model.find(text)
        assert [s[:3] for s in found if s[3] is None] == plain_spans(text)
        for s in found:
            assert s[3] is None or not any(o is not s and o[0] < s[2] and s[0] < o[2] for o in found)


def test_query_has_the_plain_forms_of_all_documents(spark, sf):
    found = {r.doc_id: r for r in op13_personal_data(spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert set(found) == {r.doc_id for r in docs}
    for r in docs:
        spans = plain_spans(r.text or "")
        line = [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
        own = found[r.doc_id]
        assert [own[f"n_{k}"] for k in KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert own.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert set(line) <= set(own.spans.split(",")) | {""}


def test_edges(spark, model):
    rows = [*EDGES, (30, "é🙂 a@b.c +1 (743) 555-3824", "en", "a"), (31, "x " * 200_000 + "a@b.c", "en", "a")]
    docs = documents(spark, rows).withColumn("spans", F.lit("clash"))
    found = {r.doc_id: r for r in find_personal_data(docs, model, redacted=True).collect()}
    assert [(s.kind, s.start, s.end, s.chance) for s in found[30].spans] == [("email", 3, 8, None), ("phone", 9, 26, None)]
    assert found[30].redacted == "é🙂 [EMAIL] [PHONE]"
    assert [(s.start, s.end) for s in found[31].spans] == [(400_000, 400_005)]
    assert found[1].spans == [] and found[1].redacted is None and found[2].redacted == "" and found[None].spans == []
    assert find_personal_data(docs, model).count() == len(rows)
    assert find_personal_data(docs.filter("false"), model).collect() == []
    empty = train_recogniser(docs.filter("false"))
    assert empty == Recogniser(None) and [s[:3] for s in empty.find("a@b.c")] == [(0, EMAIL, 5)]
    assert train_recogniser(documents(spark, EDGES)).trees is None
