"""Masks against their plain patterns."""

import random

from pyspark.sql import functions as F

from claimweir import fixed
from claimweir.functions import pii
from claimweir.functions.text import WHITE, strip


def test_narratives_and_names_are_masked_as_by_the_plain_patterns(spark):
    draw = random.Random(5)
    parts = ["+353", " ", "-", "083", "1234567", "123", "4567", "T", "a.b", "@", "x.ie", ".", "%", "é", "١٢٣", "_", "Mr.", "\x1c", "\n", "0", "9", "Al"]
    texts = [None, "", *("".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(4000))]
    text = F.col("text")
    plain = F.coalesce(text, F.lit(""))
    for pattern, word in ((fixed.PPSN_IN_TEXT, fixed.PPSN_REDACTED), (fixed.EMAIL_IN_TEXT, fixed.EMAIL_REDACTED), (fixed.PHONE_IN_TEXT, fixed.PHONE_REDACTED)):
        plain = F.regexp_replace(plain, f"(?U){pattern}", word)
    words = F.array_join(F.transform(F.split(strip(text), f"[{WHITE}]+"), lambda w: F.when(F.lower(w).isin(fixed.NAME_TITLES), w).otherwise(F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), F.greatest(F.char_length(w) - 1, F.lit(1)))))), " ")
    made = spark.createDataFrame([(t,) for t in texts], "text string").select(
        text, pii.sanitize_narrative(text).alias("a"), plain.alias("b"), pii.mask_name(text).alias("c"), F.when(F.coalesce(strip(text) == "", F.lit(True)), fixed.NAME_REDACTED).otherwise(words).alias("d")
    )
    rows = made.collect()
    assert [r for r in rows if r.a != r.b or r.c != r.d] == [] and sum(r.a != r.text for r in rows) > 500
    # a split at a pattern would compile it for every name
    assert f"split(btrim(text, {WHITE})" not in made.select("c")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?=[+\\d])" in made.select("a")._jdf.queryExecution().analyzed().toString()
