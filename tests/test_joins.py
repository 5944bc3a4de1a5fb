import random

from pyspark.sql import functions as F

from claimweir.operators.latest import latest_by_key
from claimweir.operators.lookup import SMALL_ROWS, FrequentKeys, is_small, lookup_join
from claimweir.operators.numbering import number_rows
from claimweir.operators.star import build_star, unnumbered_mart
from claimweir.sources.staging import stage
from verification import bindings as b


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_hot_keys_join_like_any_other(spark):
    draw = random.Random(1)
    facts = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{draw.randrange(50)}") for i in range(3000)]
    lookup = [("hot", "a"), ("hot", "b"), (None, "n"), *[(f"k{i}", str(i)) for i in range(40)]]
    left = spark.createDataFrame(facts, "id long, key string")
    right = spark.createDataFrame(lookup, "key string, value string")
    for how in ("inner", "left"):
        want = rows_of(left.join(right, "key", how))
        assert rows_of(lookup_join(left, right, ["key"], how)) == want
        spread = lookup_join(left, right, ["key"], how, small_rows=0, hot_rows=100, copies=8)
        assert rows_of(spread) == want


def test_hot_key_rows_leave_their_single_partition(spark):
    left = spark.range(4000).select("id", F.lit("hot").alias("key"))
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "key string, value long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(left, right, ["key"], small_rows=0, hot_rows=10, copies=16)
        parts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in parts) == 4000
    assert max(r["count"] for r in parts) < 2000


def test_one_scan_finds_the_frequent_keys_of_all_sets(spark):
    rows = [(f"a{min(i % 100, 60)}", i % 7, None if i % 2 else "x") for i in range(7_000)]
    table = spark.createDataFrame(rows, "a string, b long, c string").repartition(6)
    keys = FrequentKeys(table, [["a"], ["b", "c"]], 900)
    hashes = {tuple(r)[:2]: r[2] for r in table.selectExpr("'a'", "a", "xxhash64(a)").distinct().collect()}
    found = {r._key: r._parts for r in keys.of(["a"]).collect()}
    assert found == {hashes["a", "a60"]: 4}  # 2,800 rows
    scanned = keys._found
    assert keys.of(["b", "c"]).count() == 0 and keys._found is scanned
    assert FrequentKeys(table, [["b", "c"]], 400).of(["b", "c"]).count() == 14
    assert FrequentKeys(table, [["a"]]).of(["a"]).count() == 0


def test_a_lookup_is_small_by_rows_and_by_bytes(spark):
    wide = spark.range(100).selectExpr("id", "repeat('x', 1000) AS text", "array(id, id) AS parts", "CAST(NULL AS string) AS none")
    assert is_small(wide) and not is_small(wide, rows=99) and not is_small(wide, size=100_000) and is_small(wide.limit(0), size=0)
    assert SMALL_ROWS == 200_000


def test_numbers_follow_the_order(spark):
    draw = random.Random(2)
    values = [(draw.choice([None, "a", "b", "same"]), i) for i in range(2000)]
    draw.shuffle(values)
    frame = spark.createDataFrame(values, "name string, id long").repartition(7)
    want = sorted(values, key=lambda v: (v[0] is None, v[0] or "", v[1]))
    got = number_rows(frame, ["name", "id"], "n").orderBy("n").collect()
    assert [(r["name"], r["id"]) for r in got] == want
    assert [r["n"] for r in got] == list(range(1, 2001))


def test_latest_row_of_a_key(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(20), draw.randrange(100), i, [i]) for i in range(1000)]
    frame = spark.createDataFrame(rows, "key long, ts long, id long, payload array<long>")
    want = {}
    for row in rows:
        if row[0] not in want or row[1:3] > want[row[0]][1:3]:
            want[row[0]] = row
    assert rows_of(latest_by_key(frame, ["key"], ["ts", "id"])) == sorted(want.values(), key=repr)


def test_star_is_the_same_on_the_large_table_path(spark, sf):
    silver = stage(b.silver(spark, sf), "silver")
    small = build_star(silver, b.at())
    large = build_star(silver, b.at(), small_rows=0, hot_rows=5)
    for name, table in small.tables().items():
        assert rows_of(table) == rows_of(large.tables()[name]), name
    fewer = small.claims_analytical_mart.drop("claim_key", "gold_load_timestamp")
    assert rows_of(unnumbered_mart(silver)) == rows_of(fewer)
    assert rows_of(unnumbered_mart(silver, small_rows=0, hot_rows=5)) == rows_of(fewer)


def test_two_addresses_repeat_claims_unless_asked_otherwise(spark, sf):
    silver = stage(b.silver(spark, sf).filter("claimant_ppsn_hash is not null"), "silver")
    first = silver.limit(1)
    other = first.withColumn("claimant_email_masked", F.lit("o***r@else.ie")).withColumn("claim_id", F.lit("CLM-X"))
    both = stage(first.unionByName(other), "both")
    assert build_star(both).fact_claims.count() == 4
    single = build_star(both, one_row_per_hash=True)
    assert single.fact_claims.count() == 2 and single.dim_claimant.count() == 1


def test_gold_reads_silver_without_narratives(spark, sf):
    read = b.gold_input(spark, sf)
    assert not {"incident_description_clean", "statutory_attestation"} & set(read.columns)
    want = build_star(b.silver(spark, sf).cache(), b.at()).fact_claims
    got = build_star(read, b.at()).fact_claims
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
