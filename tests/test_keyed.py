import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweir.sources import keyed, lake
from claimweir.sources.keyed import ConcurrentCommit, KeyedTable, bucket_of, home

SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("amount", T.LongType()), T.StructField("parts", T.ArrayType(T.StringType()))])


def table(spark, path, bucket_bytes=2_000, kind="parquet"):
    return KeyedTable(spark, str(path), SCHEMA, kind, lambda: F.col("name"), bucket_bytes)


def rows(spark, content):
    return spark.createDataFrame([(k, v, [str(v)] * 3) for k, v in content.items()], SCHEMA)


def content(found):
    read = found.collect()
    assert len({r.name for r in read}) == len(read)
    return {r.name: r.amount for r in read}


def test_keys_move_only_into_new_buckets(spark):
    hashes = spark.range(2_000).select(F.xxhash64("id").alias("h"))
    sizes = [1, 2, 3, 5, 8, 9, 16, 31]
    placed = hashes.select(*[bucket_of(F.col("h"), n).alias(str(n)) for n in sizes]).collect()
    for r in placed:
        for old, new in zip(sizes, sizes[1:], strict=False):
            assert 0 <= r[str(new)] < new
            assert home(r[str(new)], old) == r[str(old)]
    for n in sizes:
        assert len({r[str(n)] for r in placed}) == n


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_merges_equal_a_dictionary_while_buckets_split(spark, tmp_path, kind):
    draw, plain, made = random.Random(3), {}, table(spark, tmp_path / "t", kind=kind)
    counts = []
    for batch in range(5):
        new = {f"k{draw.randrange(60 * (batch + 1))}": draw.randrange(1_000) for _ in range(60)}
        plain |= new
        assert made.merge(rows(spark, new)) == batch + 1
        assert content(made.read()) == plain
        state = made.state()
        counts.append(state.buckets)
        assert sum(b.rows for b in state.live.values()) == len(plain)
        assert state.size / state.buckets <= 2_000
    assert counts[0] > 1 and counts[-1] > counts[0] and counts == sorted(counts)
    folders = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("generation=")]
    assert len(list((tmp_path / "t" / "_commits").glob("*.json"))) == 2 and len(folders) <= 2 * counts[-1]
    assert made.merge(rows(spark, plain).limit(0)) == 5


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    made = table(spark, tmp_path / "t", 500)
    made.merge(rows(spark, {f"k{i}": i for i in range(100)}))
    before = made.state()
    made.merge(rows(spark, {"k7": 700}))
    after = made.state()
    changed = {b for b in after.live if after.live[b].folder != before.live.get(b, after.live[b]).folder}
    assert before.buckets > 5 and len(changed) == 1 and after.buckets == before.buckets
    assert content(made.read()) == {f"k{i}": 700 if i == 7 else i for i in range(100)}
    assert content(made.read(changed)).keys() >= {"k7"}


def test_a_crash_before_the_commit_leaves_the_old_state(spark, tmp_path, monkeypatch):
    made = table(spark, tmp_path / "t")
    made.merge(rows(spark, {"a": 1, "b": 2}))
    with monkeypatch.context() as broken:
        broken.setattr(KeyedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            made.merge(rows(spark, {"a": 9, "c": 3}))
    assert content(made.read()) == {"a": 1, "b": 2} and made.state().generation == 1
    made.merge(rows(spark, {"a": 5}))
    assert content(made.read()) == {"a": 5, "b": 2}


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    made = table(spark, tmp_path / "t")
    made.merge(rows(spark, {"a": 1}))
    old = made.state()
    made.merge(rows(spark, {"a": 2}))
    monkeypatch.setattr(KeyedTable, "state", lambda self: old)
    with pytest.raises(ConcurrentCommit):
        made.merge(rows(spark, {"a": 3}))
    monkeypatch.undo()
    assert content(made.read()) == {"a": 2} and not list((tmp_path / "t" / "_commits").glob("*.draft"))


def test_rows_without_a_key_stay_and_plain_folders_are_taken_over(spark, tmp_path):
    plain = tmp_path / "t"
    rows(spark, {"a": 1, "b": 2}).unionByName(rows(spark, {None: 3, "c": 4})).write.parquet(str(plain))
    made = table(spark, plain)
    assert sorted(r.amount for r in made.read().collect()) == [1, 2, 3, 4]
    made.merge(rows(spark, {"b": 20}).unionByName(rows(spark, {None: 30})))
    assert sorted(r.amount for r in made.read().collect()) == [1, 3, 4, 20, 30]
    assert table(spark, tmp_path / "none").read().collect() == [] and table(spark, tmp_path / "none").state().buckets == 1


def test_bronze_grows_and_keeps_lines_that_name_no_claim(spark, tmp_path):
    path = str(tmp_path / "bronze")
    (tmp_path / "bronze").mkdir()
    (tmp_path / "bronze" / "old.json").write_text('{"extracted_payload": {"claim_id": "C1"}, "source_filename": "old"}\n{broken\n', encoding="utf-8")
    payload = F.struct(F.concat(F.lit("C"), F.col("id").cast("string")).alias("claim_id"))
    envelopes = spark.range(200).select(payload.alias("extracted_payload"), F.lit("new").alias("source_filename"), F.lit("p").alias("source_file_path"), F.lit("h").alias("source_file_sha256"))
    assert lake.write_bronze(envelopes, path, bucket_bytes=1_000) == 1
    lines = [r.value for r in lake.read_lines(spark, path).collect()]
    assert "{broken" in lines and len(lines) == 201 and sum('"old"' in x for x in lines) == 0
    assert lake.bronze_table(spark, path).state().buckets > 10
    assert {json.loads(x)["extracted_payload"]["claim_id"] for x in lines if x[1] != "b"} == {f"C{i}" for i in range(200)}
    assert keyed.BUCKET_BYTES == 1 << 30


def test_a_merge_leaves_only_compressed_buckets_and_splits_large_ones_over_tasks(spark, tmp_path, monkeypatch):
    left = tmp_path / "staged"
    monkeypatch.setattr(keyed, "staging_path", lambda _, name: f"{left}/{name}-{len(list(left.glob('*')))}")
    monkeypatch.setattr(keyed, "TASK_BYTES", 4_000)
    schema = T.StructType([T.StructField("value", T.StringType())])
    made = KeyedTable(spark, str(tmp_path / "t"), schema, "text", lambda: F.split_part("value", F.lit(" "), F.lit(1)), 40_000)
    line = lambda word: F.concat(F.lit("k"), F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit(word), 30)).alias("value")
    made.merge(spark.range(300).select(line("old ")))
    made.merge(spark.range(100, 400).select(line("new ")))
    files = list((tmp_path / "t").glob("generation=2-*/bucket=*/part-*"))
    assert made.state().buckets == 2 and len(files) > 4 and all(f.name.endswith(".gz") for f in files)
    assert sorted((int(r.value.split()[0][1:]), r.value.split()[1]) for r in made.read().collect()) == [(i, "old" if i < 100 else "new") for i in range(400)]
    assert sum(b.rows for b in made.state().live.values()) == 400 and not list(left.glob("*"))


def test_no_two_shares_of_a_merge_meet_in_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "TASK_BYTES", 1 << 12)
    made = keyed.KeyedTable(spark, str(tmp_path), T.StructType([T.StructField("value", T.StringType())]), "text", lambda: F.col("value"))
    rows = lambda low: spark.range(low, low + 4000).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("value"))
    made.merge(rows(0))
    made.merge(rows(2000))
    assert made.read().count() == made.read().distinct().count() == 6000
    folder = next(iter(made.state().live.values())).folder
    # some 4 kB for each task: 80,000 bytes in 20 shares, none of them empty, each written by its own task
    assert len(list((tmp_path / folder / "bucket=0").glob("part-*.gz"))) == 20


def test_of_repeated_keys_the_greatest_stays_and_other_rows_are_not_grouped(spark, tmp_path, monkeypatch):
    grouped, before = [], keyed.latest_by_key
    monkeypatch.setattr(keyed, "latest_by_key", lambda rows, *a: grouped.append(rows.count()) or before(rows, *a))
    made = table(spark, tmp_path / "t", 500)
    again = spark.createDataFrame([("k1", 7, None), ("k1", 9, None), ("k2", 8, None), (None, 3, None), (None, 4, None)], SCHEMA)
    made.merge(rows(spark, {f"k{i}": i for i in range(50)}).unionByName(again), by=F.struct("amount"))
    assert grouped == [7]
    got = made.read().collect()
    assert {r.name: r.amount for r in got} == {f"k{i}": i for i in range(50)} | {"k1": 9, "k2": 8, None: 4} and len(got) == 51
    assert sum(b.rows for b in made.state().live.values()) == 51
    made.merge(rows(spark, {"k1": 10, "k60": 60}), by=F.struct("amount"))
    assert grouped == [7] and made.read().count() == 52


def test_write_bronze_shuffles_envelopes_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lake, "latest_envelopes", lambda _: pytest.fail("whole envelopes are grouped"))
    payload = F.struct(F.concat(F.lit("C"), (F.col("id") % 40).cast("string")).alias("claim_id"))
    names = [F.col("id").cast("string").alias("source_filename"), F.lit("p").alias("source_file_path"), F.lit("h").alias("source_file_sha256")]
    assert lake.write_bronze(spark.range(100, 150).select(payload.alias("extracted_payload"), *names), str(tmp_path / "b")) == 1
    stored = [json.loads(r.value) for r in lake.read_lines(spark, str(tmp_path / "b")).collect()]
    assert sorted(int(x["source_filename"]) for x in stored) == list(range(110, 150))
