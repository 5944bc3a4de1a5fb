"""Keyed tables in files: buckets that split as they grow, and commits that readers see whole or not at all.

Below the path of a table, `_commits/<number>.json` names the folder, rows and bytes of each bucket, and
`generation=<number>-<id>/bucket=<n>` holds the rows. A merge writes new folders for the buckets it touches and then one commit
file, by a rename that fails if the number is taken. Until that rename readers see the state before it.
"""

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweir.operators.latest import latest_by_key
from claimweir.operators.lookup import is_small
from claimweir.sources.staging import stage, staging_path

#: Bytes of rows a bucket holds on average before buckets are split.
BUCKET_BYTES = 1 << 30
#: Bytes of rows that a task of a merge sorts and writes, as one file or as some small buckets.
TASK_BYTES = 64 << 20
#: How files are compressed. Text in gzip is read by anything; a file is no larger than a task, so it need not be split.
CODECS = {"text": "gzip", "json": "gzip", "parquet": "zstd"}
#: gzip at its fastest level: 600,000 envelopes took 19 task seconds to write instead of 34, and 30 % more bytes.
FAST_GZIP = {"zlib.compress.level": "BEST_SPEED"}
#: Commits whose folders stay, so that a reader that began before a commit can end.
KEPT_COMMITS = 2


class ConcurrentCommit(RuntimeError):
    """Another writer committed since this one read the table; nothing of this write is visible, so it may be tried again."""


@dataclass(frozen=True)
class Bucket:
    folder: str
    rows: int
    size: int


@dataclass(frozen=True)
class State:
    """What a commit says. Without one, generation 0: no buckets yet."""

    generation: int = 0
    buckets: int = 1
    live: dict[int, Bucket] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return sum(b.size for b in self.live.values())


# --- linear hashing -------------------------------------------------------------------------------------------------


def home(bucket: int, buckets: int) -> int:
    """Where the keys of a bucket lay when there were only so many: its number without its highest bits."""
    while bucket >= buckets:
        bucket -= 1 << (bucket.bit_length() - 1)
    return bucket


def bucket_of(hashed: Column, buckets: int) -> Column:
    """The bucket of a hash. One bucket more takes keys from one other bucket only: that with its number without the highest bit."""
    low = 1 << (buckets.bit_length() - 1)
    wide = F.pmod(hashed, F.lit(2 * low))
    return F.when(wide < buckets, wide).otherwise(wide - low).cast("int")


# --- files ----------------------------------------------------------------------------------------------------------


class Files:
    """The few calls of Hadoop's file system that a commit needs."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file under another name, then rename it; False if the name is taken."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self._fs.create(self._path(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.exists(self._path(name)) and self._fs.rename(self._path(draft), self._path(name)):
            return True
        self.delete(draft)
        return False

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


# --- the table ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class KeyedTable:
    """Rows of a schema with one row per key, in files of a format that Spark reads ("text", "json", "parquet").

    A folder without commits is read as it is, whatever its layout; the first merge takes its rows over into buckets.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    format: str
    key: Callable[[], Column]
    bucket_bytes: int = BUCKET_BYTES

    def _files(self) -> Files:
        return Files(self.spark, self.path)

    def state(self) -> State:
        commits = [n for n in self._files().names("_commits") if n.endswith(".json")]
        if not commits:
            return State()
        told = json.loads(self._files().read(f"_commits/{commits[-1]}"))
        return State(told["generation"], told["buckets"], {int(k): Bucket(*b) for k, b in told["live"].items()})

    def paths(self, only: Iterable[int] | None = None) -> list[str]:
        """Folders that hold the rows, of all buckets or of some."""
        state = self.state()
        if not state.generation:
            return [self.path] if any(n[0] not in "_." and not n.startswith("generation=") for n in self._files().names()) else []
        wanted = state.live if only is None else [b for b in only if b in state.live]
        return [f"{self.path.rstrip('/')}/{state.live[b].folder}/bucket={b}" for b in sorted(wanted)]

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        paths = self.paths(only)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        try:
            return self.spark.read.schema(self.schema).format(self.format).load(paths).select(*self.schema.names)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def _size(self) -> Column:
        """About the bytes of a row as text."""
        fields = self.schema.fields
        if len(fields) == 1 and isinstance(fields[0].dataType, T.StringType):
            return F.octet_length(F.coalesce(F.col(fields[0].name), F.lit(""))).cast("long") + 1
        return F.octet_length(F.to_json(F.struct(*self.schema.names))).cast("long")

    def _marked(self, rows: DataFrame, key: Column | None = None, *also: Column) -> DataFrame:
        """Rows with their key and its hash (of the whole row where it has none)."""
        whole = F.to_json(F.struct(*self.schema.names))
        hashed = F.when(F.col("_key").isNotNull(), F.xxhash64("_key")).otherwise(F.xxhash64(whole))
        return rows.select(*self.schema.names, (self.key() if key is None else key).alias("_key"), *also).select("*", hashed.alias("_hash"))

    def merge(self, incoming: DataFrame, key: Column | None = None, by: Column | None = None) -> int:
        """Insert rows, or put them in the place of those with the same key; the generation that holds them.

        Incoming keys must be distinct, unless `by` says which row of a key stays: that which is greatest in it. Other rows without
        a key are always inserted. `key` is the key of an incoming row, where it is known without reading the row. Only buckets that
        incoming rows fall into are read and written again, and those that give keys to new ones: a table that grew has more
        buckets, so that a bucket holds bucket_bytes on average at most. Without incoming rows nothing is written.

        Incoming rows are written once, and deleted after the commit. Stored and incoming rows meet in one shuffle by bucket, from
        which the buckets are written at once; their rows are counted in the files, or in the written rows where these are all.
        """
        state = self.state()
        path = staging_path(self.spark, "incoming")
        also = [self._size().alias("_size"), *([] if by is None else [by.alias("_by")])]
        rows = stage(self._marked(incoming, key, *also), "incoming", path=path)
        rows, kept = (rows, None) if by is None else self._latest(rows)
        size = rows.agg(F.sum("_size")).first()[0]
        if size is None:
            return state.generation
        plain = [] if state.generation else self.paths()
        stored = self.read().agg(F.sum(self._size())).first()[0] or 0 if plain else state.size
        buckets = max(state.buckets, -(-(stored + size) // self.bucket_bytes))
        named = F.struct(bucket_of(F.col("_hash"), buckets).alias("bucket"))["bucket"]
        # at most one row for each bucket
        counted = rows.groupBy(named.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("size")).collect()
        # keys of a new bucket come from one old bucket
        touched = {home(b, state.buckets) for b in [*(r["bucket"] for r in counted), *range(state.buckets, buckets)]}
        before = self._marked(self.read(None if plain else touched)) if plain or touched & state.live.keys() else None
        folder = f"generation={state.generation + 1}-{uuid.uuid4().hex}"
        to = f"{self.path.rstrip('/')}/{folder}"
        amount = size + (stored if plain else sum(state.live[b].size for b in touched & state.live.keys()))
        self._write(rows, before, [b for b in range(buckets) if home(b, state.buckets) in touched], buckets, amount, to)
        if before is not None:
            written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).format(self.format).load(to)
            counted = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(self._size()).alias("size")).collect()
        live = {b: v for b, v in state.live.items() if b not in touched}
        live |= {r["bucket"]: Bucket(folder, r["rows"], r["size"]) for r in counted}
        self._commit(State(state.generation + 1, buckets, live))
        for left in (path, kept):
            if left:
                Files(self.spark, left).delete("")
        return state.generation + 1

    def _latest(self, rows: DataFrame) -> tuple[DataFrame, str | None]:
        """Of rows with one key, or with none, that which is greatest in `_by`; and the folder of rows written for it.

        Most keys come once, so that only hashes of keys are shuffled to find the others: rows of these alone are grouped.
        """
        same = F.xxhash64("_key")
        many = stage(rows.groupBy(same.alias("_same")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("_same"), "repeated_keys")
        if many.isEmpty():
            return rows, None
        named, listed = rows.withColumn("_same", same), F.broadcast(many) if is_small(many) else many
        path = staging_path(self.spark, "latest")
        last = stage(latest_by_key(named.join(listed, "_same", "left_semi").drop("_same"), ["_key"], ["_by"]), "latest", path=path)
        return named.join(listed, "_same", "left_anti").drop("_same").unionByName(last), path

    def _write(self, rows: DataFrame, before: DataFrame | None, into: list[int], buckets: int, amount: int, path: str) -> None:
        """Write incoming rows, and those of `before` whose key they do not have, to folders of the buckets in `into`.

        A task gets several buckets, or a part of one by other bits of the hash, so that it holds about TASK_BYTES.
        """
        each = max(1, amount // len(into))
        parts, together = -(-each // TASK_BYTES), max(1, TASK_BYTES // each)
        places = pa.table({"bucket": pa.array(into, pa.int32()), "_place": pa.array([i // together for i in range(len(into))], pa.int32())})
        places = self.spark.createDataFrame(places)
        tasks = -(-len(into) // together) * parts

        def dealt(table: DataFrame, number: int) -> DataFrame:
            part = F.pmod(F.shiftrightunsigned("_hash", 32), F.lit(parts))
            placed = table.withColumn("bucket", bucket_of(F.col("_hash"), buckets)).join(F.broadcast(places), "bucket")
            task = (F.col("_place") * parts + part).cast("int")
            return placed.select(*self.schema.names, "bucket", "_key", task.alias("_task"), F.lit(number).alias("_round"))

        if before is None:
            merged = dealt(rows, 1).drop("_key", "_round").repartitionById(tasks, F.col("_task"))
        else:
            own = Window.partitionBy("_task", "bucket", "_key").orderBy(F.desc("_round"))
            both = dealt(before, 0).unionByName(dealt(rows, 1)).repartitionById(tasks, F.col("_task"))  # the window needs no other shuffle
            merged = both.withColumn("_rank", F.rank().over(own)).filter(F.col("_key").isNull() | (F.col("_rank") == 1))
        out = merged.select(*self.schema.names, "bucket").write.partitionBy("bucket").format(self.format).options(**FAST_GZIP)
        out.option("compression", CODECS[self.format]).save(path)

    def _commit(self, state: State) -> None:
        files = self._files()
        told = {"generation": state.generation, "buckets": state.buckets, "live": {b: [v.folder, v.rows, v.size] for b, v in state.live.items()}}
        if not files.create(f"_commits/{state.generation:010}.json", json.dumps(told)):
            raise ConcurrentCommit(f"{self.path}: generation {state.generation} is there already")
        self._clean(state)

    def _clean(self, state: State) -> None:
        """Delete commits but the last KEPT_COMMITS, and folders of committed generations that none of these names."""
        files = self._files()
        commits = [n for n in files.names("_commits") if n.endswith(".json")]
        named = set()
        for commit in commits[-KEPT_COMMITS:]:
            named |= {v[0] for v in json.loads(files.read(f"_commits/{commit}"))["live"].values()}
        for commit in commits[:-KEPT_COMMITS]:
            files.delete(f"_commits/{commit}")
        for folder in files.names():
            if folder.startswith("generation=") and folder not in named and int(folder[11:].split("-")[0]) <= state.generation:
                files.delete(folder)
