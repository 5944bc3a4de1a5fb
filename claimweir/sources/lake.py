"""Readers and writers of the lake: inbound documents, bronze, silver, quarantine, gold, corpus, feeds."""

from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweir import schemas
from claimweir.functions.text import strip
from claimweir.operators.extract import clean_policy
from claimweir.operators.latest import latest_by_key, upsert
from claimweir.sources.keyed import BUCKET_BYTES, FAST_GZIP, KeyedTable

_BROKEN = "_corrupt_record"


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, kind: str) -> DataFrame:
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)


# --- inbound --------------------------------------------------------------------------------------------------------


def _binary_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files of a folder and its sub-folders; a folder that does not exist has none."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    try:
        return reader.option("recursiveFileLookup", "true").load(folder)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], "path string, length long, content binary")


def scan_inbound(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Inbound files by name. Contents are not read; a folder that does not exist has no files."""
    name = F.element_at(F.split("path", "/"), -1)
    return _binary_files(spark, folder, pattern).select(
        name.alias("file_name"), F.col("path").alias("file_path"), F.col("length").alias("bytes")
    ).orderBy("file_name", "file_path")


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Inbound documents (file_name, file_path, content, text), one row each."""
    return _documents(_binary_files(spark, folder, pattern))


_BINARY = "path string, modificationTime timestamp, length long, content binary"


def _documents(files: DataFrame) -> DataFrame:
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("path").alias("file_path"),
        "content",
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def each_new_document(
    spark: SparkSession,
    folder: str,
    checkpoint: str,
    land: Callable[[DataFrame], None],
    pattern: str = "*.txt",
    files_at_a_time: int = 100_000,
) -> int:
    """Hand the inbound documents that no earlier call has seen to `land`, in batches; how many batches there were.

    A file stream remembers under `checkpoint` which paths it has seen, so that a file is read once whatever the size of the folder,
    and a folder without new files is listed only. A batch that failed is handed over again, so `land` must bear that.
    A folder that does not exist has no files.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return 0
    files = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_at_a_time)
        .load(folder)
    )
    landed = []

    def batch(rows: DataFrame, number: int) -> None:
        land(_documents(rows))
        landed.append(number)

    query = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return len(landed)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Regulatory texts (file_name, file_path, text), each file whole."""
    return read_documents(spark, folder, "*.txt").select("file_name", "file_path", "text")


# --- bronze ---------------------------------------------------------------------------------------------------------


_SOURCE_ORDER = ["source_filename", "source_file_path", "source_file_sha256"]
_LINE = T.StructType([T.StructField("value", T.StringType())])


def latest_envelopes(envelopes: DataFrame) -> DataFrame:
    """One envelope per claim: that of the last file by name, then path, then content."""
    return latest_by_key(envelopes, ["extracted_payload.claim_id"], _SOURCE_ORDER)


def bronze_table(spark: SparkSession, path: str, bucket_bytes: int = BUCKET_BYTES) -> KeyedTable:
    """Bronze as JSON lines by claim id."""
    return KeyedTable(spark, path, _LINE, "text", lambda: F.get_json_object("value", "$.extracted_payload.claim_id"), bucket_bytes)


def write_bronze(envelopes: DataFrame, path: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Insert envelopes, or put them in the place of those of the same claim; other stored claims stay.

    Bronze is JSON lines in buckets by a hash of the claim id, whose number grows with the table. Only buckets that envelopes fall
    into are read and written again; without envelopes nothing is touched. Readers see all of a batch or nothing of it. Stored
    lines that name no claim are kept as they are. Returns the generation that holds the envelopes.
    """
    # uuid() draws again whenever a plan runs; the merge runs this one once, when it writes the incoming lines.
    line = F.to_json(F.struct(*envelopes.columns), {"ignoreNullFields": "false"}).alias("value")
    lines = envelopes.select(line, F.col("extracted_payload.claim_id").alias("claim_id"), F.struct(*_SOURCE_ORDER).alias("order"))
    return bronze_table(envelopes.sparkSession, path, bucket_bytes).merge(lines, F.col("claim_id"), F.col("order"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The stored JSON lines of bronze."""
    return bronze_table(spark, path).read()


def validated(envelopes: DataFrame) -> DataFrame:
    """Every string of the claim stripped, placeholders of a missing policy removed, defaults filled."""
    payload = F.col("extracted_payload")
    defaults = {"currency": "EUR", "total_loss_amount": 0.0, "total_deductible": 0.0}
    fields = []
    for field in schemas.RAW_CLAIM.fields:
        value = payload[field.name]
        if field.name == "policy_number":
            value = clean_policy(value)
        elif isinstance(field.dataType, T.StringType):
            value = strip(value)
        elif field.name == "line_items":
            value = F.coalesce(
                F.transform(value, _validated_item), F.array().cast(field.dataType)
            )
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        fields.append(value.alias(field.name))
    return envelopes.withColumn("extracted_payload", F.struct(*fields))


def _validated_item(item: Column) -> Column:
    return F.struct(
        strip(item["category"]).alias("category"),
        strip(item["description"]).alias("description"),
        item["amount"].alias("amount"),
        F.coalesce(item["deductible"], F.lit(0.0)).alias("deductible"),
        item["net_claimed"].alias("net_claimed"),
    )


def read_bronze(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid envelopes, and what could not be read as one together with the reason."""
    schema = T.StructType([*schemas.ENVELOPE.fields, T.StructField(_BROKEN, T.StringType())])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    paths = bronze_table(spark, path).paths()
    if paths:
        rows = reader.option("columnNameOfCorruptRecord", _BROKEN).json(paths).select(*schema.names)
    else:
        rows = spark.createDataFrame([], schema)
    required = ["claim_id", "filing_date", "incident_date", "total_net_claimed"]
    payload = F.col("extracted_payload")
    reasons = [
        F.when(F.col(_BROKEN).isNotNull(), "not a JSON envelope"),
        *[F.when(payload[name].isNull(), f"missing {name}") for name in required],
        F.when(F.col("source_file_sha256").isNull(), "missing source_file_sha256"),
        F.when(F.col("source_file_size_bytes") < 0, "negative file size"),
    ]
    marked = rows.withColumn("reason", F.concat_ws("; ", *reasons))
    good = marked.filter(F.col("reason") == "").drop(_BROKEN, "reason")
    return validated(good), marked.filter(F.col("reason") != "")


# --- silver and quarantine ------------------------------------------------------------------------------------------


def _write_json(table: DataFrame, path: str, codec: str = "gzip") -> None:
    """JSON lines. Tables are in gzip, which any reader opens: their wordings repeat from row to row."""
    table.write.mode("overwrite").option("ignoreNullFields", "false").options(**FAST_GZIP).option("compression", codec).json(path)


def write_silver(silver: DataFrame, path: str, codec: str = "snappy") -> None:
    silver.write.mode("overwrite").option("compression", codec).parquet(path)


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    """The silver table; its absence is an error."""
    return spark.read.schema(schemas.SILVER).parquet(path)


def write_quarantine(quarantine: DataFrame, json_path: str) -> None:
    """The nested form. Write flatten_quarantine(...) with write_silver for the columnar one."""
    _write_json(quarantine, json_path)


def read_quarantine(spark: SparkSession, json_path: str) -> DataFrame:
    return read_or_empty(spark, json_path, schemas.QUARANTINE, "json")


# --- gold -----------------------------------------------------------------------------------------------------------


def export_tables(
    tables: Mapping[str, DataFrame], path_of: Callable[[str], str], codec: str = "snappy"
) -> dict[str, tuple[str, int]]:
    """Write tables as Parquet; path and row count of each, counted while writing."""
    written = {}
    for name, table in tables.items():
        seen, path = Observation(), path_of(name)
        counted = table.observe(seen, F.count(F.lit(1)).alias("rows"))
        counted.write.mode("overwrite").option("compression", codec).parquet(path)
        written[name] = (path, seen.get["rows"])
    return written


def manifest(
    spark: SparkSession, written: Mapping[str, tuple[str, int]], source: str, source_rows: int
) -> DataFrame:
    """One row per written table."""
    rows = [
        (name, path, count, "consolidated_mart" if name.endswith("mart") else "star_schema_table")
        for name, (path, count) in written.items()
    ]
    tables = spark.createDataFrame(
        rows, "table_name string, path string, rows long, type string"
    )
    return tables.withColumns(
        {
            "source_silver_file": F.lit(source),
            "source_record_count": F.lit(source_rows).cast("long"),
            "transformation_timestamp": F.current_timestamp(),
        }
    )


def write_feeds(
    spark: SparkSession, paths: Mapping[str, str], feed_of: Callable[[str], str]
) -> dict[str, str]:
    """Each gold table as CSV with a header."""
    feeds = {name: feed_of(name) for name in paths}
    for name, path in paths.items():
        spark.read.parquet(path).write.mode("overwrite").option("header", True).csv(feeds[name])
    return feeds


def write_document(one_row: DataFrame, path: str) -> None:
    """A one-row table as a single JSON document."""
    _write_json(one_row.coalesce(1), path, "none")


def write_audit(
    reports: DataFrame, ledger: DataFrame, json_path: str, ledger_path: str
) -> None:
    _write_json(reports, json_path)
    ledger.write.mode("overwrite").option("compression", "snappy").parquet(ledger_path)


def read_audit(spark: SparkSession, json_path: str) -> DataFrame:
    return read_or_empty(spark, json_path, schemas.AUDIT_REPORT, "json")


# --- corpus index ---------------------------------------------------------------------------------------------------


def upsert_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, "chunk_id", ["text", "metadata.source_file"])


def chunk_table(spark: SparkSession, path: str, bucket_bytes: int = BUCKET_BYTES) -> KeyedTable:
    """Stored chunks as Parquet by chunk id."""
    return KeyedTable(spark, path, schemas.CHUNK, "parquet", lambda: F.col("chunk_id"), bucket_bytes)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return chunk_table(spark, path).read()


def index_corpus(chunks: DataFrame, path: str, force: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The chunk table at a path. Chunks are inserted, or put in the place of those with their id, when the table is empty or
    when that is forced; else it stays as it is.

    Only buckets that chunks fall into are written again, and readers see all of it or nothing. Of chunks with one id, that
    which is greatest by text and file stays.
    """
    table = chunk_table(chunks.sparkSession, path, bucket_bytes)
    if force or table.read().isEmpty():
        table.merge(latest_by_key(chunks.select(*schemas.CHUNK.names), ["chunk_id"], ["text", "metadata.source_file"]))
    return table.read()


# --- adjudication log -----------------------------------------------------------------------------------------------


def append_adjudications(decisions: DataFrame, path: str) -> None:
    named = decisions.select(*schemas.ADJUDICATION.names)
    named.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_adjudications(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, schemas.ADJUDICATION, "json")


def log_mark(decisions: DataFrame) -> DataFrame:
    """One row that tells logs apart: how many decisions, and the sum of their hashes whatever their order."""
    hashed = F.xxhash64(*schemas.ADJUDICATION.names).cast("decimal(38,0)")
    return decisions.agg(F.count(F.lit(1)).alias("decisions"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("hashes"))


# --- status ---------------------------------------------------------------------------------------------------------


def tier_counts(tiers: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """Rows per tier, one count for each."""
    counted = [
        table.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("tier"), "records")
        for name, table in tiers
    ]
    result = counted[0]
    for other in counted[1:]:
        result = result.unionAll(other)
    return result
