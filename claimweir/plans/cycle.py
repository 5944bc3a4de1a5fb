"""The whole cycle over a lake folder: documents to bronze, silver and quarantine, audit, gold, feeds."""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweir import schemas
from claimweir.operators import audit as auditing
from claimweir.operators import chunking, extract, measures, quality, retrieval
from claimweir.operators.govern import govern, payload_columns
from claimweir.operators.quality import RuleSettings
from claimweir.operators.review import apply_adjudications
from claimweir.operators.star import build_star, rejected_claims
from claimweir.sources import lake
from claimweir.sources.staging import stage


@dataclass(frozen=True)
class Lake:
    """Folders of a lake below one root."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_") or name not in _FOLDERS:
            raise AttributeError(name)
        return f"{self.root.rstrip('/')}/{_FOLDERS[name]}"

    def gold(self, table: str) -> str:
        folder = "" if table.endswith("mart") else "star_schema/"
        return f"{self.root.rstrip('/')}/gold/{folder}gold_{table}"

    def feed(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/gold/bi_export/{table}"


_FOLDERS = {
    "inbound": "inbound",
    "corpus": "corpus",
    "bronze": "bronze",
    "silver": "silver/claims_silver",
    "quarantine": "silver/claims_quarantine_json",
    "quarantine_table": "silver/claims_quarantine",
    "rejected": "silver/rejected",
    "adjudications": "silver/adjudications",
    "adjudications_applied": "silver/adjudications_applied",
    "released": "silver/released_json",
    "seen": "inbound_seen",
    "chunks": "gold/regulatory_chunks",
    "audit_reports": "gold/compliance_audit_reports",
    "audit_ledger": "gold/compliance_audit_ledger",
    "gold_rejected": "gold/rejected",
    "manifest": "gold/star_schema_manifest",
    "kpi_summary": "gold/bi_export/kpi_executive_summary",
}


@dataclass(frozen=True)
class CycleSettings:
    salt: str = field(repr=False)
    mask: str = "*"
    rules: RuleSettings = RuleSettings()
    codec: str = "snappy"
    at: Column | None = None
    one_row_per_claimant: bool = False


def to_bronze(documents: DataFrame, target: Lake, settings: CycleSettings) -> DataFrame:
    """Write the envelopes of documents (file_name, file_path, content, text); ingestion counts."""
    extracted = extract.extract_claims(documents)
    lake.write_bronze(extract.create_envelopes(extracted, settings.at), target.bronze)
    return extract.ingestion_statistics(extracted)


def ingest_inbound(
    spark: SparkSession, target: Lake, settings: CycleSettings, files_at_a_time: int = 100_000
) -> DataFrame:
    """Write the envelopes of the inbound files that no earlier call has read; ingestion counts of these files.

    A file that is changed under its old name is not read again; to_bronze(lake.read_documents(...)) reads all there are.
    """
    counts = []

    def land(documents: DataFrame) -> None:
        counts.append(stage(to_bronze(stage(documents, "documents"), target, settings), "ingested"))

    lake.each_new_document(spark, target.inbound, target.seen, land, files_at_a_time=files_at_a_time)
    nothing = spark.createDataFrame([], "total_processed long, successful long, failed long, anomalies_detected long, clean_detected long")
    every = reduce(DataFrame.unionByName, counts, nothing)
    return every.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in nothing.columns])


def to_silver(spark: SparkSession, target: Lake, settings: CycleSettings) -> DataFrame:
    """Write silver, quarantine and rejected rows; the promotion counts.

    The evaluated claims have three readers, so they are written once.
    """
    envelopes, unreadable = lake.read_bronze(spark, target.bronze)
    governed = govern(
        payload_columns(envelopes),
        settings.salt,
        settings.mask,
        settings.at,
        settings.rules.ppsn_pattern,
    )
    evaluated = stage(quality.evaluate(governed, settings.rules), "evaluated")
    held = quality.to_quarantine(evaluated, settings.rules, settings.at)
    _settle(target, quality.to_silver(evaluated, settings.at), held, lake.read_adjudications(spark, target.adjudications), settings.codec)
    # Rejected rows carry no personal data onwards: only what names the record, and why.
    failed = evaluated.filter(F.col("governance_error").isNotNull()).select(
        "ingestion_id", "source_filename", F.col("governance_error").alias("reason")
    )
    rejected = unreadable.select("ingestion_id", "source_filename", "reason").unionByName(failed)
    rejected.write.mode("overwrite").json(target.rejected)
    return quality.promotion_summary(evaluated)


def _settle(target: Lake, silver: DataFrame, held: DataFrame, decisions: DataFrame, codec: str) -> None:
    """Write silver with the claims released by the latest decisions, quarantine with the others, and which log that was.

    Neither silver nor held may read the folders that are written here.

    The released claims are kept as they were in quarantine too, so that a later decision can take them back. The mark of the log is
    removed first and written last: after a crash in between all of it is done again, with the same result.
    """
    spark = silver.sparkSession
    moved, stays = apply_adjudications(held, decisions)
    released = held.join(moved.select("claim_id"), "claim_id", "left_semi")
    staged = [stage(frame, name) for frame, name in ((stays, "quarantine"), (released, "released"), (lake.log_mark(decisions), "mark"))]
    spark.createDataFrame([], staged[2].schema).write.mode("overwrite").json(target.adjudications_applied)
    lake.write_quarantine(staged[1].select(*schemas.QUARANTINE.names), target.released)
    lake.write_silver(silver.unionByName(moved).select(*schemas.SILVER.names), target.silver, codec)
    lake.write_quarantine(staged[0].select(*schemas.QUARANTINE.names), target.quarantine)
    lake.write_silver(quality.flatten_quarantine(staged[0]), target.quarantine_table, codec)
    staged[2].coalesce(1).write.mode("overwrite").json(target.adjudications_applied)


def to_release(spark: SparkSession, target: Lake, settings: CycleSettings) -> bool:
    """Apply decisions logged since silver was written: claims that examiners release move to silver, those taken back return.

    Only the latest decision on a claim counts, so it does not matter how often this runs, nor where an earlier run broke off. A log
    that has been applied is not applied again; whether there was anything to do is returned.
    """
    decisions = lake.read_adjudications(spark, target.adjudications)
    mark = lake.log_mark(decisions)
    applied = lake.read_or_empty(spark, target.adjudications_applied, mark.schema, "json")
    if mark.collect() == applied.collect():
        return False
    out = lake.read_quarantine(spark, target.released)
    held = lake.read_quarantine(spark, target.quarantine)
    held = stage(held.unionByName(out.join(held.select("claim_id"), "claim_id", "left_anti").select(*held.columns)), "held")
    silver = lake.read_or_empty(spark, target.silver, schemas.SILVER, "parquet")
    promoted = stage(silver.join(held.select("claim_id"), "claim_id", "left_anti").select(*silver.columns), "promoted")
    _settle(target, promoted, held, decisions, settings.codec)
    return True


def to_audit(
    spark: SparkSession, target: Lake, settings: CycleSettings, reindex: bool = False
) -> DataFrame:
    """Index the corpus, audit silver and quarantine, write reports and ledger; verdict counts."""
    corpus = chunking.chunk_documents(lake.read_corpus(spark, target.corpus))
    chunks = lake.index_corpus(corpus, target.chunks, reindex)
    hits = retrieval.search_once(chunks, retrieval.area_queries(), top_k=1)
    cited = auditing.resolve_citations(retrieval.citations(hits))
    silver = lake.read_or_empty(spark, target.silver, schemas.SILVER, "parquet")
    claims = auditing.population(silver, lake.read_quarantine(spark, target.quarantine))
    reports = auditing.audit(claims, cited, settings.at)
    lake.write_audit(reports, auditing.ledger(reports), target.audit_reports, target.audit_ledger)
    return auditing.verdict_counts(lake.read_audit(spark, target.audit_reports))


def to_gold(spark: SparkSession, target: Lake, settings: CycleSettings) -> DataFrame:
    """Write the star schema and the mart; the manifest."""
    silver = lake.read_silver(spark, target.silver)
    star = build_star(silver, settings.at, settings.one_row_per_claimant)
    written = lake.export_tables(star.tables(), target.gold, settings.codec)
    rejected_claims(silver).write.mode("overwrite").json(target.gold_rejected)
    listed = lake.manifest(spark, written, target.silver, silver.count())
    listed.coalesce(1).write.mode("overwrite").json(target.manifest)
    return listed


def to_feeds(spark: SparkSession, target: Lake) -> DataFrame:
    """Write the CSV feeds and the KPI document; the KPI row."""
    tables = [
        "dim_date",
        "dim_geography",
        "dim_incident_classification",
        "dim_policy",
        "dim_claimant",
        "fact_claims",
        "claims_analytical_mart",
    ]
    lake.write_feeds(spark, {name: target.gold(name) for name in tables}, target.feed)
    partials, _ = measures.partial_measures(spark.read.parquet(target.gold("claims_analytical_mart")))
    summary = measures.kpi_summary(partials, measures.PARTIALS)
    lake.write_document(summary, target.kpi_summary)
    return summary


def release_overrides(spark: SparkSession, target: Lake) -> DataFrame:
    """Silver as it will be once to_release has applied the log."""
    moved, _ = apply_adjudications(
        lake.read_quarantine(spark, target.quarantine),
        lake.read_adjudications(spark, target.adjudications),
    )
    return lake.read_silver(spark, target.silver).unionByName(moved)


def run_cycle(spark: SparkSession, target: Lake, settings: CycleSettings) -> DataFrame:
    """All stages in order over the inbound folder of a lake; the KPI row.

    Each inbound file is read once, whatever the number of cycles. Decisions in the log when silver is written are applied to it;
    for later ones there is to_release, after which audit, gold and feeds are due again.
    """
    ingest_inbound(spark, target, settings)
    to_silver(spark, target, settings)
    to_audit(spark, target, settings)
    to_gold(spark, target, settings)
    return to_feeds(spark, target)


def tier_status(spark: SparkSession, target: Lake) -> DataFrame:
    """Records per tier; a tier not written yet counts 0."""
    nothing = schemas.SILVER
    mart = lake.read_or_empty(spark, target.gold("claims_analytical_mart"), nothing, "parquet")
    return lake.tier_counts(
        [
            ("raw", lake.scan_inbound(spark, target.inbound)),
            ("bronze", lake.read_lines(spark, target.bronze)),
            ("silver", lake.read_or_empty(spark, target.silver, nothing, "parquet")),
            ("quarantine", lake.read_quarantine(spark, target.quarantine)),
            ("gold", mart),
        ]
    )
