"""The driver tables in the shapes the operators take (FIXTURES.md, part 2)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweir import fixed
from claimweir.operators.audit import Citation, audit, resolve_citations
from claimweir.operators.chunking import chunk_documents
from claimweir.operators.extract import clean_policy
from claimweir.operators.govern import govern, ledger_of_lines
from claimweir.operators.quality import RuleSettings, evaluate, to_quarantine, to_silver
from claimweir.operators.retrieval import Query, search_once
from claimweir.operators.retrieval import citations as area_citations
from claimweir.operators.star import UNREAD, Star, build_star
from claimweir.sources.staging import spread, stage

# A made-up key for test data, not a secret.
SALT = "bench-salt-for-test-tables"
# Fixed instants, so that both engines give the same columns.
AT = "2026-01-02 03:04:05"

# Labels stand for sections, of which a corpus has few.

COUNTIES = (
    "Dublin,Kildare,Meath,Wicklow,Wexford,Louth,Cork,Kerry,Limerick,Clare,Galway,Mayo,Sligo,Donegal,Cavan,Antrim,"
    "Down,Nowhere,Dublin,Cork,Tipperary,Waterford,Roscommon,Tyrone"
)


def at() -> Column:
    return F.lit(f"{AT}+00:00").cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _pick(words: str, index: Column) -> Column:
    return F.split_part(F.lit(words), F.lit(","), index.cast("int") + 1)


def _pad(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of claims as a flat table (B1, lines)."""
    key = F.col("l_orderkey")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    deductible = F.round(price * F.col("l_discount").cast("decimal(4,2)"), 2).cast("decimal(12,2)")
    sign = F.when(key % 50 == 7, F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    return table(spark, sf_dir, "lineitem").select(
        key.alias("order_key"),
        (sign * price).cast("decimal(18,2)").alias("amount"),
        deductible.cast("decimal(18,2)").alias("deductible"),
        (sign * (price - deductible)).cast("decimal(18,2)").alias("net_claimed"),
    )


def claim_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims without amounts (B1, hdr); order_key and o_totalprice kept for them."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    n, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    incident = F.col("o_orderdate").cast("date")
    days = F.when(k % 40 != 9, k * 7 % 100)
    # "example.ie,example.org,mail.example.com" by customer, another domain on some orders of some customers.
    domain = F.when((c % 97 == 13) & (k % 2 == 1), "alt.example.ie").otherwise(
        _pick("example.ie,example.org,mail.example.com", c % 3)
    )
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), domain)
    phone = F.concat(
        F.lit("+353 "), _pick("83,85,87,89", c % 4), F.lit(" "), _pad(c % 1000, 3), F.lit(" "),
        _pad(c % 10000, 4),
    )
    ppsn = (
        F.when(c % 30 == 0, None)
        .when(c % 30 == 1, F.concat(F.lit("INVALID_"), c))
        .otherwise(
            F.concat(c + 1000000, F.substring(F.lit("TWAXR"), (c % 5 + 1).cast("int"), F.lit(1)))
        )
    )
    priority = F.substring("o_orderpriority", 1, 1)
    named = joined.select(
        k.alias("order_key"),
        "o_totalprice",
        F.concat(F.lit("CLM-IE-"), _pad(k, 8)).alias("claim_id"),
        F.when(k % 25 == 3, "[MISSING / NOT PROVIDED]")
        .when(k % 25 == 4, "N/A")
        .when(k % 25 == 5, "  ")
        .otherwise(F.concat(F.lit("POL-IE-"), _pad(c, 6)))
        .alias("policy_number"),
        F.when(k % 25 == 3, "FLAGGED ANOMALY").otherwise("CLEAN INGESTION").alias("status_banner"),
        F.date_add(incident, F.coalesce(days, F.lit(0)).cast("int")).cast("string").alias("filing_date"),
        incident.cast("string").alias("incident_date"),
        days.alias("days_to_notify"),
        F.when(priority == "1", "Major ICT Incident (DORA Article 18)")
        .when(priority == "2", "Significant Operational Disruption")
        .when(priority == "5", None)
        .otherwise("Standard Operational Claim (Non-ICT)")
        .alias("dora_classification"),
        F.when(segment == "AUTOMOBILE", "Commercial Fleet Logistics Impact")
        .when(segment == "BUILDING", "Commercial Property Storm & Water Ingress")
        .when(segment == "FURNITURE", "Supply Chain Fulfillment Breakdown")
        .when(segment == "HOUSEHOLD", "Ransomware / Malicious Cyber Intrusion")
        .otherwise("ICT Operational System Outage & Interruption")
        .alias("incident_type"),
        F.when(
            c % 70 != 8,
            F.concat(
                _pick("Mr.,Ms.,Dr.,Prof.", c % 4), F.lit(" Al "),
                F.replace("c_name", F.lit("#"), F.lit("")),
            ),
        ).alias("claimant_name"),
        ppsn.alias("claimant_ppsn"),
        F.when(c % 41 != 5, email).alias("claimant_email"),
        email.alias("any_email"),
        phone.alias("claimant_phone"),
        F.when(
            n != 24,
            F.concat(c, F.lit(" Main Street, Town"), n, F.lit(", Co. "), _pick(COUNTIES, n)),
        ).alias("loss_location"),
        F.when(
            c % 60 != 7,
            F.concat(_pick("D02,D04,D14,T12,H91,V94,X91,A96,C15", n % 9), F.lit(" "), _pad(c % 10000, 4)),
        ).alias("eircode"),
        F.when(c % 50 == 11, "SEK").when(c % 10 == 0, "USD").otherwise("EUR").alias("currency"),
        F.lit("Attested.").alias("statutory_attestation"),
        F.concat(F.lit("claim_"), k, F.lit(".pdf")).alias("source_filename"),
        F.concat(F.lit("ing-"), k).alias("ingestion_id"),
    )
    return named.withColumns(
        {
            "incident_description": F.concat(
                F.lit("Loss notification. Contact "), "any_email", F.lit(" or "), "claimant_phone",
                F.lit(", PPSN "), F.coalesce("claimant_ppsn", F.lit("none")), F.lit(". Event on "),
                "incident_date", F.lit("."),
            ),
            "source_file_sha256": F.sha2("claim_id", 256),
        }
    ).drop("any_email")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw claims with their ledger and stated totals (B1)."""
    sums = ledger_of_lines(
        claim_lines(spark, sf_dir),
        "order_key",
        F.sum("amount").alias("gross"),
        F.sum("deductible").alias("deducted"),
    )
    k = F.col("order_key")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    off = (
        F.when(k % 33 == 8, F.lit("0.05")).when(k % 33 == 9, F.lit("0.04")).otherwise(F.lit("0"))
    )
    none = F.struct(
        F.lit(0).cast("long").alias("items"),
        F.lit(None).cast("double").alias("least_amount"),
        F.lit(None).cast("double").alias("least_net"),
        F.lit(None).cast("decimal(38,2)").alias("net_total"),
    )
    net = F.coalesce(F.col("ledger.net_total").cast("decimal(18,2)"), price)
    return (
        claim_headers(spark, sf_dir)
        .join(sums, "order_key", "left")
        .withColumns(
            {
                "policy_number": clean_policy(F.col("policy_number")),
                "total_loss_amount": F.coalesce(F.col("gross").cast("decimal(18,2)"), price).cast("double"),
                "total_deductible": F.coalesce(F.col("deducted").cast("decimal(18,2)"), F.lit(0)).cast("double"),
                "total_net_claimed": (net + off.cast("decimal(18,2)")).cast("double"),
                "ledger": F.coalesce("ledger", none),
            }
        )
        .drop("gross", "deducted", "o_totalprice")
    )


def governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return govern(claims(spark, sf_dir), SALT, governed_at=at())


def evaluated(spark: SparkSession, sf_dir: str, settings=RuleSettings()) -> DataFrame:
    return evaluate(
        govern(claims(spark, sf_dir), SALT, governed_at=at(), ppsn_pattern=settings.ppsn_pattern),
        settings,
    )


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_silver(evaluated(spark, sf_dir), at())


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_quarantine(evaluated(spark, sf_dir), promoted_at=at())


def gold_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver as gold reads it, written; narratives, which no gold table has, are not scrubbed for it."""
    return stage(silver(spark, sf_dir).drop(*UNREAD), "silver")


def star(spark: SparkSession, sf_dir: str, **options) -> Star:
    return build_star(gold_input(spark, sf_dir), at(), **options)


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dossier text per order (B2). Its items are parts of the order's price, so no rows are gathered."""
    k = F.col("order_key")
    headers = claim_headers(spark, sf_dir)
    price = F.col("o_totalprice").cast("decimal(18,2)")
    sign = F.when(k % 50 == 7, F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    numbers = F.when(k % 7 > 0, F.sequence(F.lit(1).cast("long"), k % 7)).otherwise(
        F.array().cast("array<bigint>")
    )

    def amount(i):
        return F.round(price / (i + 1).cast("decimal(4,0)"), 2).cast("decimal(18,2)")

    def deductible(amount):
        return F.round(amount * (k % 5).cast("decimal(2,0)") / F.lit(100), 2).cast("decimal(18,2)")

    def signed(value):
        return (sign * value).cast("decimal(18,2)")

    def part(of):
        taken = of["taken"]
        return F.struct(signed(of["amount"]).alias("gross"), taken.alias("taken"), signed(of["amount"] - taken).alias("net"))

    def printed(value):
        return F.format_number(value, 2)

    def item(of):
        return F.concat_ws(" ", printed(of["gross"]), printed(of["taken"]), printed(of["net"]))

    def added(name):
        return F.aggregate("parts", F.lit(0).cast("decimal(18,2)"), lambda total, of: (total + of[name]).cast("decimal(18,2)"))

    totals = F.concat_ws(" ", *[printed(added(name)) for name in ("gross", "taken", "net")])
    place = F.concat(F.col("loss_location"), F.lit(" ["), F.col("eircode"), F.lit("]"))
    lines = [
        F.concat(F.lit("STATUS: "), "status_banner"),
        F.concat(F.lit("DOSSIER ID: "), F.when(k % 29 != 0, F.col("claim_id"))),
        F.concat(F.lit("Policy Number: "), "policy_number"),
        F.when(k % 20 != 1, F.concat(F.lit("Filing Date: "), "filing_date")),
        F.when(k % 20 != 2, F.concat(F.lit("Incident Date: "), "incident_date")),
        F.concat(F.lit("Notice Latency: "), "days_to_notify", F.lit(" days (Compliant SLA)")),
        F.concat(F.lit("DORA Tier: "), "dora_classification"),
        F.concat(F.lit("Claimant Name: "), "claimant_name"),
        F.concat(F.lit("Claimant PPSN: "), "claimant_ppsn"),
        F.concat(F.lit("Contact Email: "), "claimant_email"),
        F.concat(F.lit("Contact Phone: "), "claimant_phone"),
        F.concat(F.lit("Loss Location: "), place),
        F.when(k % 31 != 0, F.concat(F.lit("Incident Type: "), "incident_type")),
        F.lit("INCIDENT SYNOPSIS & REGULATORY CLASSIFICATION"),
        F.col("incident_description"),
        F.concat(F.lit("Reported on "), "incident_date"),
        F.lit("ITEMIZED FINANCIAL LOSS ASSESSMENT (EUR)"),
        F.lit("Category Gross Deductible Net Claim"),
        F.array_join(F.transform("parts", item), "\n"),
        F.concat(F.lit("TOTALS Aggregated Claim Liquidation Value "), totals),
        F.lit("STATUTORY DECLARATION: I certify."),
        F.lit("Claimant / Authorized Representative"),
    ]
    # Columns of their own, so that every amount is worked out once.
    amounts = headers.withColumn("amounts", F.transform(numbers, amount))
    taken = amounts.withColumn("deductibles", F.transform("amounts", deductible))
    pairs = F.arrays_zip(F.col("amounts").alias("amount"), F.col("deductibles").alias("taken"))
    return taken.withColumn("parts", F.transform(pairs, part)).select(
        "order_key",
        F.concat(F.lit("claim_"), k, F.lit(".txt")).alias("file_name"),
        F.concat(F.lit("inbound/claim_"), k, F.lit(".txt")).alias("file_path"),
        F.concat_ws("\n", *lines).alias("text"),
    )


def sectioned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a preamble and a section heading (B5)."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), doc, F.lit(".txt")).alias("file_name"),
        F.concat(
            F.lit("Preamble "), "lang", F.lit("\n\nSECTION "), doc % 7 + 1, F.lit(": "), "source",
            F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")),
        ).alias("text"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(sectioned_documents(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their label as section number (B3)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("section_number"), "embedding"
    )


# Retrieval texts with words that the documents hold; the last area finds nothing in its section and falls back.
AREA_TEXTS = {
    "STATUTORY_NOTIFICATION_SLA": "what is the time for which it was under",
    "MANDATORY_POLICY_NUMBER": "mandatory for and with which are under",
    "FINANCIAL_VALUATION_INTEGRITY": "das war der und dora",
    "GDPR_DATA_PRIVACY_PPSN": "pseudonymization",
}


def area_queries() -> list[Query]:
    return [Query(area, AREA_TEXTS[area], section) for area, section, *_ in fixed.AUDIT_AREAS]


def preset_queries() -> list[Query]:
    return [Query(f"preset_{i}", text) for i, text in enumerate(fixed.PRESET_QUESTIONS)]


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_citations(search_once(stage(chunks(spark, sf_dir), "chunks"), area_queries(), top_k=1))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit reports of all claims. One reader, so the evaluated claims are not written: silver and quarantine are those without an error."""
    scored = evaluated(spark, sf_dir)
    return audit(scored.filter(F.col("governance_error").isNull()), resolve_citations(citations(spark, sf_dir)), at())


def plain_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reports with the fixed wording in place of retrieved excerpts."""
    wording = {
        area: Citation(heading, excerpt, 0.0) for area, _, _, heading, excerpt, _ in fixed.AUDIT_AREAS
    }
    scored = evaluated(spark, sf_dir)
    return audit(
        scored.filter(F.col("governance_error").isNull()), wording, at()
    )


def example_queries(spark: SparkSession, sf_dir: str, same_section: bool) -> DataFrame:
    """One vector of every label, the one with the least id, as a query by example."""
    examples = vectors(spark, sf_dir).groupBy("section_number").agg(F.min_by("embedding", "vec_id").alias("vector"))
    section = F.col("section_number") if same_section else F.lit(None).cast("long")
    return examples.select(F.concat(F.lit("label_"), "section_number").alias("query"), "vector", section.alias("section"))
