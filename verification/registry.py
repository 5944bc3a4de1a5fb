"""Every query by name: the Spark callable and, where there is one, the SQL it must agree with."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweir import fixed, schemas
from claimweir.functions import pii
from claimweir.operators import audit as auditing
from claimweir.operators import chunking, extract, measures, quality, retrieval, review, star
from claimweir.operators.govern import govern, null_defaults, redaction_actions
from claimweir.operators.latest import latest_by_key
from claimweir.plans.cycle import CycleSettings, Lake, ingest_inbound, tier_status, to_bronze, to_release, to_silver
from claimweir.sources import lake
from claimweir.sources.staging import stage, staging_path
from verification import bindings as b
from verification import sql as s
from verification import sql_text as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None):
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


c = F.col

# --- 2.2 extraction -----------------------------------------------------------------------------------------------


def _extract(name: str, columns: Callable[[], dict], sql: str) -> None:
    def run(spark, d):
        made = columns()
        return b.dossiers(spark, d).select("order_key", *[v.alias(k) for k, v in made.items()])

    register(name, run, s.query(f"SELECT order_key, {sql} FROM dossiers", "dossiers"))


_P = fixed.DOSSIER_PATTERNS
_extract("extract_claim_id", lambda: {"claim_id": extract.claim_id(c("text"), c("file_name"))}, f"{t.CLAIM} AS claim_id")
_extract("extract_policy_number", lambda: {"policy_number": extract.policy_number(c("text"))}, f"{t.POLICY} AS policy_number")
_extract("extract_status_banner", lambda: {"status_banner": extract.find(c("text"), _P["status_banner"])}, t.find(r"STATUS:\s*([^\n\r]+)") + " AS status_banner")
_extract("extract_filing_date", lambda: {"filing_date": extract.filing_date(c("text"))}, f"{t.FILING} AS filing_date")
_extract("extract_incident_date", lambda: {"incident_date": extract.incident_date(c("text"))}, f"{t.INCIDENT} AS incident_date")
_extract("extract_days_to_notify", lambda: {"days_to_notify": extract.days_to_notify(c("text"))}, f"{t.DAYS} AS days_to_notify")
_extract("extract_dora_classification", lambda: {"dora_classification": extract.tier(c("text"))}, f"{t.TIER} AS dora_classification")
_extract(
    "extract_claimant",
    lambda: {n: extract.find(c("text"), _P[n]) for n in ("claimant_name", "claimant_ppsn", "claimant_email", "claimant_phone")},
    ", ".join(
        t.find(rf"{label}:\s*([^\n\r]+)") + f" AS {n}"
        for label, n in (("Claimant Name", "claimant_name"), ("Claimant PPSN", "claimant_ppsn"), ("Contact Email", "claimant_email"), ("Contact Phone", "claimant_phone"))
    ),
)
_extract("extract_loss_location", lambda: {"loss_location": extract.loss_location(c("text"))}, f"{t.LOCATION} AS loss_location")
_extract("extract_eircode", lambda: {"eircode": extract.find(c("text"), _P["eircode"])}, f"{t.EIRCODE} AS eircode")
_extract("extract_incident_type", lambda: {"incident_type": extract.find(c("text"), _P["incident_type"])}, f"{t.INCIDENT_TYPE} AS incident_type")
_extract("extract_incident_description", lambda: {"incident_description": extract.between(c("text"), "incident_description")}, f"{t.DESCRIPTION} AS incident_description")
_extract(
    "extract_totals",
    lambda: dict(zip(("total_loss_amount", "total_deductible", "total_net_claimed"), extract.totals(c("text")))),
    f"{t.total(1)} AS total_loss_amount, {t.total(2)} AS total_deductible, {t.total(3)} AS total_net_claimed",
)
_extract("extract_statutory_attestation", lambda: {"statutory_attestation": extract.between(c("text"), "statutory_attestation")}, f"{t.ATTESTATION} AS statutory_attestation")
register(
    "policy_placeholder",
    lambda spark, d: b.claim_headers(spark, d).select("claim_id", extract.clean_policy(c("policy_number")).alias("policy_number")),
    s.query(
        """SELECT claim_id, CASE WHEN trim(policy_printed) IN ('', 'N/A', 'None', '[MISSING]', '[MISSING / NOT PROVIDED]', 'null')
           THEN NULL ELSE trim(policy_printed) END AS policy_number FROM hdr""",
        "hdr",
    ),
)


def _items(spark, d):
    found = extract.extract_claims(b.dossiers(spark, d))
    rows = found.select("claim_id", F.posexplode_outer("line_items").alias("position", "item")).dropna(subset=["position"])
    return rows.select("claim_id", (c("position") + 1).cast("long").alias("position"), "item.*")


register("extract_line_items", _items, s.query("SELECT * FROM items", "items"))
_FLAT = [n for n in schemas.RAW_CLAIM.names if n != "line_items"]
register(
    "extract_claims",
    lambda spark, d: extract.extract_claims(b.dossiers(spark, d)).select(*_FLAT, F.size("line_items").cast("long").alias("num_line_items")),
    s.query(f"SELECT {', '.join(_FLAT)}, order_key % 7 AS num_line_items FROM extracted", "extracted"),
)
register(
    "ingestion_statistics",
    lambda spark, d: extract.ingestion_statistics(extract.extract_claims(b.dossiers(spark, d))),
    s.query(
        """SELECT count(*) AS total_processed, count(*) AS successful, 0 AS failed,
           count(*) FILTER (status_banner = 'FLAGGED ANOMALY') AS anomalies_detected,
           count(*) FILTER (status_banner IS DISTINCT FROM 'FLAGGED ANOMALY') AS clean_detected FROM extracted""",
        "extracted",
    ),
)


def _govern_text(spark, d):
    claims = (
        extract.extract_claims(b.dossiers(spark, d))
        .withColumn("source_filename", c("file_name"))
        .withColumn("source_file_sha256", F.sha2("text", 256))
        .withColumn("ingestion_id", c("file_name"))
    )
    return quality.evaluate(govern(claims, b.SALT, governed_at=b.at()))


register(
    "dossiers_to_gate",
    lambda spark, d: _govern_text(spark, d).select(
        "claim_id", "claimant_ppsn_hash", "loss_county", "eircode_routing_key", "quality_score", "is_valid",
        F.array_join(quality.failed_rules(), ", ").alias("failed_rules"),
    ),
    s.query("SELECT * FROM text_gate", "text_gate"),
)

# --- 2.3 governance -----------------------------------------------------------------------------------------------


def _from_headers(name: str, columns: Callable[[], dict], sql: str) -> None:
    def run(spark, d):
        made = columns()
        return b.claim_headers(spark, d).select("claim_id", *[v.alias(k) for k, v in made.items()])

    register(name, run, s.query(f"SELECT claim_id, {sql} FROM hdr", "hdr"))


_from_headers("hash_ppsn", lambda: {"claimant_ppsn_hash": pii.hash_ppsn(c("claimant_ppsn"), b.SALT)}, f"{s.PPSN_HASH} AS claimant_ppsn_hash")
_from_headers("ppsn_valid", lambda: {"ppsn_format_valid": pii.ppsn_valid(c("claimant_ppsn"))}, f"{s.PPSN_VALID} AS ppsn_format_valid")
_from_headers("mask_name", lambda: {"claimant_name_masked": pii.mask_name(c("claimant_name"))}, f"{s.MASK_NAME} AS claimant_name_masked")
_from_headers("mask_email", lambda: {"claimant_email_masked": pii.mask_email(c("claimant_email"))}, f"{s.MASK_EMAIL} AS claimant_email_masked")
_from_headers("mask_phone", lambda: {"claimant_phone_masked": pii.mask_phone(c("claimant_phone"))}, f"{s.MASK_PHONE} AS claimant_phone_masked")
_from_headers("county", lambda: {"loss_county": pii.county(c("loss_location"))}, f"{s.COUNTY} AS loss_county")
_from_headers("routing_key", lambda: {"eircode_routing_key": pii.routing_key(c("eircode"))}, f"{s.ROUTING} AS eircode_routing_key")
_from_headers(
    "null_defaults",
    null_defaults,
    """coalesce(days_to_notify, 0) AS days_to_notify,
       coalesce(dora_classification, 'Standard Operational Claim (Non-ICT)') AS dora_classification,
       coalesce(incident_type, 'Operational Impact') AS incident_type""",
)
_from_headers(
    "redaction_actions",
    lambda: {"redaction_actions": F.array_join(redaction_actions(pii.sanitize_narrative(c("incident_description"))), ", ")},
    f"""concat_ws(', ', CASE WHEN claimant_ppsn IS NOT NULL THEN 'PSEUDONYMIZED_IRISH_PPSN' END,
        CASE WHEN claimant_name IS NOT NULL THEN 'MASKED_CLAIMANT_NAME' END,
        CASE WHEN claimant_email IS NOT NULL THEN 'MASKED_CLAIMANT_EMAIL' END,
        CASE WHEN claimant_phone IS NOT NULL THEN 'MASKED_CLAIMANT_PHONE' END,
        'GENERALIZED_GEOGRAPHIC_LOCATION',
        CASE WHEN {s.narrative("incident_description")} <> incident_description THEN 'SCRUBBED_NARRATIVE_PII' END)
        AS redaction_actions""",
)
register(
    "sanitize_narrative",
    lambda spark, d: b.table(spark, d, "documents").select("doc_id", pii.sanitize_narrative(c("text")).alias("clean")),
    f"SELECT doc_id, {s.narrative('text')} AS clean FROM documents",
)
register(
    "sanitize_claim_narrative",
    lambda spark, d: b.claim_headers(spark, d).select("claim_id", pii.sanitize_narrative(c("incident_description")).alias("clean")),
    s.query(f"SELECT claim_id, {s.narrative('incident_description')} AS clean FROM hdr", "hdr"),
)
_GOVERNED = [
    "claim_id", "policy_number", "status_banner", "filing_date", "incident_date", "days_to_notify",
    "dora_classification", "incident_type", "claimant_ppsn_hash", "ppsn_format_valid", "claimant_name_masked",
    "claimant_email_masked", "claimant_phone_masked", "loss_county", "eircode_routing_key",
    "incident_description_clean", "currency", "total_loss_amount", "total_deductible", "total_net_claimed",
    "statutory_attestation", "source_filename", "source_file_sha256", "ingestion_id", "governance_timestamp",
]
register(
    "govern",
    lambda spark, d: b.governed(spark, d).select(*_GOVERNED, c("ledger.items").alias("num_line_items"), c("ledger.net_total").cast("double").alias("net_total")),
    s.query(f"SELECT {', '.join(_GOVERNED)}, num_line_items, cast(net_total AS DOUBLE) AS net_total FROM governed", "governed"),
)

# --- 2.4 quality --------------------------------------------------------------------------------------------------

for _i, _rule in enumerate(s.RULE_NAMES):
    _flag = "passed_" + _rule.removeprefix("RULE_").lower()
    register(
        _rule.lower(),
        lambda spark, d, flag=_flag: b.evaluated(spark, d).select("claim_id", c(flag).alias("passed")),
        s.query(f"SELECT claim_id, r{_i + 1} AS passed FROM scored", "scored"),
    )
register(
    "check_report",
    lambda spark, d: b.evaluated(spark, d).select("claim_id", F.explode_outer(quality.check_results()).alias("check")).select("claim_id", "check.*"),
    s.query(
        " UNION ALL ".join(
            "SELECT claim_id, '{}' AS rule_name, r{} AS passed, '{}' AS description, {} AS details FROM scored".format(
                name, i + 1, s.DESCRIPTIONS[i].replace("'", "''"), s.DETAILS[i]
            )
            for i, name in enumerate(s.RULE_NAMES)
        ),
        "scored",
    ),
)
register(
    "rule_lists",
    lambda spark, d: b.evaluated(spark, d).select(
        "claim_id",
        F.array_join(quality.passed_rules(), ", ").alias("passed_rules"),
        F.array_join(quality.failed_rules(), ", ").alias("failed_rules"),
    ),
    s.query(f"SELECT claim_id, {s.rule_list(True, ', ')} AS passed_rules, {s.rule_list(False, ', ')} AS failed_rules FROM scored", "scored"),
)
register(
    "quality_score",
    lambda spark, d: b.evaluated(spark, d).groupBy("quality_score").agg(F.count(F.lit(1)).alias("claims")),
    s.query("SELECT quality_score, count(*) AS claims FROM scored GROUP BY quality_score", "scored"),
)
register(
    "gate",
    lambda spark, d: b.evaluated(spark, d).select("claim_id", "quality_score", "is_valid"),
    s.query("SELECT claim_id, quality_score, is_valid FROM scored", "scored"),
)
register("silver", b.silver, s.query("SELECT * FROM silver", "silver"))
register(
    "quarantine",
    lambda spark, d: quality.flatten_quarantine(b.quarantine(spark, d)),
    s.query("SELECT * FROM quarantine", "quarantine"),
)
_PROMOTION = """SELECT count(*) AS total_processed, count(*) FILTER (is_valid) AS promoted_to_silver,
    count(*) FILTER (NOT is_valid) AS quarantined_anomalies, 0 AS errors FROM scored"""
register("promotion_summary", lambda spark, d: quality.promotion_summary(b.evaluated(spark, d)), s.query(_PROMOTION, "scored"))
DECLARED_RULES = [
    {"id": fixed.RULE_POLICY, "severity": "CRITICAL"},
    {"id": fixed.RULE_AMOUNTS, "severity": "CRITICAL"},
    {"id": fixed.RULE_TIMELY, "severity": "CRITICAL", "max_latency_days": 60},
    {"id": fixed.RULE_CURRENCY, "severity": "HIGH", "allowed_currencies": ["EUR", "GBP", "CHF", "JPY"]},
    {"id": fixed.RULE_PPSN, "severity": "HIGH", "pattern": r"^\d{7}[A-Za-z]{1,2}$"},
    {"id": fixed.RULE_LEDGER, "severity": "HIGH", "rounding_tolerance_eur": 0.02},
    {"id": fixed.RULE_METADATA, "severity": "MEDIUM"},
]
s.layer("scored_as_declared", s.scored(60, ("EUR", "GBP", "CHF", "JPY"), "0.02"), "governed")
register(
    "declared_rules",
    lambda spark, d: quality.promotion_summary(b.evaluated(spark, d, quality.RuleSettings.from_declarations(DECLARED_RULES))),
    s.query(_PROMOTION.replace("FROM scored", "FROM scored_as_declared"), "scored_as_declared"),
)

# --- 2.5 star -----------------------------------------------------------------------------------------------------

register("dim_date", lambda spark, d: star.dim_date(b.silver(spark, d)), s.query("SELECT * FROM dim_date", "dim_date"))
for _dim in ("geography", "incident_classification", "policy", "claimant"):
    register(
        f"dim_{_dim}",
        lambda spark, d, build=getattr(star, f"dim_{_dim}"): build(b.silver(spark, d)),
        s.query(f"SELECT * FROM dim_{_dim}", f"dim_{_dim}"),
    )


def _undated(spark, d):
    """Promoted claims, those whose id ends in 3 with an incident date that no calendar has."""
    odd = F.when(c("claim_id").endswith("3"), "2026-02-31").otherwise(c("incident_date"))
    return star.rejected_claims(b.silver(spark, d).withColumn("incident_date", odd))


register(
    "gold_rejected",
    _undated,
    s.query("SELECT claim_id, ingestion_id, 'incident_date is no date' AS reason FROM silver WHERE claim_id LIKE '%3' AND claimant_ppsn_hash IS NOT NULL UNION ALL SELECT claim_id, ingestion_id, CASE WHEN claim_id LIKE '%3' THEN 'incident_date is no date; ' ELSE '' END || 'missing claimant_ppsn_hash' FROM silver WHERE claimant_ppsn_hash IS NULL", "silver"),
)
register("fact_claims", lambda spark, d: b.star(spark, d).fact_claims, s.query("SELECT * FROM fact_claims", "fact_claims"))
register(
    "fact_flags",
    lambda spark, d: b.silver(spark, d).select(
        "claim_id",
        star.timely_flag(c("days_to_notify")).alias("is_timely_sla_compliant"),
        star.is_major(c("dora_classification")).cast("int").alias("is_major_dora_incident"),
    ),
    s.query(
        """SELECT claim_id, CASE WHEN days_to_notify <= 90 THEN 1 ELSE 0 END AS is_timely_sla_compliant,
           CASE WHEN dora_classification LIKE '%Major ICT%' THEN 1 ELSE 0 END AS is_major_dora_incident FROM silver""",
        "silver",
    ),
)
register("analytical_mart", lambda spark, d: b.star(spark, d).claims_analytical_mart, s.query("SELECT * FROM mart", "mart"))
register(
    "number_ranges",
    lambda spark, d: star.number_rows(
        b.claim_headers(spark, d).select("loss_location", "claim_id"), ["loss_location", "claim_id"], "number"
    ),
    s.query("SELECT loss_location, claim_id, row_number() OVER (ORDER BY loss_location, claim_id) AS number FROM hdr", "hdr"),
)
register(
    "mart_preview",
    lambda spark, d: star.mart_preview(b.star(spark, d).claims_analytical_mart),
    s.query(
        """SELECT claim_id, province, incident_type, dora_regulatory_tier, net_claimed_amount, is_timely_sla_compliant
           FROM mart ORDER BY claim_key LIMIT 5""",
        "mart",
    ),
)
s.layer(
    "least_claimants",
    "SELECT row_number() OVER (ORDER BY claimant_ppsn_hash) AS claimant_key, claimant_ppsn_hash"
    " FROM (SELECT DISTINCT claimant_ppsn_hash FROM silver)",
    "silver",
)
register(
    "fact_claims_one_row_per_claimant",
    lambda spark, d: b.star(spark, d, one_row_per_hash=True).fact_claims,
    s.query(
        s.fact("least_claimants"),
        "star_keys", "least_claimants",
    ),
)

# --- 2.6 measures -------------------------------------------------------------------------------------------------


def _mart(spark, d):
    """What the measures need of the mart."""
    return star.unnumbered_mart(b.gold_input(spark, d))


_UNNUMBERED = [n for n in star.MART if n not in ("claim_key", "gold_load_timestamp")]
register("unnumbered_mart", _mart, s.query(f"SELECT {', '.join(_UNNUMBERED)} FROM mart", "mart"))


_NET, _GROSS, _DED = (s.exact_sum(n) for n in ("net_claimed_amount", "gross_loss_amount", "deductible_amount"))
_MAJOR_NET = "coalesce(cast(sum(cast(net_claimed_amount AS DECIMAL(18,2))) FILTER (is_major_dora_incident = 1) AS DOUBLE), 0.0)"
_ICT_NET = "coalesce(cast(sum(cast(net_claimed_amount AS DECIMAL(18,2))) FILTER (is_ict_related) AS DOUBLE), 0.0)"
_DAYS = "cast(sum(days_to_notify) AS DOUBLE) / count(*)"
_SCORE = "cast(sum(cast(quality_score AS DECIMAL(9,4))) AS DOUBLE) / count(*)"
_TIMELY = "count(*) FILTER (is_timely_sla_compliant = 1)"
_MAJORS = "count(*) FILTER (is_major_dora_incident = 1)"
_ITEMS = "cast(sum(num_line_items) AS BIGINT)"
MEASURES = {
    "totals": {"total_gross_loss": _GROSS, "total_deductibles": _DED, "total_net_claimed": _NET},
    "average_and_maximum": {"average_net_claim": f"{_NET} / count(*)", "max_single_claim": "max(net_claimed_amount)"},
    "counts": {"total_claims": "count(*)", "total_line_items": _ITEMS},
    "averages": {"average_latency_days": _DAYS, "average_quality_score": _SCORE},
    "average_items_per_claim": {"average_items_per_claim": f"cast({_ITEMS} AS DOUBLE) / count(*)"},
    "sla_compliant_claims": {"sla_compliant_claims": _TIMELY},
    "sla_compliance_rate": {"sla_compliance_rate": f"cast({_TIMELY} AS DOUBLE) / count(*)"},
    "major_incidents": {"major_incidents": _MAJORS, "major_exposure": _MAJOR_NET},
    "major_exposure_share": {"major_exposure_share": f"{_MAJOR_NET} / {_NET}"},
}
for _name, _made in MEASURES.items():
    register(
        f"measure_{_name}",
        lambda spark, d, names=tuple(_made): measures.measure(_mart(spark, d), *names),
        s.query("SELECT " + ", ".join(f"{v} AS {k}" for k, v in _made.items()) + " FROM mart", "mart"),
    )
_ALL = {k: v for made in MEASURES.values() for k, v in made.items()}
register(
    "measures_by_province",
    lambda spark, d: measures.measures_by(_mart(spark, d), ["province"]),
    s.query("SELECT province, " + ", ".join(f"{v} AS {k}" for k, v in _ALL.items()) + " FROM mart GROUP BY province", "mart").replace(
        _MAJOR_NET, "cast(sum(cast(net_claimed_amount AS DECIMAL(18,2))) FILTER (is_major_dora_incident = 1) AS DOUBLE)"
    ),
)


def _ict(spark, d):
    built = b.star(spark, d)
    return measures.ict_exposure(built.fact_claims, built.dim_incident_classification)


register("measure_ict_exposure", _ict, s.query(f"SELECT {_ICT_NET} AS ict_related_exposure FROM mart", "mart"))


def _running(value: str, kind: str, name: str, *parts: str) -> str:
    keys = ", ".join(f"extract({p} FROM filing_date)" for p in parts)
    return s.query(
        f"""SELECT filing_date AS full_date,
              cast(sum({value}) OVER (PARTITION BY {keys} ORDER BY filing_date
                   RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {kind}) AS {name}
            FROM (SELECT filing_date, sum(cast(net_claimed_amount AS DECIMAL(18,2))) AS net, count(*) AS claims
                  FROM mart GROUP BY filing_date)""",
        "mart",
    )


register("net_amount_mtd", lambda spark, d: measures.net_amount_mtd(_mart(spark, d)), _running("net", "DOUBLE", "net_amount_mtd", "year", "month"))
register("net_amount_ytd", lambda spark, d: measures.net_amount_ytd(_mart(spark, d)), _running("net", "DOUBLE", "net_amount_ytd", "year"))
register("claims_count_mtd", lambda spark, d: measures.claims_count_mtd(_mart(spark, d)), _running("claims", "BIGINT", "claims_count_mtd", "year", "month"))
_KPI = f"""
    SELECT *, round(cast(sla_compliant_claims AS DOUBLE) / total_claims * 100, 1) AS sla_compliance_pct,
      round(major_dora_exposure / total_net_claimed * 100, 1) AS major_dora_pct,
      round(ict_related_exposure / total_net_claimed * 100, 1) AS ict_related_pct
    FROM (SELECT count(*) AS total_claims, round({_GROSS}, 2) AS total_gross_loss, round({_DED}, 2) AS total_deductibles,
      round({_NET}, 2) AS total_net_claimed, round({_NET} / count(*), 2) AS avg_claim_value,
      round(max(net_claimed_amount), 2) AS max_single_claim, round({_DAYS}, 1) AS avg_latency_days,
      round({_SCORE} * 100, 1) AS avg_quality_pct, {_ITEMS} AS total_items, {_TIMELY} AS sla_compliant_claims,
      {_MAJORS} AS major_dora_claims, round({_MAJOR_NET}, 2) AS major_dora_exposure,
      round({_ICT_NET}, 2) AS ict_related_exposure FROM mart)"""
register("kpi_numbers", lambda spark, d: measures.kpi_numbers(_mart(spark, d)), s.query(_KPI, "mart"))


def _eur(name: str) -> str:
    return f"'EUR ' || format('{{:,.2f}}', {name})"


_KPI_TEXT = f"""
    SELECT total_claims AS "Total Claims", {_eur("total_gross_loss")} AS "Total Gross Loss",
      {_eur("total_deductibles")} AS "Total Deductibles Applied", {_eur("total_net_claimed")} AS "Total Net Claim Amount",
      {_eur("avg_claim_value")} AS "Average Net Claim Value", {_eur("max_single_claim")} AS "Max Single Claim Exposure",
      format('{{:.1f}} days', avg_latency_days) AS "Average Notice Latency",
      format('{{:.1f}}%', avg_quality_pct) AS "Average Data Quality Score",
      format('{{:.1f}}%', sla_compliance_pct) AS "Statutory SLA Compliance Rate",
      major_dora_claims AS "Major DORA Incidents",
      {_eur("major_dora_exposure")} || format(' ({{:.1f}}% of portfolio)', major_dora_pct) AS "Major DORA Total Exposure",
      {_eur("ict_related_exposure")} || format(' ({{:.1f}}% of portfolio)', ict_related_pct) AS "ICT Related Claims Exposure"
    FROM ({_KPI})"""
register("kpi_summary", lambda spark, d: measures.kpi_summary(_mart(spark, d)), s.query(_KPI_TEXT, "mart"))
for _name, _key in (("province", "province"), ("tier", "dora_regulatory_tier")):
    register(
        f"exposure_by_{_name}",
        lambda spark, d, key=_key: measures.exposure_by(_mart(spark, d), key),
        s.query(f"SELECT {_key}, {_NET} AS net_claimed_amount FROM mart GROUP BY {_key}", "mart"),
    )
register(
    "exposure_by_incident_type",
    lambda spark, d: measures.exposure_by_incident_type(_mart(spark, d)),
    s.query(f"SELECT incident_type, {_NET} AS net_claimed_amount FROM mart GROUP BY incident_type ORDER BY net_claimed_amount, incident_type", "mart"),
)
register(
    "latency_histogram",
    lambda spark, d: measures.latency_histogram(_mart(spark, d)),
    s.query(
        """SELECT bin, least + bin * width AS from_days, least + bin * width + width AS to_days, count(*) AS claims,
             least + bin * width + width > 90 AS beyond_limit
           FROM (SELECT least, width, least(cast(floor((days_to_notify - least) / width) AS BIGINT), 11) AS bin
                 FROM mart, (SELECT cast(min(days_to_notify) AS DOUBLE) AS least,
                   (cast(max(days_to_notify) AS DOUBLE) - min(days_to_notify)) / 12 AS width FROM mart))
           GROUP BY bin, least, width""",
        "mart",
    ),
)
register(
    "dashboard_kpis",
    lambda spark, d: measures.dashboard_kpis(_mart(spark, d)),
    s.query(
        f"""SELECT count(*) AS total_claims, {_NET} AS total_net, {_GROSS} AS total_gross, {_NET} / count(*) AS average_net,
              {_DAYS} AS average_latency, {_MAJOR_NET} AS major_exposure, {_MAJOR_NET} / {_NET} * 100 AS major_pct,
              {_ICT_NET} AS ict_exposure, {_ICT_NET} / {_NET} * 100 AS ict_pct FROM mart""",
        "mart",
    ),
)

# --- 2.7 retrieval and audit --------------------------------------------------------------------------------------

_META = ["chunk_id", "text", "source_file", "section", "section_number"]


def _flat_chunks(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", "text", "metadata.source_file", "metadata.section", "metadata.section_number")


def _sections(spark, d):
    parts = b.sectioned_documents(spark, d).select("file_name", F.posexplode_outer(chunking.split_sections(c("text"))).alias("place", "part"))
    return parts.filter("part.section_number > 0").select("file_name", c("place").cast("long").alias("place"), "part.*")


register(
    "chunk_sections",
    _sections,
    s.query("SELECT file_name, i AS place, section, section_number, body FROM sections", "sections"),
)
register("chunk_documents", lambda spark, d: _flat_chunks(b.chunks(spark, d)), s.query(f"SELECT {', '.join(_META)} FROM chunks", "chunks"))
register(
    "term_rarity",
    lambda spark, d: (lambda staged: retrieval.term_rarity(retrieval.term_counts(staged), staged))(stage(b.chunks(spark, d), "chunks")).select(
        "token", c("rarity").cast("double").alias("rarity")
    ),
    s.query("SELECT token, cast(rarity AS DOUBLE) AS rarity FROM rarity", "rarity"),
)


def _terms(spark, d):
    index = retrieval.build_index(stage(b.chunks(spark, d), "chunks"))
    return index.terms.select("chunk_id", "section_number", "token", c("weight").cast("double").alias("weight"))


register("term_weights", _terms, s.query("SELECT chunk_id, section_number, token, cast(weight AS DOUBLE) AS weight FROM terms", "terms"))


def _preset(spark, d, cutoff=None):
    found = retrieval.search_once(stage(b.chunks(spark, d), "chunks"), b.preset_queries(), top_k=3, cutoff=cutoff)
    return found.select("query", c("rank").cast("long").alias("rank"), "chunk_id", "text", "metadata.section", "similarity_score")


_HITS = "SELECT query, rank, chunk_id, text, section, similarity_score FROM preset_hits"
register("search_text", _preset, s.query(_HITS, "preset_hits"))
register("search_text_cutoff", lambda spark, d: _preset(spark, d, 0.1), s.query(_HITS + " WHERE similarity_score >= 0.1", "preset_hits"))


def _items(spark, d):
    """Every benchmark item as a query, from a table."""
    queries = b.table(spark, d, "benchmark").select(F.concat(F.lit("item_"), c("item_id").cast("string")).alias("query"), "text", F.lit(None).cast("long").alias("section"))
    found = retrieval.search(retrieval.build_index(stage(b.chunks(spark, d), "chunks")), queries, top_k=3)
    return found.select("query", c("rank").cast("long").alias("rank"), "chunk_id", "text", "metadata.section", "similarity_score")


register("search_text_by_table", _items, s.query(_HITS.replace("preset_hits", "item_hits"), "item_hits"))


def _vector_sql(where: str, top_k: int) -> str:
    return f"""
    SELECT query, rank, vec_id, similarity_score FROM (
      SELECT query, vec_id, round(greatest(0.0, 1 - (1 - cosine)), 4) AS similarity_score,
        row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank
      FROM (SELECT q.query, e.vec_id, round(list_cosine_similarity(cast(e.embedding AS DOUBLE[]), q.vector), 10) AS cosine
            FROM embeddings e JOIN (
              SELECT 'label_' || label AS query, label, cast(arg_min(embedding, vec_id) AS DOUBLE[]) AS vector
              FROM embeddings GROUP BY label) q ON {where}))
    WHERE rank <= {top_k}"""


def _vector_search(spark, d, same_section, top_k):
    queries = b.example_queries(spark, d, same_section)
    found = retrieval.search_vectors(b.vectors(spark, d), queries, top_k, "vec_id")
    return found.select("query", c("rank").cast("long").alias("rank"), "vec_id", "similarity_score")


register("search_vectors", lambda spark, d: _vector_search(spark, d, False, 5), _vector_sql("true", 5))
register("search_vectors_in_section", lambda spark, d: _vector_search(spark, d, True, 3), _vector_sql("e.label = q.label", 3))


def _every_vector(spark, d):
    """Every vector as a query against all, in blocks."""
    queries = b.table(spark, d, "embeddings").select(c("vec_id").alias("query"), c("embedding").alias("vector"), F.lit(None).cast("long").alias("section"))
    found = retrieval.search_vectors(b.vectors(spark, d), queries, 3, "vec_id", few=0)
    return found.select("query", c("rank").cast("long").alias("rank"), "vec_id", "similarity_score")


register(
    "search_vectors_in_blocks",
    _every_vector,
    """
    SELECT query, rank, vec_id, similarity_score FROM (
      SELECT query, vec_id, round(greatest(0.0, 1 - (1 - cosine)), 4) AS similarity_score,
        row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank
      FROM (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(cast(e.embedding AS DOUBLE[]), cast(q.embedding AS DOUBLE[])), 10) AS cosine
            FROM embeddings e, embeddings q))
    WHERE rank <= 3""",
)
register("citations", b.citations, s.query("SELECT * FROM citations", "citations"))


def _findings(area: str | None):
    def run(spark, d):
        rows = b.reports(spark, d).select("claim_id", F.explode_outer("findings").alias("finding")).select("claim_id", "finding.*")
        return rows if area is None else rows.filter(c("area") == area)

    return run


for _short, (_area, *_rest) in zip(("notification", "policy", "valuation", "privacy"), fixed.AUDIT_AREAS):
    register(f"audit_{_short}", _findings(_area), s.query(t.findings(_area), "judged", "citations"))
register("audit_findings", _findings(None), s.query(t.findings(), "judged", "citations"))
register(
    "audit_verdicts",
    lambda spark, d: b.plain_reports(spark, d).select("claim_id", "overall_verdict", "supervisory_summary"),
    s.query("SELECT claim_id, overall_verdict, supervisory_summary FROM reports", "reports"),
)
register(
    "audit_population",
    lambda spark, d: (
        lambda scored: auditing.population(quality.to_silver(scored, b.at()), quality.to_quarantine(scored, promoted_at=b.at()))
        .groupBy("governance_status")
        .agg(F.count(F.lit(1)).alias("claims"), F.count("failed_rules").alias("with_failures"))
    )(stage(b.evaluated(spark, d), "evaluated")),
    s.query(
        """SELECT 'VALID_PROMOTED' AS governance_status, count(*) AS claims, 0 AS with_failures FROM silver
           UNION ALL SELECT 'QUARANTINED', count(*), count(*) FROM quarantine""",
        "silver", "quarantine",
    ),
)
register(
    "verdict_counts",
    lambda spark, d: auditing.verdict_counts(b.plain_reports(spark, d)),
    s.query(
        """SELECT count(*) AS total_audited, count(*) FILTER (overall_verdict = 'COMPLIANT') AS compliant,
           count(*) FILTER (overall_verdict = 'REGULATORY_BREACH') AS regulatory_breaches,
           count(*) FILTER (overall_verdict = 'REQUIRES_REVIEW') AS requires_review FROM reports""",
        "reports",
    ),
)
register(
    "citation_frequency",
    lambda spark, d: auditing.citation_frequency(b.plain_reports(spark, d)),
    s.query(
        """SELECT 'CBI-DORA Section 3.2 (90-Day SLA Limit)' AS citation, count(*) AS times FROM reports WHERE late
           UNION ALL SELECT 'CBI-DORA Section 4.1 & 4.2 (Mandatory Policy Identification)', count(*) FROM reports WHERE unidentified
           UNION ALL SELECT 'CBI-DORA Section 5.2 (Negative Liquidation Prohibition)', count(*) FROM reports WHERE negative""",
        "reports",
    ),
)
_LEDGER = [
    "claim_id", "overall_verdict", "policy_number", "total_net_claimed", "days_to_notify", "dora_classification",
    "num_breaches", "citations_count", "cited_articles", "audit_timestamp", "supervisory_summary",
]
_LEDGER_SQL = s.query("SELECT * EXCLUDE (late, unidentified, negative, unhashed), num_breaches AS citations_count FROM reports", "reports")
register("audit_ledger", lambda spark, d: auditing.ledger(b.plain_reports(spark, d)), _LEDGER_SQL)

# --- 2.8 review ---------------------------------------------------------------------------------------------------

register(
    "quarantine_register",
    lambda spark, d: review.quarantine_register(b.quarantine(spark, d)),
    s.query(
        """SELECT claim_id, coalesce(policy_number, '[MISSING / NOT PROVIDED]') AS policy, total_net_claimed AS net_amount,
           days_to_notify || ' days' AS latency, dora_classification, failed_rules AS triggered_rules FROM quarantine""",
        "quarantine",
    ),
)
register(
    "dossier_lookup",
    lambda spark, d: quality.flatten_quarantine(review.dossier(b.quarantine(spark, d), "CLM-IE-00000003")),
    s.query("SELECT * FROM quarantine WHERE claim_id = 'CLM-IE-00000003' LIMIT 1", "quarantine"),
)
for _name, _verdict in (("all", None), ("breaches", "REGULATORY_BREACH"), ("compliant", "COMPLIANT")):
    register(
        f"first_reports_{_name}",
        lambda spark, d, verdict=_verdict: review.reports_by_verdict(b.plain_reports(spark, d), verdict).select("claim_id", "overall_verdict", "supervisory_summary"),
        s.query(
            "SELECT claim_id, overall_verdict, supervisory_summary FROM reports "
            + (f"WHERE overall_verdict = '{_verdict}' " if _verdict else "")
            + "ORDER BY claim_id LIMIT 6",
            "reports",
        ),
    )
register("silver_display", lambda spark, d: review.silver_display(b.silver(spark, d)), s.query(f"SELECT {', '.join(review.SILVER_DISPLAY)} FROM silver", "silver"))
register(
    "compliance_head_counts",
    lambda spark, d: review.head_counts(b.plain_reports(spark, d)),
    s.query(
        """SELECT count(*) FILTER (overall_verdict = 'COMPLIANT') AS compliant,
           count(*) FILTER (overall_verdict = 'REGULATORY_BREACH') AS breaches FROM reports""",
        "reports",
    ),
)

# --- 2.10 stated operators ----------------------------------------------------------------------------------------


def _decisions(spark, d):
    """Events as decisions: an event's user number names the claim, its kind the action."""
    action = (
        F.when(c("event_type") == "purchase", fixed.OVERRIDE_ACTION)
        .when(c("event_type") == "error", fixed.REJECT_ACTION)
        .otherwise(fixed.RECTIFY_ACTION)
    )
    return b.table(spark, d, "events").select(
        F.concat(F.lit("CLM-IE-"), F.lpad(c("user_id").cast("string"), 8, "0")).alias("claim_id"),
        action.alias("action"),
        c("props").alias("examiner_notes"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("adjudication_timestamp"),
        F.lit("examiner").alias("examiner"),
    )


_DECISIONS = """
    SELECT 'CLM-IE-' || lpad(cast(user_id AS VARCHAR), 8, '0') AS claim_id,
      CASE event_type WHEN 'purchase' THEN 'Override with Force Majeure Exception (Promote to Silver)'
        WHEN 'error' THEN 'Confirm Statutory Rejection (Enforce CBI Rule)'
        ELSE 'Request Contract Rectification (Policyholder Contact)' END AS action,
      props AS examiner_notes, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS adjudication_timestamp, 'examiner' AS examiner
    FROM events"""
s.layer("decisions", _DECISIONS)
s.layer(
    "released",
    f"""SELECT claim_id FROM (SELECT *, row_number() OVER (PARTITION BY claim_id
          ORDER BY adjudication_timestamp DESC, action DESC, examiner_notes DESC) AS n FROM decisions)
        WHERE n = 1 AND action = '{fixed.OVERRIDE_ACTION}'""",
    "decisions",
)
register(
    "apply_adjudications",
    lambda spark, d: review.apply_adjudications(b.quarantine(spark, d), _decisions(spark, d))[0],
    s.query(
        "SELECT * EXCLUDE (failed_rules, failure_reasons) REPLACE ('VALID_PROMOTED' AS governance_status) FROM quarantine"
        " WHERE claim_id IN (SELECT claim_id FROM released)",
        "quarantine", "released",
    ),
)
register(
    "still_quarantined",
    lambda spark, d: quality.flatten_quarantine(review.apply_adjudications(b.quarantine(spark, d), _decisions(spark, d))[1]),
    s.query("SELECT * FROM quarantine WHERE claim_id NOT IN (SELECT claim_id FROM released)", "quarantine", "released"),
)
register(
    "latency_check",
    lambda spark, d: review.latency_check(b.claim_headers(spark, d)),
    s.query(
        """SELECT claim_id, days_to_notify, days_between, days_between IS DISTINCT FROM days_to_notify AS mismatch
           FROM (SELECT *, cast(filing_date AS DATE) - cast(incident_date AS DATE) AS days_between FROM hdr)""",
        "hdr",
    ),
)

# --- 2.1 sources and sinks ----------------------------------------------------------------------------------------


def _path(spark, name):
    return staging_path(spark, name)


def _language(path: Column) -> Column:
    return F.regexp_extract(path, "lang=([^/]+)", 1).alias("lang")


def _scanned(spark, d):
    """The documents as text files, a folder a language: bytes as listed."""
    path = _path(spark, "inbound")
    b.table(spark, d, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    return lake.scan_inbound(spark, path).groupBy(_language(c("file_path"))).agg(F.sum("bytes").alias("bytes"))


def _read(spark, d):
    """The same files read: characters."""
    path = _path(spark, "inbound")
    b.table(spark, d, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    read = lake.read_documents(spark, path)
    return read.groupBy(_language(c("file_path"))).agg(F.sum(F.char_length("text")).alias("characters"))


def _corpus(spark, d):
    """The same files as a corpus: characters."""
    path = _path(spark, "corpus")
    b.table(spark, d, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    read = lake.read_corpus(spark, path)
    return read.groupBy(_language(c("file_path"))).agg(F.sum(F.char_length("text")).alias("characters"))


def _ingested(spark, d):
    """The files of two languages, then all, then nothing new through the inbound stream: how often each was read, and what bronze has."""
    target, settings = Lake(_path(spark, "lake")), CycleSettings(b.SALT, at=b.at())
    texts = b.table(spark, d, "documents").select("lang", "text")
    counts = []
    # a job for each language: files of one job would bear the same names in each folder, and so name the same claims
    for batch in (["en", "fr"], ["de", "es"], []):
        for lang in batch:
            texts.filter(c("lang") == lang).write.mode("append").partitionBy("lang").text(target.inbound)
        counts.append(ingest_inbound(spark, target, settings).first()["total_processed"])
    files = lake.scan_inbound(spark, target.inbound).count()
    good = lake.read_lines(spark, target.bronze).select(F.from_json("value", schemas.ENVELOPE).alias("e")).select("e.*")
    read = good.groupBy(_language(c("source_file_path"))).agg(F.sum("raw_text_length").alias("characters"))
    return read.select("lang", "characters", F.lit(sum(counts) == files and counts[2] == 0).alias("each_read_once"))


_CHARACTERS_SQL = "SELECT lang, cast(sum(length(text) + 1) AS BIGINT) AS characters FROM documents GROUP BY lang"
register("read_corpus", _corpus, _CHARACTERS_SQL)
register("ingest_inbound", _ingested, _CHARACTERS_SQL.replace("characters FROM", "characters, true AS each_read_once FROM"))
register("scan_inbound", _scanned, "SELECT lang, cast(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang")
register("read_documents", _read, "SELECT lang, cast(sum(length(text) + 1) AS BIGINT) AS characters FROM documents GROUP BY lang")


def _documents(spark, d):
    return b.dossiers(spark, d).withColumn("content", F.encode("text", "UTF-8"))


def _envelopes(spark, d):
    return extract.create_envelopes(extract.extract_claims(_documents(spark, d)), b.at())


register(
    "create_envelope",
    lambda spark, d: _envelopes(spark, d).drop("ingestion_id", "extracted_payload"),
    s.query(
        f"""SELECT file_name AS source_filename, file_path AS source_file_path, strlen(text) AS source_file_size_bytes,
              sha256(text) AS source_file_sha256, '{s.STAMP}' AS ingestion_timestamp,
              'deterministic_pypdf_regex' AS extraction_method, 'parser_engine_v1' AS model_version,
              length(text) AS raw_text_length, 'bronze' AS lakehouse_layer FROM dossiers""",
        "dossiers",
    ),
)


def _bronze(spark, d, bucket_bytes=lake.BUCKET_BYTES):
    """All dossiers, then those with even keys again under a later name, then nothing: corrections replace, the rest stays."""
    path = _path(spark, "bronze")
    first = _documents(spark, d)
    again = first.filter("order_key % 2 = 0").withColumn("file_name", F.concat(F.lit("zz_"), "file_name"))
    for batch in (first, again, first.filter("false")):
        lake.write_bronze(extract.create_envelopes(extract.extract_claims(batch), b.at()), path, bucket_bytes)
    good, _ = lake.read_bronze(spark, path)
    return good.select("extracted_payload.claim_id", "extracted_payload.policy_number", "source_filename", "source_file_sha256", F.size("extracted_payload.line_items").cast("long").alias("items"))


_BRONZE_SQL = s.query(
        """SELECT CASE WHEN contains(text, 'DOSSIER ID: ') THEN claim_id ELSE 'CLM-UNKNOWN-' || prefix || 'claim_' || order_key END AS claim_id,
           policy_number, prefix || 'claim_' || order_key || '.txt' AS source_filename, sha256(text) AS source_file_sha256,
           order_key % 7 AS items
           FROM extracted, (VALUES (''), ('zz_')) AS rounds(prefix)
           WHERE CASE WHEN prefix = 'zz_' THEN order_key % 2 = 0 ELSE order_key % 2 = 1 OR NOT contains(text, 'DOSSIER ID: ') END""",
        "extracted",
    )
register("write_bronze", _bronze, _BRONZE_SQL)
# the same in buckets so small that they split from batch to batch
register("write_bronze_in_many_buckets", lambda spark, d: _bronze(spark, d, 1 << 20), _BRONZE_SQL)
register(
    "latest_by_key",
    lambda spark, d: latest_by_key(b.table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).withColumn("ts", c("ts").cast("string")),
    """SELECT * EXCLUDE (n) REPLACE (cast(ts AS VARCHAR) AS ts) FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)


def _lake_cycle(spark, d):
    """Dossiers through bronze files to silver files; the promotion counts."""
    target = Lake(_path(spark, "lake"))
    settings = CycleSettings(b.SALT, at=b.at())
    to_bronze(_documents(spark, d), target, settings)
    return to_silver(spark, target, settings), target


register(
    "bronze_to_silver_files",
    lambda spark, d: _lake_cycle(spark, d)[0],
    s.query(
        """SELECT count(*) AS total_processed, count(*) FILTER (is_valid) AS promoted_to_silver,
             count(*) FILTER (NOT is_valid) AS quarantined_anomalies, 0 AS errors FROM text_gate""",
        "text_gate",
    ),
)


def _silver_files(spark, d):
    path = _path(spark, "silver")
    lake.write_silver(b.silver(spark, d), path)
    return lake.read_silver(spark, path)


register("write_and_read_silver", _silver_files, s.query("SELECT * FROM silver", "silver"))


def _quarantine_files(spark, d):
    path = _path(spark, "quarantine")
    lake.write_quarantine(b.quarantine(spark, d), path)
    return quality.flatten_quarantine(lake.read_quarantine(spark, path))


register("write_and_read_quarantine", _quarantine_files, s.query("SELECT * FROM quarantine", "quarantine"))


def _gold(spark, d):
    target = Lake(_path(spark, "lake"))
    built = b.star(spark, d)
    return target, lake.export_tables(built.tables(), target.gold)


def _manifest(spark, d):
    _, written = _gold(spark, d)
    return lake.manifest(spark, written, "silver", 0).select("table_name", "rows", "type")


_TABLES = list(star.Star.__dataclass_fields__)
register(
    "manifest",
    _manifest,
    s.query(
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, count(*) AS rows, '{'consolidated_mart' if n.endswith('mart') else 'star_schema_table'}' AS type "
            f"FROM {'mart' if n.endswith('mart') else n}"
            for n in _TABLES
        ),
        *["mart" if n.endswith("mart") else n for n in _TABLES],
    ),
)


def _feeds(spark, d):
    target, written = _gold(spark, d)
    feeds = lake.write_feeds(spark, {n: p for n, (p, _) in written.items()}, target.feed)
    schema = spark.read.parquet(target.gold("dim_incident_classification")).schema
    return spark.read.schema(schema).option("header", True).csv(feeds["dim_incident_classification"])


register("csv_feeds", _feeds, s.query("SELECT * FROM dim_incident_classification", "dim_incident_classification"))


def _audit_files(spark, d):
    json_path, ledger_path = _path(spark, "reports"), _path(spark, "audit_ledger")
    reports = b.plain_reports(spark, d)
    lake.write_audit(reports, auditing.ledger(reports), json_path, ledger_path)
    return auditing.ledger(lake.read_audit(spark, json_path)).unionByName(spark.read.parquet(ledger_path)).distinct()


register("write_audit", _audit_files, _LEDGER_SQL)


def _amended(spark, d):
    return chunking.chunk_documents(
        b.sectioned_documents(spark, d)
        .filter(c("text").startswith("Preamble fr"))
        .withColumn("text", F.concat("text", F.lit("\n\nAmended.")))
    )


def _upserted(spark, d):
    return _flat_chunks(lake.upsert_chunks(b.chunks(spark, d), _amended(spark, d)))


_UPSERTED_SQL = s.query(
        f"""SELECT {', '.join(_META)} FROM (
              SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY round DESC) AS n
              FROM (SELECT *, 0 AS round FROM chunks UNION ALL SELECT *, 1 FROM amended_chunks)) WHERE n = 1""",
        "chunks", "amended_chunks",
)
register("upsert_chunks", _upserted, _UPSERTED_SQL)


def _indexed(force: bool):
    """A first load, then amended chunks: they take effect only when that is forced."""

    def run(spark, d):
        path = _path(spark, "chunks")
        lake.index_corpus(b.chunks(spark, d), path)
        return _flat_chunks(lake.index_corpus(_amended(spark, d), path, force))

    return run


register("index_corpus", _indexed(True), _UPSERTED_SQL)
register("index_corpus_skip", _indexed(False), s.query(f"SELECT {', '.join(_META)} FROM chunks", "chunks"))


def _log(spark, d):
    path = _path(spark, "adjudications")
    lake.append_adjudications(_decisions(spark, d), path)
    lake.append_adjudications(_decisions(spark, d), path)
    return lake.read_adjudications(spark, path)


register("append_adjudications", _log, s.query("SELECT * FROM decisions UNION ALL SELECT * FROM decisions", "decisions"))


def _released(spark, d):
    """Half of the decisions logged and applied, then the rest, each twice: where every claim is then."""
    _, target = _lake_cycle(spark, d)
    decisions = _decisions(spark, d)
    for half in (c("adjudication_timestamp") < "2024-01-16", c("adjudication_timestamp") >= "2024-01-16"):
        lake.append_adjudications(decisions.filter(half), target.adjudications)
        for _ in range(2):
            to_release(spark, target, CycleSettings(b.SALT, at=b.at()))
    silver, held = lake.read_silver(spark, target.silver), lake.read_quarantine(spark, target.quarantine)
    parts = [rows.select(F.lit(tier).alias("tier"), "claim_id", "quality_score", "governance_status") for tier, rows in (("silver", silver), ("quarantine", held))]
    return parts[0].unionByName(parts[1])


register(
    "release_claims",
    _released,
    s.query(
        """SELECT CASE WHEN silver THEN 'silver' ELSE 'quarantine' END AS tier, claim_id, quality_score,
             CASE WHEN silver THEN 'VALID_PROMOTED' ELSE 'QUARANTINED' END AS governance_status
           FROM (SELECT *, is_valid OR claim_id IN (SELECT claim_id FROM released) AS silver FROM text_gate)""",
        "text_gate", "released",
    ),
)


def _tiers(spark, d):
    _, target = _lake_cycle(spark, d)
    return tier_status(spark, target)


register(
    "tier_status",
    _tiers,
    s.query(
        """SELECT 'raw' AS tier, 0 AS records UNION ALL SELECT 'bronze', count(*) FROM text_gate
           UNION ALL SELECT 'silver', count(*) FROM text_gate WHERE is_valid
           UNION ALL SELECT 'quarantine', count(*) FROM text_gate WHERE NOT is_valid UNION ALL SELECT 'gold', 0""",
        "text_gate",
    ),
)


def _kpi_document(spark, d):
    path = _path(spark, "kpi")
    summary = measures.kpi_summary(_mart(spark, d))
    lake.write_document(summary, path)
    return spark.read.schema(summary.schema).json(path)


register("write_kpi_summary", _kpi_document, s.query(_KPI_TEXT, "mart"))

# The same figures from partial sums.
_PARTIAL = {
    "kpi_numbers": measures.kpi_numbers,
    "kpi_summary": measures.kpi_summary,
    "dashboard_kpis": measures.dashboard_kpis,
    "net_amount_mtd": measures.net_amount_mtd,
    "net_amount_ytd": measures.net_amount_ytd,
    "claims_count_mtd": measures.claims_count_mtd,
    "exposure_by_province": lambda rows, of: measures.exposure_by(rows, "province", of),
    "exposure_by_tier": lambda rows, of: measures.exposure_by(rows, "dora_regulatory_tier", of),
    "exposure_by_incident_type": measures.exposure_by_incident_type,
}
for _name, _figures in _PARTIAL.items():
    register(
        f"{_name}_of_partials",
        lambda spark, d, figures=_figures: figures(measures.partial_measures(_mart(spark, d))[0], measures.PARTIALS),
        ORACLES[_name],
    )
register(
    "latency_histogram_of_partials",
    lambda spark, d: measures.latency_histogram(measures.partial_measures(_mart(spark, d))[1], of=measures.PARTIALS),
    ORACLES["latency_histogram"],
)
