"""Regulatory audit of silver and quarantined claims."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweir import fixed, schemas
from claimweir.functions.text import strip, utc_text

_BREACH, _WARNING, _COMPLIANT = "BREACH", "WARNING", "COMPLIANT"


@dataclass(frozen=True)
class Citation:
    section: str
    excerpt: str
    similarity: float

    def plain(self) -> str:
        return f"{self.section}: {self.excerpt}"

    def scored(self) -> str:
        return f"{self.section} (Similarity: {self.similarity:.1%}): {self.excerpt}"


def resolve_citations(citations: DataFrame) -> dict[str, Citation]:
    """The best citation of each of the four areas as values, so that the audit needs no join."""
    areas = [area for area, *_ in fixed.AUDIT_AREAS]
    first = F.min_by(F.struct("regulatory_section", "excerpt", "similarity_score"), F.struct(-F.col("similarity_score"), "regulatory_section", "excerpt"))
    rows = citations.filter(F.col("area").isin(areas)).groupBy("area").agg(first.alias("best")).select("area", "best.*").collect()
    return {
        row["area"]: Citation(row["regulatory_section"], row["excerpt"], row["similarity_score"])
        for row in rows
    }


def population(silver: DataFrame, quarantine: DataFrame) -> DataFrame:
    return silver.unionByName(quarantine, allowMissingColumns=True)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def _euro(amount: Column) -> Column:
    return F.format_string("%,.2f", amount)


@dataclass(frozen=True)
class Check:
    area: str
    violated: Column
    verdict: str
    violation: Column
    observation: Column


def checks() -> list[Check]:
    days = F.coalesce(F.col("days_to_notify"), F.lit(0))
    net = F.coalesce(F.col("total_net_claimed"), F.lit(0.0))
    policy = F.col("policy_number")
    hashed = F.coalesce(F.col("claimant_ppsn_hash").startswith(fixed.HASH_PREFIX), F.lit(False))
    shown_days = days.cast("string")
    sla, identification, valuation, privacy = [area for area, *_ in fixed.AUDIT_AREAS]
    return [
        Check(
            sla,
            days > 90,
            _BREACH,
            _text(
                "Claim filed ", shown_days,
                " days post-incident, violating the statutory 90-day notification window"
                " mandated by Central Bank of Ireland and DORA Article 19.",
            ),
            _text("Claim notification latency of ", shown_days, " days satisfies the statutory SLA."),
        ),
        Check(
            identification,
            F.coalesce(strip(policy).isin(fixed.AUDIT_NO_POLICY), F.lit(True)),
            _BREACH,
            F.lit(
                "Policy number is absent or placeholder. Financial liquidation cannot proceed"
                " against unverified contractual relationships under the CBI Consumer Protection Code."
            ),
            _text("Valid insurance policy reference verified: '", policy, "'."),
        ),
        Check(
            valuation,
            net < 0,
            _BREACH,
            _text(
                "Net liquidation requested amount of EUR ", _euro(net),
                " is negative. Classified as critical accounting irregularity or unauthorized chargeback.",
            ),
            _text("Requested net indemnity of EUR ", _euro(net), " is positive and compliant."),
        ),
        Check(
            privacy,
            ~hashed,
            _WARNING,
            F.lit("Pseudonymized PPSN token could not be verified in the record payload."),
            F.lit("Irish PPSN cryptographically pseudonymized under GDPR Article 4(5)."),
        ),
    ]


def finding(check: Check, cited: Citation) -> Column:
    shown = cited.scored() if check.verdict == _BREACH else cited.plain()
    return F.struct(
        F.lit(check.area).alias("area"),
        F.when(check.violated, check.verdict).otherwise(_COMPLIANT).alias("verdict"),
        F.lit(cited.section).alias("regulatory_section"),
        F.when(check.violated, shown).otherwise(cited.plain()).alias("statutory_citation"),
        F.when(check.violated, check.violation).otherwise(check.observation).alias("observation"),
        F.lit(cited.similarity).cast("double").alias("similarity_score"),
    )


def audit(
    claims: DataFrame, citations: dict[str, Citation], audited_at: Column | None = None
) -> DataFrame:
    """One report per claim. A projection: verdicts and wording come from the row itself."""
    stamp = F.current_timestamp() if audited_at is None else audited_at
    found = checks()
    breaches = [c for c in found if c.verdict == _BREACH]
    warnings = [c for c in found if c.verdict == _WARNING]
    marked = claims.withColumns({f"_{c.area}": c.violated for c in found})

    def areas(of):
        return F.array_compact(F.array(*[F.when(F.col(f"_{c.area}"), c.area) for c in of]))

    marked = marked.withColumns({"_breaches": areas(breaches), "_warnings": areas(warnings)})
    breached, warned = F.size("_breaches") > 0, F.size("_warnings") > 0
    claim = F.coalesce(F.col("claim_id"), F.lit("UNKNOWN_CLAIM"))
    summary = (
        F.when(
            breached,
            _text(
                "AUDIT FAILED: Claim ", claim, " contains ", F.size("_breaches").cast("string"),
                " statutory breach(es): ", F.array_join("_breaches", ", "),
                ". Quarantined pending supervisory certification.",
            ),
        )
        .when(
            warned,
            _text(
                "AUDIT CONDITIONAL: Claim ", claim, " flagged for review (",
                F.size("_warnings").cast("string"), " warning).",
            ),
        )
        .otherwise(
            _text(
                "AUDIT PASSED: Claim ", claim,
                " fully satisfies Central Bank of Ireland and DORA statutory requirements"
                " across filing latency, policy validity, valuation, and privacy.",
            )
        )
    )
    cited = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"_{area}"), F.lit(record))
                for area, _, _, _, _, record in fixed.AUDIT_AREAS
                if record
            ]
        )
    )
    return marked.select(
        claim.alias("claim_id"),
        F.when(breached, "REGULATORY_BREACH")
        .when(warned, "REQUIRES_REVIEW")
        .otherwise("COMPLIANT")
        .alias("overall_verdict"),
        "policy_number",
        F.coalesce(F.col("total_net_claimed"), F.lit(0.0)).alias("total_net_claimed"),
        F.coalesce(F.col("days_to_notify"), F.lit(0)).cast("long").alias("days_to_notify"),
        F.coalesce(F.col("dora_classification"), F.lit(fixed.DEFAULT_TIER)).alias(
            "dora_classification"
        ),
        F.array(*[finding(c, citations[c.area]) for c in found])
        .cast(schemas.AUDIT_REPORT["findings"].dataType)
        .alias("findings"),
        cited.alias("regulatory_citations_cited"),
        utc_text(stamp).alias("audit_timestamp"),
        summary.alias("supervisory_summary"),
    )


def ledger(reports: DataFrame) -> DataFrame:
    """The flat form of the reports, eleven columns."""
    breaches = F.size(F.filter("findings", lambda f: f["verdict"] == _BREACH))
    cited = F.col("regulatory_citations_cited")
    return reports.select(
        "claim_id",
        "overall_verdict",
        "policy_number",
        "total_net_claimed",
        "days_to_notify",
        "dora_classification",
        breaches.cast("long").alias("num_breaches"),
        F.size(cited).cast("long").alias("citations_count"),
        F.array_join(cited, ", ").alias("cited_articles"),
        "audit_timestamp",
        "supervisory_summary",
    )


def verdict_counts(reports: DataFrame) -> DataFrame:
    verdict = F.col("overall_verdict")
    return reports.agg(
        F.count(F.lit(1)).alias("total_audited"),
        F.count_if(verdict == "COMPLIANT").alias("compliant"),
        F.count_if(verdict == "REGULATORY_BREACH").alias("regulatory_breaches"),
        F.count_if(verdict == "REQUIRES_REVIEW").alias("requires_review"),
    )


def citation_frequency(reports: DataFrame) -> DataFrame:
    cited = reports.select(F.explode_outer("regulatory_citations_cited").alias("citation")).dropna()
    return cited.groupBy("citation").agg(F.count(F.lit(1)).alias("times"))
