"""Bronze claims to governed claims: identifiers replaced, defaults filled, raw personal data dropped."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweir import fixed
from claimweir.functions import pii
from claimweir.functions.money import exact
from claimweir.functions.text import filled, utc_text

_KEPT = [
    "claim_id",
    "policy_number",
    "status_banner",
    "filing_date",
    "incident_date",
    "currency",
    "total_loss_amount",
    "total_deductible",
    "total_net_claimed",
    "statutory_attestation",
    "source_filename",
    "source_file_sha256",
    "ingestion_id",
]


#: Amounts from here on are rejected: cents of all below fit the decimals that sums are made of.
MOST_AMOUNT = 1e13


def _beyond(amount: Column) -> Column:
    """NaN is greater than any number, but it is the gate's business."""
    return F.coalesce((F.abs(amount) >= MOST_AMOUNT) & ~F.isnan(amount), F.lit(False))


def payload_columns(envelopes: DataFrame) -> DataFrame:
    """Bronze envelopes as flat columns: the claim and its provenance."""
    return envelopes.select(
        "extracted_payload.*", "source_filename", "source_file_sha256", "ingestion_id"
    )


def ledger_of_items(items: Column) -> Column:
    """What the rules need to know of a claim's items, computed inside the row."""
    # NaN counts as 0 here, which no rule takes for a positive amount; sorted, it would be the greatest number.
    amounts = F.transform(items, lambda item: F.coalesce(F.nanvl(item["amount"], F.lit(0.0)), F.lit(0.0)))
    nets = F.transform(items, lambda item: F.coalesce(F.nanvl(item["net_claimed"], F.lit(0.0)), F.lit(0.0)))
    net_total = F.aggregate(
        nets,
        F.lit(0).cast("decimal(38,4)"),
        lambda total, net: (total + F.coalesce(net.try_cast("decimal(18,4)"), F.lit(0))).try_cast("decimal(38,4)"),
    )
    return F.struct(
        F.coalesce(F.size(items), F.lit(0)).cast("long").alias("items"),
        F.array_min(amounts).alias("least_amount"),
        F.array_min(nets).alias("least_net"),
        F.round(net_total, 2).cast("decimal(38,2)").alias("net_total"),
    )


def ledger_of_lines(lines: DataFrame, key: str, *also: Column) -> DataFrame:
    """The same ledger from a flat table of items, with any other aggregates wanted of them.

    Counts, minima and sums combine before the shuffle, so one claim may own any share of the rows.
    """
    zero = F.lit(0)
    grouped = lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("items"),
        F.min(F.coalesce(F.col("amount"), zero)).cast("double").alias("least_amount"),
        F.min(F.coalesce(F.col("net_claimed"), zero)).cast("double").alias("least_net"),
        F.sum(exact(F.coalesce(F.col("net_claimed"), zero))).cast("decimal(38,2)").alias("net_total"),
        *also,
    )
    ledger = ["items", "least_amount", "least_net", "net_total"]
    return grouped.withColumn("ledger", F.struct(*ledger)).drop(*ledger)


def redaction_actions(clean_narrative: Column) -> Column:
    def tag(name, when):
        return F.when(when, name)

    def given(column):
        return F.col(column) != ""

    return F.array_compact(
        F.array(
            tag(fixed.TAG_PPSN, given("claimant_ppsn")),
            tag(fixed.TAG_NAME, given("claimant_name")),
            tag(fixed.TAG_EMAIL, given("claimant_email")),
            tag(fixed.TAG_PHONE, given("claimant_phone")),
            F.lit(fixed.TAG_GEO),
            tag(
                fixed.TAG_NARRATIVE,
                ~clean_narrative.eqNullSafe(F.col("incident_description")),
            ),
        )
    )


def null_defaults() -> dict[str, Column]:
    return {
        "days_to_notify": F.coalesce(F.col("days_to_notify"), F.lit(0)).cast("long"),
        "dora_classification": F.coalesce(
            filled(F.col("dora_classification")), F.lit(fixed.DEFAULT_TIER)
        ),
        "incident_type": F.coalesce(
            filled(F.col("incident_type")), F.lit(fixed.DEFAULT_INCIDENT)
        ),
    }


def govern(
    claims: DataFrame,
    salt: str,
    mask: str = "*",
    governed_at: Column | None = None,
    ppsn_pattern: str = fixed.PPSN_WHOLE,
) -> DataFrame:
    """Governed claims. The input has the raw claim columns with either line_items or a ledger.

    A record that cannot be governed keeps its row, with the reason in governance_error.
    """
    stamp = F.current_timestamp() if governed_at is None else governed_at
    ledger = (
        F.col("ledger") if "ledger" in claims.columns else ledger_of_items(F.col("line_items"))
    )
    items = [F.col("line_items")] if "line_items" in claims.columns else []
    # Columns of their own, so that what depends on them does not work them out again.
    prepared = claims.withColumns(
        {
            "incident_description_clean": pii.sanitize_narrative(F.col("incident_description")),
            "claimant_email_masked": pii.mask_email(F.col("claimant_email"), mask),
        }
    )
    email, narrative = F.col("claimant_email_masked"), F.col("incident_description_clean")
    required = ["claim_id", "filing_date", "incident_date", "total_net_claimed"]
    problems = [F.when(F.col(name).isNull(), f"missing {name}") for name in required]
    beyond = _beyond(F.col("total_loss_amount")) | _beyond(F.col("total_deductible")) | _beyond(F.col("total_net_claimed"))
    if items:
        item_beyond = F.exists("line_items", lambda item: _beyond(item["amount"]) | _beyond(item["net_claimed"]))
        beyond = beyond | F.coalesce(item_beyond, F.lit(False))
    problems.append(F.when(beyond, "an amount is too large"))
    no_user = pii.at_sign(F.col("claimant_email")) == 1
    problems.append(F.when(no_user, "claimant_email has no user part"))
    return prepared.select(
        *[F.col(name) for name in _KEPT],
        *[column.alias(name) for name, column in null_defaults().items()],
        pii.hash_ppsn(F.col("claimant_ppsn"), salt).alias("claimant_ppsn_hash"),
        pii.ppsn_valid(F.col("claimant_ppsn"), ppsn_pattern).alias("ppsn_format_valid"),
        pii.mask_name(F.col("claimant_name"), mask).alias("claimant_name_masked"),
        email,
        pii.mask_phone(F.col("claimant_phone"), mask).alias("claimant_phone_masked"),
        pii.county(F.col("loss_location")).alias("loss_county"),
        pii.routing_key(F.col("eircode")).alias("eircode_routing_key"),
        narrative,
        redaction_actions(narrative).alias("redaction_actions"),
        utc_text(stamp).alias("governance_timestamp"),
        ledger.alias("ledger"),
        *items,
        filled(F.concat_ws("; ", *problems)).alias("governance_error"),
    )
