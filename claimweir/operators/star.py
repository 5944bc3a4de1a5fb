"""Silver claims to the star schema: five dimensions, one fact table and the wide mart.

Every function takes silver as a table that is cheap to read several times, that is, one already written.
"""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweir import fixed
from claimweir.operators.lookup import SMALL_ROWS, FrequentKeys, lookup_join
from claimweir.operators.numbering import number_ranges, number_rows
from claimweir.sources.staging import stage

GEOGRAPHY = ["loss_county", "eircode_routing_key"]
INCIDENT = ["incident_type", "dora_classification"]
CLAIMANT = [
    "claimant_ppsn_hash",
    "claimant_name_masked",
    "claimant_email_masked",
    "claimant_phone_masked",
]

FACT = [
    "claim_key",
    "claim_id",
    "filing_date_key",
    "incident_date_key",
    "geography_key",
    "incident_type_key",
    "policy_key",
    "claimant_key",
    "gross_loss_amount",
    "deductible_amount",
    "net_claimed_amount",
    "currency",
    "days_to_notify",
    "quality_score",
    "num_line_items",
    "is_timely_sla_compliant",
    "is_major_dora_incident",
    "ingestion_id",
    "source_filename",
    "source_file_sha256",
    "gold_load_timestamp",
]

MART = [
    "claim_key",
    "claim_id",
    "policy_number",
    "filing_date",
    "incident_date",
    "days_to_notify",
    "is_timely_sla_compliant",
    "incident_type",
    "dora_classification",
    "dora_regulatory_tier",
    "is_ict_related",
    "loss_county",
    "province",
    "eircode_routing_key",
    "claimant_ppsn_hash",
    "claimant_name_masked",
    "email_domain",
    "gross_loss_amount",
    "deductible_amount",
    "net_claimed_amount",
    "currency",
    "quality_score",
    "num_line_items",
    "is_major_dora_incident",
    "ingestion_id",
    "source_filename",
    "gold_load_timestamp",
]


#: What gold does not read of silver: a table of silver that only gold reads can do without.
UNREAD = ["incident_description_clean", "statutory_attestation", "lakehouse_promotion_timestamp"]


def date_of(text: Column) -> Column:
    """A full ISO date, or null: partial and impossible dates do not pass."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("date"))


def date_key(date: Column) -> Column:
    return F.year(date) * 10000 + F.month(date) * 100 + F.day(date)


def is_major(tier: Column) -> Column:
    return F.coalesce(tier.contains("Major ICT"), F.lit(False))


def is_ict(incident: Column) -> Column:
    return F.coalesce(incident.contains("Cyber") | incident.contains("ICT"), F.lit(False))


def regulatory_tier(tier: Column) -> Column:
    return (
        F.when(tier.contains("Major ICT"), fixed.TIER_1)
        .when(tier.contains("Significant"), fixed.TIER_2)
        .otherwise(fixed.TIER_3)
    )


def province(county: Column) -> Column:
    mapped = F
    for name, counties in fixed.PROVINCES.items():
        mapped = mapped.when(county.isin(counties), name)
    return mapped.otherwise(fixed.OTHER_PROVINCE)


def timely_flag(days: Column, limit: int = 90) -> Column:
    return F.when(days <= limit, 1).otherwise(0)


MEMBERS = {
    "date": ["full_date"],
    "geography": GEOGRAPHY,
    "incident": INCIDENT,
    "policy": ["policy_number", "governance_status"],
    "claimant": CLAIMANT,
}


def dimension_members(silver: DataFrame) -> dict[str, DataFrame]:
    """The distinct members of all dimensions, from one scan of silver.

    Grouping sets send a row once for each dimension to the same aggregation, which combines before its one shuffle; the members
    are written by dimension, so that each of them reads its own.
    """
    sets = [["_filed"], ["_incident"], *[MEMBERS[name] for name in MEMBERS if name != "date"]]
    names = ["date", "date", *[name for name in MEMBERS if name != "date"]]
    columns = [c for one in sets for c in one]
    dated = silver.select(*columns[2:], date_of(F.col("filing_date")).alias("_filed"), date_of(F.col("incident_date")).alias("_incident"))
    # a bit of grouping_id is set for each column that a set does not group by
    ids = [sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in one) for one in sets]
    found = dated.groupingSets([[F.col(c) for c in one] for one in sets], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("_set"))
    named = F
    for name, number in zip(names, ids, strict=True):
        named = named.when(F.col("_set") == number, name)
    found = found.withColumn("_dimension", named).withColumn("full_date", F.coalesce("_filed", "_incident"))
    written = stage(found.select("_dimension", *[c for own in MEMBERS.values() for c in own]), "members", by="_dimension")
    own = {name: written.filter(F.col("_dimension") == name).select(*columns) for name, columns in MEMBERS.items()}
    return own | {"date": own["date"].dropna().distinct()}


def dim_date(silver: DataFrame) -> DataFrame:
    both = F.array(date_of(F.col("filing_date")), date_of(F.col("incident_date")))
    return _dim_date(silver.select(F.explode(both).alias("full_date")).dropna().distinct())


def _dim_date(dates: DataFrame) -> DataFrame:
    day = F.col("full_date")
    weekday = F.dayofweek(day) - 1
    return dates.select(
        date_key(day).alias("date_key"),
        day,
        F.year(day).cast("long").alias("year"),
        F.quarter(day).cast("long").alias("quarter"),
        F.month(day).cast("long").alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.day(day).cast("long").alias("day_of_month"),
        weekday.cast("long").alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.coalesce(weekday.isin(0, 6), F.lit(False)).alias("is_weekend"),
    )


def dim_geography(silver: DataFrame) -> DataFrame:
    return _dim_geography(stage(silver.select(*GEOGRAPHY).distinct(), "geography"))


def _dim_geography(places: DataFrame) -> DataFrame:
    return number_ranges(places, GEOGRAPHY, "geography_key").select(
        "geography_key",
        "loss_county",
        province(F.col("loss_county")).alias("province"),
        "eircode_routing_key",
        F.lit(fixed.COUNTRY).alias("country"),
    )


def dim_incident_classification(silver: DataFrame) -> DataFrame:
    return _dim_incident_classification(stage(silver.select(*INCIDENT).distinct(), "incident"))


def _dim_incident_classification(kinds: DataFrame) -> DataFrame:
    return number_ranges(kinds, INCIDENT, "incident_type_key").select(
        "incident_type_key",
        "incident_type",
        "dora_classification",
        regulatory_tier(F.col("dora_classification")).alias("dora_regulatory_tier"),
        is_ict(F.col("incident_type")).alias("is_ict_related"),
    )


def dim_policy(silver: DataFrame) -> DataFrame:
    return _dim_policy(stage(silver.select(*MEMBERS["policy"]).distinct(), "policy"))


def _dim_policy(policies: DataFrame) -> DataFrame:
    return number_ranges(policies, MEMBERS["policy"], "policy_key").select(
        "policy_key",
        *MEMBERS["policy"],
        F.lit(fixed.CONTRACT_STATUS).alias("contract_status"),
        F.lit(fixed.UNDERWRITER).alias("underwriting_entity"),
    )


def dim_claimant(
    silver: DataFrame, one_row_per_hash: bool = False
) -> DataFrame:
    """Claimants by their masked identity.

    A person with two addresses has two rows, and the fact join then repeats that person's claims. With
    one_row_per_hash the least identity of each hash is kept, so that nothing repeats.
    """
    return _dim_claimant(stage(silver.select(*CLAIMANT).distinct(), "claimant"), one_row_per_hash)


def _dim_claimant(people: DataFrame, one_row_per_hash: bool) -> DataFrame:
    if one_row_per_hash:
        rest = F.struct(*CLAIMANT[1:])
        people = people.groupBy("claimant_ppsn_hash").agg(F.min(rest).alias("least"))
        people = stage(people.select("claimant_ppsn_hash", "least.*"), "claimant")
    return number_ranges(people, CLAIMANT, "claimant_key").select(
        "claimant_key",
        "claimant_ppsn_hash",
        "claimant_name_masked",
        F.split_part("claimant_email_masked", F.lit("@"), F.lit(2)).alias("email_domain"),
        F.substring("claimant_phone_masked", 1, 7).alias("phone_country_prefix"),
        F.lit(fixed.CLAIMANT_CATEGORY).alias("claimant_category"),
    )


@dataclass(frozen=True)
class Star:
    dim_date: DataFrame
    dim_geography: DataFrame
    dim_incident_classification: DataFrame
    dim_policy: DataFrame
    dim_claimant: DataFrame
    fact_claims: DataFrame
    claims_analytical_mart: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.__dict__)


def rejected_claims(silver: DataFrame) -> DataFrame:
    """Promoted claims that gold cannot hold, and why: every claim is here or in the fact table, by claim_id."""
    reasons = [F.when(date_of(F.col(name)).isNull(), f"{name} is no date") for name in ("filing_date", "incident_date")]
    reasons += [F.when(F.col(name).isNull(), f"missing {name}") for name in (*GEOGRAPHY, *INCIDENT, "policy_number", "claimant_ppsn_hash")]
    marked = silver.select("claim_id", "ingestion_id", F.concat_ws("; ", *reasons).alias("reason"))
    return marked.filter(F.col("reason") != "")


def _dated(silver: DataFrame) -> DataFrame:
    """Silver with real dates and without the columns that no gold table has."""
    dates = {name: date_of(F.col(name)) for name in ("filing_date", "incident_date")}
    unused = [*CLAIMANT[1:], *UNREAD, "governance_status"]
    return silver.withColumns(dates).dropna(subset=list(dates)).drop(*unused)


def _measured(rows: DataFrame) -> DataFrame:
    """The measures and flags of the fact table under their names there."""
    return rows.withColumns(
        {
            "gross_loss_amount": F.col("total_loss_amount"),
            "deductible_amount": F.col("total_deductible"),
            "net_claimed_amount": F.col("total_net_claimed"),
            "is_timely_sla_compliant": timely_flag(F.col("days_to_notify")),
            "is_major_dora_incident": is_major(F.col("dora_classification")).cast("int"),
        }
    )


def unnumbered_mart(
    silver: DataFrame, small_rows: int = SMALL_ROWS, hot_rows: int | None = None
) -> DataFrame:
    """The rows of the mart without claim_key and load time, for measures that need neither.

    Everything a dimension adds is a function of the claim itself, so that only the claimants are joined: they can
    repeat a claim. The rest of the dimension joins comes down to dropping rows with a null key. Silver has one
    governance status, hence one row per policy.
    """
    people = silver.select(*CLAIMANT).distinct().select(
        "claimant_ppsn_hash",
        "claimant_name_masked",
        F.split_part("claimant_email_masked", F.lit("@"), F.lit(2)).alias("email_domain"),
    )
    people = stage(people, "people")  # counted, then joined
    keyed = _dated(silver).dropna(subset=[*GEOGRAPHY, *INCIDENT, "policy_number"])
    rows = lookup_join(
        keyed, people, ["claimant_ppsn_hash"], small_rows=small_rows, heat=FrequentKeys(silver, [["claimant_ppsn_hash"]], hot_rows)
    )
    described = _measured(rows).withColumns(
        {
            "province": province(F.col("loss_county")),
            "dora_regulatory_tier": regulatory_tier(F.col("dora_classification")),
            "is_ict_related": is_ict(F.col("incident_type")),
        }
    )
    return described.select(*[n for n in MART if n not in ("claim_key", "gold_load_timestamp")])


def _joined(
    silver: DataFrame,
    geography: DataFrame,
    incident: DataFrame,
    policy: DataFrame,
    claimant: DataFrame,
    small_rows: int,
    hot_rows: int | None,
) -> DataFrame:
    """Silver with the keys and attributes of all dimensions: one row per match, as the fact table has it.

    A date key is a function of the date, so both date lookups come down to dropping rows without a date.
    """
    dated = _dated(silver)
    heat = FrequentKeys(silver, [GEOGRAPHY, INCIDENT, ["policy_number"], ["claimant_ppsn_hash"]], hot_rows)

    def to(facts, lookup, on):
        return lookup_join(facts, lookup, on, small_rows=small_rows, heat=heat)

    joined = to(dated, geography.drop("country"), GEOGRAPHY)
    joined = to(joined, incident, INCIDENT)
    joined = to(joined, policy.select("policy_key", "policy_number"), ["policy_number"])
    return to(
        joined,
        claimant.drop("phone_country_prefix", "claimant_category"),
        ["claimant_ppsn_hash"],
    )


def build_star(
    silver: DataFrame,
    loaded_at: Column | None = None,
    one_row_per_hash: bool = False,
    small_rows: int = SMALL_ROWS,
    hot_rows: int | None = None,
) -> Star:
    members = dimension_members(silver)
    builders = [
        lambda: _dim_geography(members["geography"]),
        lambda: _dim_incident_classification(members["incident"]),
        lambda: _dim_policy(members["policy"]),
        lambda: _dim_claimant(members["claimant"], one_row_per_hash),
    ]
    # Four independent sets of jobs, submitted together.
    with ThreadPoolExecutor(len(builders)) as pool:
        geography, incident, policy, claimant = pool.map(lambda build: build(), builders)
    joined = _joined(silver, geography, incident, policy, claimant, small_rows, hot_rows)
    order = ["claim_id", "claimant_key", "policy_key", "ingestion_id"]
    wide = _measured(number_rows(joined, order, "claim_key")).withColumns(
        {
            "filing_date_key": date_key(F.col("filing_date")),
            "incident_date_key": date_key(F.col("incident_date")),
            "gold_load_timestamp": F.current_timestamp() if loaded_at is None else loaded_at,
        }
    )
    return Star(
        _dim_date(members["date"]),
        geography,
        incident,
        policy,
        claimant,
        wide.select(*FACT),
        wide.select(*MART),
    )


def mart_preview(mart: DataFrame, rows: int = 5) -> DataFrame:
    """First rows of the mart by claim key."""
    columns = [
        "claim_id",
        "province",
        "incident_type",
        "dora_regulatory_tier",
        "net_claimed_amount",
        "is_timely_sla_compliant",
    ]
    return mart.orderBy("claim_key").limit(rows).select(*columns)
