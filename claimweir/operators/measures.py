"""Portfolio measures over the fact table and the mart."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweir.functions.money import exact, ratio
from claimweir.sources.staging import stage

MONEY = ["gross_loss_amount", "deductible_amount", "net_claimed_amount"]
KINDS = [
    "filing_date",
    "province",
    "incident_type",
    "dora_classification",
    "dora_regulatory_tier",
    "is_ict_related",
    "is_timely_sla_compliant",
    "is_major_dora_incident",
]


class Rows:
    """How a measure is worked out from rows of the fact table or the mart."""

    def claims(self, flag: Column | None = None) -> Column:
        return F.count(F.lit(1)) if flag is None else F.count_if(flag)

    def sum(self, name: str, flag: Column | None = None) -> Column:
        """An exact sum of money, line items, days or quality."""
        value = F.col(name) if flag is None else F.when(flag, F.col(name))
        if name in MONEY:
            return F.sum(exact(value))
        return F.sum(value.cast("decimal(9,4)") if name == "quality_score" else value)

    def known(self, name: str) -> Column:
        return F.count(name)

    def most(self, name: str) -> Column:
        return F.max(name)


class Partials(Rows):
    """The same from partial sums of such rows, see partial_measures."""

    def claims(self, flag: Column | None = None) -> Column:
        claims = F.col("claims") if flag is None else F.when(flag, F.col("claims"))
        return F.coalesce(F.sum(claims), F.lit(0))

    def sum(self, name: str, flag: Column | None = None) -> Column:
        return F.sum(name if flag is None else F.when(flag, F.col(name)))

    def known(self, name: str) -> Column:
        return F.coalesce(F.sum(f"{name}_known"), F.lit(0))

    def most(self, name: str) -> Column:
        return F.max(f"{name}_most")


ROWS = Rows()
PARTIALS = Partials()


def partial_measures(mart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums from which every figure of the mart follows, from one scan: by day and kind of claim, and by days to notify.

    Sums of cents, counts and maxima merge in any order, so figures of the whole, of a group or to a date are sums of these rows. Their
    number depends on the calendar and the kinds of claims, not on how many there are. Grouping sets feed both from one scan, which
    combines before its shuffle, and the rows are written once for all readers.
    """
    sums = [ROWS.claims().alias("claims")]
    sums += [ROWS.sum(name).alias(name) for name in (*MONEY, "num_line_items", "quality_score")]
    sums += [ROWS.sum("days_to_notify").alias("days_sum"), *[ROWS.known(n).alias(f"{n}_known") for n in ("net_claimed_amount", "days_to_notify")]]
    sums += [ROWS.most("net_claimed_amount").alias("net_claimed_amount_most")]
    keys = [F.col(k) for k in (*KINDS, "days")]
    rows = mart.withColumn("days", F.col("days_to_notify"))
    found = rows.groupingSets([keys[:-1], keys[-1:]], *keys).agg(F.grouping("days").alias("_by_kind"), *sums)
    written = stage(found, "partial_measures", by="_by_kind")
    by_kind = written.filter("_by_kind = 1").drop("_by_kind", "days").withColumnRenamed("days_sum", "days_to_notify")
    return by_kind, written.filter("_by_kind = 0").select(F.col("days").alias("days_to_notify"), "claims")


def _timely() -> Column:
    return F.col("is_timely_sla_compliant") == 1


def _major() -> Column:
    return F.col("is_major_dora_incident") == 1


def _double(value: Column) -> Column:
    return value.cast("double")


def catalogue(of: Rows = ROWS) -> dict[str, Column]:
    """The scalar measures of the fact table by name, each an aggregate expression."""
    claims, items = of.claims(), of.sum("num_line_items")
    net = _double(of.sum("net_claimed_amount"))
    major_net = _double(of.sum("net_claimed_amount", _major()))
    return {
        "total_gross_loss": _double(of.sum("gross_loss_amount")),
        "total_deductibles": _double(of.sum("deductible_amount")),
        "total_net_claimed": net,
        "average_net_claim": F.try_divide(net, of.known("net_claimed_amount")),
        "max_single_claim": of.most("net_claimed_amount"),
        "total_claims": claims,
        "average_latency_days": F.try_divide(_double(of.sum("days_to_notify")), claims),
        "average_quality_score": F.try_divide(_double(of.sum("quality_score")), claims),
        "total_line_items": items,
        "average_items_per_claim": ratio(items, claims),
        "sla_compliant_claims": of.claims(_timely()),
        "sla_compliance_rate": ratio(of.claims(_timely()), claims),
        "major_incidents": of.claims(_major()),
        "major_exposure": major_net,
        "major_exposure_share": ratio(major_net, net),
    }


def measure(fact: DataFrame, *names: str) -> DataFrame:
    """Chosen measures, or all of them, in one row and one scan."""
    known = catalogue()
    return fact.agg(*[known[name].alias(name) for name in names or known])


def measures_by(fact: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """The same measures per group."""
    known = catalogue()
    return fact.groupBy(*keys).agg(*[known[name].alias(name) for name in names or known])


def ict_exposure(fact: DataFrame, dim_incident_classification: DataFrame) -> DataFrame:
    """Net amount of claims whose classification is ICT related.

    Amounts are first added up per classification, so only one row per classification meets the dimension.
    """
    per_kind = fact.groupBy("incident_type_key").agg(F.sum(exact(F.col("net_claimed_amount"))).alias("net"))
    kinds = dim_incident_classification.filter("is_ict_related").select("incident_type_key")
    return per_kind.join(kinds, "incident_type_key", "left_semi").agg(
        F.sum("net").cast("double").alias("ict_related_exposure")
    )


def _daily(mart: DataFrame, of: Rows) -> DataFrame:
    """Amount and claims per filing date: the calendar bounds what the windows below see."""
    return mart.groupBy(F.col("filing_date").alias("full_date")).agg(
        of.sum("net_claimed_amount").alias("net"), of.claims().alias("claims")
    )


def _to_date(mart: DataFrame, of: Rows, value: str, name: str, *period) -> DataFrame:
    day = F.col("full_date")
    window = (
        Window.partitionBy(*[part(day) for part in period])
        .orderBy("full_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    kind = "double" if value == "net" else "long"
    return _daily(mart, of).select("full_date", F.sum(value).over(window).cast(kind).alias(name))


def net_amount_mtd(mart: DataFrame, of: Rows = ROWS) -> DataFrame:
    return _to_date(mart, of, "net", "net_amount_mtd", F.year, F.month)


def net_amount_ytd(mart: DataFrame, of: Rows = ROWS) -> DataFrame:
    return _to_date(mart, of, "net", "net_amount_ytd", F.year)


def claims_count_mtd(mart: DataFrame, of: Rows = ROWS) -> DataFrame:
    return _to_date(mart, of, "claims", "claims_count_mtd", F.year, F.month)


def kpi_numbers(mart: DataFrame, of: Rows = ROWS) -> DataFrame:
    """Rounded executive figures in one row, of mart rows or of partial sums."""
    known = catalogue(of)

    def rounded(name, places=2, times=1):
        return F.round(known[name] * times, places)

    ict = F.col("is_ict_related")
    base = mart.agg(
        known["total_claims"].alias("total_claims"),
        rounded("total_gross_loss").alias("total_gross_loss"),
        rounded("total_deductibles").alias("total_deductibles"),
        rounded("total_net_claimed").alias("total_net_claimed"),
        rounded("average_net_claim").alias("avg_claim_value"),
        rounded("max_single_claim").alias("max_single_claim"),
        rounded("average_latency_days", 1).alias("avg_latency_days"),
        rounded("average_quality_score", 1, 100).alias("avg_quality_pct"),
        known["total_line_items"].alias("total_items"),
        known["sla_compliant_claims"].alias("sla_compliant_claims"),
        known["major_incidents"].alias("major_dora_claims"),
        F.coalesce(rounded("major_exposure"), F.lit(0.0)).alias("major_dora_exposure"),
        F.coalesce(F.round(_double(of.sum("net_claimed_amount", ict)), 2), F.lit(0.0)).alias(
            "ict_related_exposure"
        ),
    )

    def percent(part, whole):
        return F.round(ratio(F.col(part), F.col(whole)) * 100, 1)

    return base.withColumns(
        {
            "sla_compliance_pct": percent("sla_compliant_claims", "total_claims"),
            "major_dora_pct": percent("major_dora_exposure", "total_net_claimed"),
            "ict_related_pct": percent("ict_related_exposure", "total_net_claimed"),
        }
    )


def euro(amount: Column) -> Column:
    return F.format_string("EUR %,.2f", F.coalesce(amount, F.lit(0.0)))


def kpi_summary(mart: DataFrame, of: Rows = ROWS) -> DataFrame:
    """The twelve named outputs as printed text; counts stay numbers."""
    c = F.col

    def tenths(name, unit):
        return F.format_string(f"%.1f{unit}", F.coalesce(c(name), F.lit(0.0)))

    def with_share(amount, share):
        return F.concat(euro(c(amount)), F.format_string(" (%.1f%% of portfolio)", c(share)))

    return kpi_numbers(mart, of).select(
        c("total_claims").alias("Total Claims"),
        euro(c("total_gross_loss")).alias("Total Gross Loss"),
        euro(c("total_deductibles")).alias("Total Deductibles Applied"),
        euro(c("total_net_claimed")).alias("Total Net Claim Amount"),
        euro(c("avg_claim_value")).alias("Average Net Claim Value"),
        euro(c("max_single_claim")).alias("Max Single Claim Exposure"),
        tenths("avg_latency_days", " days").alias("Average Notice Latency"),
        tenths("avg_quality_pct", "%%").alias("Average Data Quality Score"),
        tenths("sla_compliance_pct", "%%").alias("Statutory SLA Compliance Rate"),
        c("major_dora_claims").alias("Major DORA Incidents"),
        with_share("major_dora_exposure", "major_dora_pct").alias("Major DORA Total Exposure"),
        with_share("ict_related_exposure", "ict_related_pct").alias("ICT Related Claims Exposure"),
    )


def exposure_by(mart: DataFrame, key: str, of: Rows = ROWS) -> DataFrame:
    return mart.groupBy(key).agg(_double(of.sum("net_claimed_amount")).alias("net_claimed_amount"))


def exposure_by_incident_type(mart: DataFrame, of: Rows = ROWS) -> DataFrame:
    """Least exposure first; equal amounts by name."""
    return exposure_by(mart, "incident_type", of).orderBy("net_claimed_amount", "incident_type")


def latency_histogram(mart: DataFrame, bins: int = 12, limit: int = 90, of: Rows = ROWS) -> DataFrame:
    """Equal-width bins over days_to_notify, and whether a bin ends beyond the limit.

    Claims are counted per number of days first, in one scan, so the bins are cut over that short list. Partial sums are those by
    days.
    """
    per_day = stage(mart.groupBy("days_to_notify").agg(of.claims().alias("claims")), "latency")
    least = per_day.select(F.min("days_to_notify")).scalar().cast("double")
    most = per_day.select(F.max("days_to_notify")).scalar().cast("double")
    width = F.when(most > least, (most - least) / bins).otherwise(F.lit(1.0))
    position = F.floor((F.col("days_to_notify") - least) / width)
    return (
        per_day.select(
            F.least(position, F.lit(bins - 1)).cast("long").alias("bin"),
            (least + F.least(position, F.lit(bins - 1)) * width).alias("from_days"),
            width.alias("width"),
            "claims",
        )
        .groupBy("bin", "from_days", "width")
        .agg(F.sum("claims").alias("claims"))
        .select(
            "bin",
            "from_days",
            (F.col("from_days") + F.col("width")).alias("to_days"),
            "claims",
            (F.col("from_days") + F.col("width") > limit).alias("beyond_limit"),
        )
    )


def dashboard_kpis(mart: DataFrame, of: Rows = ROWS) -> DataFrame:
    major = F.col("dora_classification").contains("Major ICT")

    def net_of(flag: Column | None = None) -> Column:
        return F.coalesce(_double(of.sum("net_claimed_amount", flag)), F.lit(0.0))

    net, major_net, ict_net = net_of(), net_of(major), net_of(F.col("is_ict_related"))

    def percent(part):
        return F.when(net > 0, part / net * 100).otherwise(0.0)

    return mart.agg(
        of.claims().alias("total_claims"),
        net.alias("total_net"),
        F.coalesce(_double(of.sum("gross_loss_amount")), F.lit(0.0)).alias("total_gross"),
        F.try_divide(_double(of.sum("net_claimed_amount")), of.known("net_claimed_amount")).alias("average_net"),
        F.try_divide(_double(of.sum("days_to_notify")), of.known("days_to_notify")).alias("average_latency"),
        major_net.alias("major_exposure"),
        percent(major_net).alias("major_pct"),
        ict_net.alias("ict_exposure"),
        percent(ict_net).alias("ict_pct"),
    )
