"""Seven quality rules, the score, the gate, and the two routes behind it."""

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweir import fixed, schemas
from claimweir.functions.money import exact
from claimweir.functions.text import filled, is_blank, money_text, utc_text


@dataclass(frozen=True)
class RuleSettings:
    max_notification_days: int = 90
    allowed_currencies: tuple[str, ...] = tuple(fixed.ALLOWED_CURRENCIES)
    tolerance: str = "0.05"
    min_score: float = 0.85
    critical: tuple[str, ...] = (fixed.RULE_POLICY, fixed.RULE_AMOUNTS, fixed.RULE_TIMELY)
    ppsn_pattern: str = fixed.PPSN_WHOLE

    @classmethod
    def from_declarations(cls, rules: Iterable[Mapping], **changes) -> "RuleSettings":
        """Settings from a declared rule table: one mapping per rule with id, severity and its parameters."""
        by_id = {rule["id"]: rule for rule in rules}
        parameters = {
            "max_notification_days": (fixed.RULE_TIMELY, "max_latency_days", int),
            "allowed_currencies": (fixed.RULE_CURRENCY, "allowed_currencies", tuple),
            "tolerance": (fixed.RULE_LEDGER, "rounding_tolerance_eur", str),
            "ppsn_pattern": (fixed.RULE_PPSN, "pattern", str),
        }
        given = {
            name: convert(by_id[rule][key])
            for name, (rule, key, convert) in parameters.items()
            if key in by_id.get(rule, {})
        }
        critical = tuple(i for i, rule in by_id.items() if rule.get("severity") == "CRITICAL")
        return replace(cls(critical=critical, **given), **changes)


@dataclass(frozen=True)
class Rule:
    name: str
    passed: Column
    description: str
    details: Column

    @property
    def flag(self) -> str:
        return "passed_" + self.name.removeprefix("RULE_").lower()


def _text(*parts) -> Column:
    """Parts as one text; a part without a value prints as None."""
    return F.concat(*[F.lit(part) if isinstance(part, str) else F.coalesce(part, F.lit("None")) for part in parts])


def _true_false(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")


def rules(settings: RuleSettings = RuleSettings()) -> list[Rule]:
    policy, days = F.col("policy_number"), F.col("days_to_notify")
    net, gross, currency = F.col("total_net_claimed"), F.col("total_loss_amount"), F.col("currency")
    ledger = F.col("ledger")
    has_items = ledger["items"] > 0
    off_by = F.abs(ledger["net_total"] - exact(net))
    items_total = F.when(has_items, ledger["net_total"]).otherwise(F.lit(0))
    named = ["claim_id", "filing_date", "incident_date", "incident_type"]
    complete = F.col("loss_county") != fixed.UNKNOWN_COUNTY
    for name in named:
        complete = complete & filled(F.col(name)).isNotNull()
    limit = settings.max_notification_days
    allowed = list(settings.allowed_currencies)

    def sure(condition):
        return F.coalesce(condition, F.lit(False))

    return [
        Rule(
            fixed.RULE_POLICY,
            ~is_blank(policy),
            "Insurance policy identifier must be populated and non-null.",
            _text("Policy number: '", F.coalesce(policy, F.lit("None")), "'"),
        ),
        Rule(
            fixed.RULE_AMOUNTS,
            sure(
                (net > 0)
                & (gross > 0)
                & ~F.isnan(net)
                & ~F.isnan(gross)
                & (~has_items | ((ledger["least_amount"] > 0) & (ledger["least_net"] > 0)))
            ),
            "Financial claim loss amounts and net requested values must be strictly positive.",
            _text("Total Net Claimed: ", money_text(net), ", Total Loss: ", money_text(gross)),
        ),
        Rule(
            fixed.RULE_TIMELY,
            sure(days <= limit),
            f"Incident notification must not exceed statutory limit of {limit} days.",
            _text(
                "Elapsed days to notice: ", days.cast("string"), f" (Max allowed: {limit})"
            ),
        ),
        Rule(
            fixed.RULE_CURRENCY,
            sure(currency.isin(allowed)),
            f"Currency must be an authorized ISO code: {allowed}.",
            _text("Document currency: '", currency, "'"),
        ),
        Rule(
            fixed.RULE_PPSN,
            sure(F.col("ppsn_format_valid")),
            "Irish Personal Public Service Number must adhere to statutory 7-digit + letter syntax.",
            _text("PPSN Valid Format: ", _true_false(F.col("ppsn_format_valid"))),
        ),
        Rule(
            fixed.RULE_LEDGER,
            sure(has_items & (off_by < F.lit(settings.tolerance).cast("decimal(18,4)"))),
            "Sum of itemized net claim values must reconcile with stated aggregate liquidation total.",
            _text("Line items sum: ", money_text(items_total), ", Aggregate total: ", money_text(net)),
        ),
        Rule(
            fixed.RULE_METADATA,
            sure(complete),
            "Core operational metadata (dates, claim type, regional county) must be non-empty.",
            _text("Metadata completeness verified: ", _true_false(complete)),
        ),
    ]


def evaluate(governed: DataFrame, settings: RuleSettings = RuleSettings()) -> DataFrame:
    """Governed claims with one flag per rule, the score and the gate."""
    checks = rules(settings)
    flagged = governed.withColumns({rule.flag: rule.passed for rule in checks})
    passed = sum((F.col(rule.flag).cast("int") for rule in checks), F.lit(0))
    score = F.round(passed.cast("decimal(9,0)") / F.lit(len(checks)), 4).cast("double")
    gate = score >= settings.min_score
    for rule in checks:
        if rule.name in settings.critical:
            gate = gate & F.col(rule.flag)
    return flagged.withColumn("quality_score", score).withColumn("is_valid", gate)


def _names(checks: list[Rule], want_passed: bool) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.col(r.flag) == want_passed, r.name) for r in checks])
    )


def passed_rules(settings: RuleSettings = RuleSettings()) -> Column:
    return _names(rules(settings), True)


def failed_rules(settings: RuleSettings = RuleSettings()) -> Column:
    return _names(rules(settings), False)


def failure_reasons(settings: RuleSettings = RuleSettings()) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(~F.col(r.flag), F.concat(F.lit(f"{r.name}: "), r.details))
                for r in rules(settings)
            ]
        )
    )


def check_results(settings: RuleSettings = RuleSettings()) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule_name"),
                F.col(r.flag).alias("passed"),
                F.lit(r.description).alias("description"),
                r.details.alias("details"),
            )
            for r in rules(settings)
        ]
    )


def _tabular(evaluated: DataFrame, status: str, promoted_at: Column | None, *extra) -> DataFrame:
    stamp = F.current_timestamp() if promoted_at is None else promoted_at
    made = {
        "num_line_items": F.col("ledger.items"),
        "lakehouse_promotion_timestamp": utc_text(stamp),
        "governance_status": F.lit(status),
    }
    columns = [
        made.get(field.name, F.col(field.name)).cast(field.dataType).alias(field.name)
        for field in schemas.SILVER.fields
    ]
    return evaluated.select(*columns, *extra)


def to_silver(evaluated: DataFrame, promoted_at: Column | None = None) -> DataFrame:
    kept = evaluated.filter(F.col("governance_error").isNull() & F.col("is_valid"))
    return _tabular(kept, fixed.PROMOTED, promoted_at)


def to_quarantine(
    evaluated: DataFrame,
    settings: RuleSettings = RuleSettings(),
    promoted_at: Column | None = None,
) -> DataFrame:
    kept = evaluated.filter(F.col("governance_error").isNull() & ~F.col("is_valid"))
    return _tabular(
        kept,
        fixed.QUARANTINED,
        promoted_at,
        failed_rules(settings).alias("failed_rules"),
        failure_reasons(settings).alias("failure_reasons"),
    )


def flatten_quarantine(quarantine: DataFrame) -> DataFrame:
    """The columnar form: arrays as joined text."""
    return quarantine.withColumns(
        {
            "failed_rules": F.array_join("failed_rules", ", "),
            "failure_reasons": F.array_join("failure_reasons", " | "),
        }
    )


def promotion_summary(evaluated: DataFrame) -> DataFrame:
    sound = F.col("governance_error").isNull()
    return evaluated.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(sound & F.col("is_valid")).alias("promoted_to_silver"),
        F.count_if(sound & ~F.col("is_valid")).alias("quarantined_anomalies"),
        F.count_if(~sound).alias("errors"),
    )
