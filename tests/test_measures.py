import random
from datetime import date

import pytest

from claimweir.operators import measures

SCHEMA = """filing_date date, province string, incident_type string, dora_classification string, dora_regulatory_tier string, is_ict_related boolean,
  is_timely_sla_compliant int, is_major_dora_incident int, gross_loss_amount double, deductible_amount double, net_claimed_amount double,
  days_to_notify long, num_line_items long, quality_score double"""


@pytest.fixture(scope="module", params=[0, 400])
def mart(request, spark):
    draw = random.Random(7)
    rows = []
    for _ in range(request.param):
        net = draw.choice([None, float("nan"), *[draw.randrange(1, 10**7) / 100 for _ in range(20)]])
        major = draw.random() < 0.3
        rows.append(
            (draw.choice([None, date(2024, draw.randint(1, 12), draw.randint(1, 28))]), draw.choice(["Leinster", "Munster", None]), draw.choice(["ICT x", "Cyber", None]), "Major ICT Incident" if major else "Standard",
             "T1" if major else "T3", draw.choice([True, False]), draw.choice([0, 1]), int(major), 10.25, None, net, draw.choice([None, 3, 90, 91]), draw.choice([0, 2, None]), draw.choice([0.5714, 1.0, None]))
        )
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def rows_of(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())  # NaN equals NaN


def test_figures_of_partial_sums_are_those_of_the_rows(mart):
    by_kind, by_days = measures.partial_measures(mart)
    ways = [
        lambda rows, of: rows.agg(*[m.alias(n) for n, m in measures.catalogue(of).items()]),
        lambda rows, of: rows.groupBy("province", "is_ict_related").agg(*[m.alias(n) for n, m in measures.catalogue(of).items()]),
        measures.kpi_numbers,
        measures.kpi_summary,
        measures.dashboard_kpis,
        measures.net_amount_mtd,
        measures.net_amount_ytd,
        measures.claims_count_mtd,
        measures.exposure_by_incident_type,
        lambda rows, of: measures.exposure_by(rows, "dora_regulatory_tier", of),
    ]
    for way in ways:
        assert rows_of(way(by_kind, measures.PARTIALS)) == rows_of(way(mart, measures.ROWS))
        assert way(by_kind, measures.PARTIALS).dtypes == way(mart, measures.ROWS).dtypes
    assert rows_of(measures.latency_histogram(by_days, of=measures.PARTIALS)) == rows_of(measures.latency_histogram(mart))
    assert by_kind.count() <= mart.count() and by_days.count() <= 4 + (mart.count() == 0)
