"""Walk-forward frames, weights of all groups at once, slopes of all groups at once, and weekly populations."""

from datetime import date, timedelta

import numpy as np
import pytest
from palimpsest.operators import population, survival, walkforward
from pyspark.sql import functions as F

from tests.test_cohort import RULES, frame
from tests.test_live import daily_log

D = date.fromisoformat


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    out = []
    for i in range(500):
        day = D("2000-01-01") + timedelta(int(r.integers(0, 900)))
        out.append((i, i % 3, day, int(r.integers(0, 3)), day + timedelta(int(r.integers(1, 900))), ["A", "B", None][int(r.integers(0, 3))]))
    return spark.createDataFrame(out, "trial_id long, landmark_index int, landmark_date date, event int, event_date date, stratum string").repartition(4)


ORIGINS = (D("2000-06-01"), D("2001-01-01"))


def test_rows_of_several_origins_are_laid_out(rows):
    held = walkforward.evaluated(rows, ORIGINS)
    for origin in ORIGINS:
        want = rows.filter((F.col("landmark_date") >= F.lit(origin)) & (F.col("landmark_date") < F.add_months(F.lit(origin), 12))).count()
        assert held.filter(F.col("origin") == F.lit(origin)).count() == want > 50
    groups = {(r.origin, r.stratum): (r.n, r.g) for r in walkforward.grouped(held, "stratum", 65).groupBy("origin", "stratum").agg(F.count("*").alias("n"), F.max("censoring_group").alias("g")).collect()}
    assert all(g == (s if n >= 65 and s is not None else ("POOLED" if n < 65 else None)) for (_, s), (n, g) in groups.items())


def test_weights_of_all_groups_equal_those_of_each(rows):
    held = walkforward.evaluated(rows, ORIGINS).withColumns({"horizon": F.datediff(F.add_months("landmark_date", 12), "landmark_date"), "group": F.coalesce("stratum", F.lit("none"))})
    got = {(r.origin, r.trial_id): (r.label, r.weight) for r in survival.weighted(held, ["origin", "group"], "time", "event", F.col("horizon")).collect()}
    for origin in ORIGINS:
        for horizon in (365, 366):
            one = held.filter(F.col("origin") == F.lit(origin))
            for r in survival.ipcw(one, "group", "time", "event", horizon).filter(F.col("horizon") == horizon).collect():
                assert got[origin, r.trial_id] == (r.label, pytest.approx(r.weight))


def test_slopes_of_all_groups_equal_those_of_each(spark):
    r = np.random.default_rng(5)
    p = r.uniform(0.05, 0.95, 900)
    rows = spark.createDataFrame([(int(i % 3), float(q), int(r.random() < q ** (1 + i % 3)), float(r.uniform(0.5, 2))) for i, q in enumerate(p)], "g int, score double, label int, weight double")
    found = {x.g: (x.intercept, x.slope) for x in walkforward.calibration_slopes(rows, ["g"], "score", "label", "weight").collect()}
    for g in range(3):
        assert found[g] == pytest.approx(survival.calibration_slope(rows.filter(F.col("g") == g), "score", "label", "weight"), abs=1e-6)


def test_all_weekly_days_equal_single_days(spark):
    log = frame(spark, daily_log(8, 30))
    log = spark.createDataFrame(log.collect(), log.schema)
    first, last = D("2001-03-01"), D("2001-06-30")
    got = population.open_weekly(log, RULES, first, last)
    found = sorted(str(r.asDict()) for r in got.select("day", "trial_id", "t0", "reversal", "stratum").collect())
    want = []
    for n in range((last - first).days + 1):
        day = first + timedelta(n)
        if day.weekday() == 4:
            want += [str({"day": day} | r.asDict()) for r in population.open_on(log, RULES, day).select("trial_id", "t0", "reversal", "stratum").collect()]
    assert found == sorted(want) and len(found) > 50
