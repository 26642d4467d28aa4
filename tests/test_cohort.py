"""Hand-made histories through the real operators."""

from datetime import date

import pytest
from palimpsest.config import study
from palimpsest.operators import cohort, features, sponsors
from palimpsest.operators.asof import asof_join, asof_value
from palimpsest.operators.versions import arg_min, open_counts, quarantine, unique_in
from pyspark.sql import functions as F

D = date.fromisoformat
SCHEMA = (
    "trial_id long, version long, effective_date date, overall_status string, last_known_status string, study_type string, first_post_date date, status_verified_date date, "
    "start_date date, completion_date date, completion_date_precision string, primary_completion_date date, primary_completion_date_precision string, enrollment_count int, enrollment_type string, stratum string, intervention_types array<string>, primary_completion_date_type string, allocation string, minimum_age_years double, maximum_age_years double"
)
DEFAULTS = dict(last_known_status=None, study_type="INTERVENTIONAL", status_verified_date=None, start_date=D("2000-01-10"), completion_date=None, completion_date_precision=None, primary_completion_date=None, primary_completion_date_precision=None, enrollment_count=100, enrollment_type="ESTIMATED", stratum="OTHER", intervention_types=None, primary_completion_date_type=None, allocation=None, minimum_age_years=None, maximum_age_years=None)
RULES = study({"window": {"first": D("2000-01-01"), "last": D("2005-01-01")}})


def version(trial, n, day, status, **more):
    return DEFAULTS | dict(trial_id=trial, version=n, effective_date=D(day), overall_status=status, first_post_date=D("2000-01-31")) | more


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        version(1, 0, "2000-01-31", "RECRUITING", first_post_date=None), version(1, 1, "2000-06-01", "SUSPENDED"), version(1, 2, "2001-03-01", "TERMINATED"),
        version(2, 0, "2000-01-31", "RECRUITING"), version(2, 1, "2001-05-05", "COMPLETED"), version(2, 2, "2001-05-05", "RECRUITING"),
        version(3, 0, "2000-01-31", "RECRUITING", status_verified_date=D("2000-03-15"), completion_date=D("2000-12-01"), completion_date_precision="month"),
        version(4, 0, "2000-01-31", "NOT_YET_RECRUITING"), version(4, 1, "2003-02-01", "UNKNOWN", last_known_status="RECRUITING"),
        version(5, 0, "2000-01-31", "RECRUITING"), version(5, 1, "2002-02-02", "UNKNOWN"),
        version(6, 0, "2000-01-31", "RECRUITING", study_type="OBSERVATIONAL"), version(7, 0, "1999-12-01", "RECRUITING", first_post_date=D("1999-12-01")),
    ]
    return frame(spark, rows)


def by_trial(rows):
    return {r.trial_id: r for r in rows.collect()}


def test_outcomes(log):
    o = by_trial(cohort.outcomes(log, RULES))
    assert (o[1].event, o[1].event_date, o[1].t0, o[1].reversal) == (1, D("2001-03-01"), D("2000-01-31"), False)
    assert (o[2].event, o[2].reversal) == (2, True)
    assert (o[3].event, o[3].censor_reason, o[3].event_date, o[3].lapse_date) == (0, "unknown", D("2000-03-15"), D("2002-04-01"))
    assert (o[4].event, o[4].censor_reason, o[4].event_date) == (0, "cutoff", RULES.window.last)
    assert (o[5].censor_reason, o[5].event_date, o[5].lapse_date) == ("unknown", D("2002-02-02"), D("2002-02-02"))
    assert (o[6].in_population, o[7].in_window) == (False, False)
    stop = by_trial(cohort.outcomes(log, RULES, unknown_as_stop=True))
    assert (stop[3].event, stop[3].event_date) == (1, D("2002-04-01")) and stop[1].event == 1 and stop[4].event == 0


def test_landmarks_and_periods(log):
    rows = cohort.landmarks(log, RULES)
    kept = {(r.trial_id, r.landmark_index): r for r in rows.collect()}
    assert {t for t, _ in kept} == {1, 3, 4, 5}
    assert kept[1, 1].landmark_date == D("2000-07-31") and [kept[1, k].excluded for k in range(4)] == [None, None, None, "ended"]
    assert kept[3, 4].excluded == "ended" and kept[5, 5].excluded == "ended"
    periods = cohort.person_periods(rows.filter("excluded is null"), RULES)
    mine = sorted((r.landmark_index, r.interval, r.outcome) for r in periods.filter("trial_id = 1").collect())
    assert mine == [(0, 1, 0), (0, 2, 0), (0, 3, 1), (1, 1, 0), (1, 2, 1), (2, 1, 1)]


def test_later_versions_never_matter(log):
    """What was known on a day does not move when everything posted later is rewritten."""
    origin = D("2001-03-01")
    later = F.col("effective_date") >= F.lit(origin)
    forged = log.withColumn("overall_status", F.when(later, "WITHDRAWN").otherwise(F.col("overall_status"))).withColumn("enrollment_count", F.when(later, 7).otherwise(F.col("enrollment_count")))
    forged = forged.unionByName(log.withColumn("version", F.col("version") + 90).withColumn("effective_date", F.lit(origin) + 5))
    for f in (cohort.outcomes, cohort.landmarks, cohort.states):
        assert sorted(map(str, f(log, RULES, before=origin).collect())) == sorted(map(str, f(forged, RULES, before=origin).collect()))
    keys = features.landmark_keys(log, RULES, before=origin)
    a, b = (features.select_features(features.at_landmarks(keys, features.history(x, RULES))) for x in (log, forged))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 3


def test_label_changes(log):
    origin = D("2001-03-01")
    rows = cohort.label_changes(cohort.outcomes(log, RULES, before=origin), cohort.outcomes(log, RULES), origin)
    assert {r.trial_id: r.category for r in rows.collect()}[1] == "same"


def test_features_by_hand(log):
    keys = features.landmark_keys(log, RULES)
    rows = {(r.trial_id, r.landmark_index): r for r in features.select_features(features.at_landmarks(keys, features.history(log, RULES))).collect()}
    r = rows[1, 1]
    assert (r.status, r.n_versions, r.n_versions_recent, r.ever_suspended, r.currently_suspended, r.months_since_last_update, r.registration_year) == ("SUSPENDED", 2, 1, True, True, 1, 2000)
    assert rows[1, 0].registration_year is None and rows[3, 0].planned_duration_months is None and rows[4, 0].start_overdue is False and rows[4, 1].start_overdue is True and rows[4, 1].enrollment_target_ratio == 1.0


def test_recent_window_follows_the_landmarks(spark):
    """First posted on 31 August: the landmark of 28 February has a window that begins on 31 August, not on the 28th."""
    rows = [version(1, n, day, "RECRUITING", first_post_date=D("2000-08-31"), status_verified_date=D("2004-12-01")) for n, day in enumerate(["2000-08-29", "2000-08-30", "2000-08-31", "2001-01-01"])]
    keys = features.landmark_keys(frame(spark, rows), RULES)
    found = features.select_features(features.at_landmarks(keys, features.history(frame(spark, rows), RULES)))
    assert [(r.landmark_date, r.n_versions, r.n_versions_recent) for r in found.orderBy("landmark_index").head(3)] == [(D("2000-08-31"), 3, 3), (D("2001-02-28"), 4, 1), (D("2001-08-31"), 4, 0)]
    starts = [r.window_start for r in keys.orderBy("landmark_index").head(3)]
    assert starts == [D("2000-02-29"), D("2000-08-31"), D("2001-02-28")]


def test_features_of_the_design(spark):
    rows = [
        version(1, 0, "2000-01-31", "RECRUITING", primary_completion_date=D("2001-02-15"), primary_completion_date_type="ESTIMATED", allocation="RANDOMIZED", minimum_age_years=18.0, maximum_age_years=65.0, intervention_types=["DRUG", "DRUG", "DEVICE"]),
        version(1, 1, "2000-07-01", "RECRUITING", first_post_date=D("2000-02-01"), primary_completion_date=D("2000-06-15"), start_date=D("2000-03-01"), primary_completion_date_type="ESTIMATED"),
        version(1, 2, "2001-01-15", "RECRUITING", primary_completion_date=D("2000-12-15"), primary_completion_date_type="ACTUAL", status_verified_date=D("2004-12-01")),
    ]
    log = frame(spark, rows)
    keys = features.landmark_keys(log, RULES)
    found = features.select_features(features.at_landmarks(keys, features.history(log, RULES)))
    assert len(found.columns) == 3 + 57
    a, b, c = (r for r in found.filter("landmark_index < 3").orderBy("landmark_index").collect())
    assert (a.planned_duration_months, a.registration_lag_months, a.registered_after_start, a.eligibility_age_span_years, a.allocation) == (13, 0, False, 47.0, "RANDOMIZED")
    assert (a.n_interventions, a.n_intervention_types, a.intervention_drug, a.intervention_genetic, b.n_interventions, b.intervention_drug) == (3, 2, True, False, 0, False)
    assert (b.primary_completion_slip_months, b.primary_completion_overdue, b.primary_completion_reached, b.registered_after_start, b.months_since_t0) == (-8, True, False, False, 5)
    assert (c.primary_completion_overdue, c.primary_completion_reached, c.sponsor_has_identity, c.title_phase) == (False, True, None, None)


def test_priors_of_classes(spark):
    row = "trial_id long, landmark_index int, landmark_date date, event int, event_date date, stratum string"
    at = lambda trial, index, event, kind, day="1999-01-01": (trial, index, D("1998-01-01"), event, D(day), kind)
    rows = spark.createDataFrame([at(1, 0, 1, "A"), at(1, 1, 0, "B"), at(2, 0, 2, "A"), at(3, 0, 0, "A"), at(4, 2, 2, None), at(5, 0, 0, "B", "2000-01-01")], row)
    priors = sponsors.class_priors(rows, D("2000-01-01"))
    got = {r.stratum: r.prior for r in priors.collect()}
    assert got == pytest.approx({"A": (1 + 10 / 3) / 12, "B": 1 / 3, "MISSING": (10 / 3) / 11})
    asked = spark.createDataFrame([("A", 4, 3), ("C", 0, 0), ("B", None, None), (None, None, None)], "stratum string, sponsor_prior_ended long, sponsor_prior_stopped long")
    rates = {r.stratum: r.rate for r in sponsors.shrunk_rates(asked, priors).collect()}
    assert rates == pytest.approx({"A": (3 + 10 * got["A"]) / 14, "C": 1 / 3, "B": 1 / 3, None: got["MISSING"]})
    with pytest.raises(Exception, match="on or after the origin"):
        sponsors.class_priors(rows.unionByName(spark.createDataFrame([at(6, 0, 2, "A", "2000-01-01")], row)), D("2000-01-01")).collect()


def test_asof_inclusive_and_strict(spark):
    keys = spark.createDataFrame([("a", D("2000-01-02")), ("a", D("2000-01-01")), ("a", D("1999-01-01")), ("b", D("2000-01-01"))], "id string, day date")
    states = spark.createDataFrame([("a", D("2000-01-01"), 1), ("a", D("2000-01-02"), None)], "id string, at date, v int")
    got = lambda **k: {(r.id, r.day): (r.at, r.v) for r in asof_join(keys, states, ["id"], "day", "at", **k).collect()}
    assert got()["a", D("2000-01-02")] == (D("2000-01-02"), None) and got()["b", D("2000-01-01")] == (None, None) and len(got()) == 4
    assert got(strict=True)["a", D("2000-01-02")] == (D("2000-01-01"), 1) and got(strict=True)["a", D("2000-01-01")] == (None, None)
    assert len(got(how="inner")) == 2
    line = spark.createDataFrame([(D("2000-01-01"), 5)], "at date, n int")
    assert {r.n for r in asof_value(keys, line, "day", "at", "n").collect()} == {5, None}


def test_sweep_and_quarantine(spark):
    spans = spark.createDataFrame([(D("2000-01-01"), D("2000-01-03")), (D("2000-01-02"), None)], "a date, b date")
    assert [(r.day.day, r.n_open) for r in open_counts(spans, "a", "b").orderBy("day").collect()] == [(1, 1), (2, 2), (3, 1)]
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, None), (3, 900)], "k int, v int")
    good, bad = quarantine(rows, {"v: small": F.col("v") < 100, "k: unique": unique_in(rows, "k")})
    assert [r.k for r in good.collect()] == [2] and sorted((r.k, r.reasons) for r in bad.collect()) == [(1, "k: unique"), (1, "k: unique"), (3, "v: small")]
    assert rows.agg(arg_min(F.col("v"), F.lit(0) - F.col("k"))).first()[0] == 900


def test_rules_are_checked():
    for wrong in ({"silence": {"status": ["COMPLETED"]}}, {"status": {"open": ["UNKNOWN"]}, "silence": {"status": []}}, {"intervals": {"count": 0}}):
        with pytest.raises(ValueError):
            study(wrong)
    assert study().silence.months == 24 and cohort.horizon(study(), date(2000, 1, 1)) == date(2000, 1, 1)


def test_a_record_without_dates_falls_silent_from_its_post_date(spark):
    """No completion counts as past, no verification as verified on the post date; an unknown status lapses at once."""
    rows = [
        version(1, 0, "2000-03-10", "RECRUITING"), version(2, 0, "2000-03-10", "RECRUITING", status_verified_date=D("1999-11-02")),
        version(3, 0, "2000-03-10", "RECRUITING", completion_date=D("2004-06-01"), completion_date_precision="month"), version(4, 0, "2000-03-10", "UNKNOWN"),
        version(5, 0, "2000-03-10", "UNKNOWN", last_known_status="RECRUITING"), version(6, 0, "2000-03-10", "SUSPENDED"), version(7, 0, "2000-03-10", "COMPLETED"),
    ]
    found = {r.trial_id: r.lapse_from for r in cohort.states(frame(spark, rows), RULES).collect()}
    assert found == {1: D("2002-04-01"), 2: D("2001-12-01"), 3: D("2004-07-01"), 4: D("2000-03-10"), 5: D("2002-04-01"), 6: None, 7: None}
