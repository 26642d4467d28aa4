"""The live path: states of a stream, seeds and features against whole histories."""

import random
from datetime import date, timedelta

import pytest
from palimpsest.operators import cohort, features, population, sponsors
from palimpsest.streaming import live
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.test_cohort import RULES, frame, version

D = date.fromisoformat
DAY = D("2002-06-14")
BANDS = {"late": (3, 3, True), "very late": (4, 4, False)}


def daily_log(seed, trials=40):
    r, rows = random.Random(seed), []
    for t in range(trials):
        day = D("2000-01-05") + timedelta(r.randrange(500))
        for n in range(r.randint(1, 8)):
            status = r.choice(["RECRUITING"] * 6 + ["SUSPENDED", "NOT_YET_RECRUITING", "UNKNOWN", "TERMINATED", "COMPLETED"])
            first = None if n == 0 and t % 5 == 0 else day
            rows.append(version(t, 1_000 * n + t, day.isoformat(), status, first_post_date=first, status_verified_date=day, enrollment_count=r.choice([None, 10, 50]), enrollment_type=r.choice(["ESTIMATED", "ACTUAL", None]), intervention_types=r.choice([None, [], ["DRUG", "OTHER"]]), study_type=r.choice(["INTERVENTIONAL"] * 9 + ["OBSERVATIONAL"]), minimum_age_years=r.choice([None, 18.5])))
            day += timedelta(r.choice([1, 30, 90, 150]))
    return rows


@pytest.fixture(scope="module")
def log(spark):
    held = frame(spark, daily_log(3)).withColumn("sponsor_key", F.when(F.col("version") % 11 != 0, F.concat(F.lit("s"), (F.col("version") % 7 % 3).cast("string"))))
    return spark.createDataFrame(held.collect(), held.schema)


@pytest.fixture(scope="module")
def streamed(spark, log, tmp_path_factory):
    """Folders of a stream from nothing and of one from a seed, a file for each month."""
    records, out = live.records(log.filter(F.col("effective_date") <= F.lit(DAY)), RULES), {}
    for name, since in (("all", D("1999-12-31")), ("seeded", D("2001-01-15"))):
        folder = str(tmp_path_factory.mktemp(name))
        months = sorted({(r.d.year, r.d.month // 6) for r in records.filter(F.col("effective_date") > F.lit(since)).select(F.col("effective_date").alias("d")).collect()})
        for year, half in months:
            part = records.filter((F.col("effective_date") > F.lit(since)) & (F.year("effective_date") == year) & (F.floor(F.month("effective_date") / 6) == half))
            part.coalesce(1).write.mode("append").parquet(f"{folder}/source")
        seed = live.seeded(records, RULES, since) if name == "seeded" else None
        live.run(spark, f"{folder}/source", f"{folder}/changes", f"{folder}/checkpoint", RULES, seed, files_per_batch=1)
        out[name] = folder
    return out


def plain(rows):
    return sorted(str(r.asDict(True)) for r in rows.collect())


def test_a_seeded_stream_holds_what_a_whole_one_holds(spark, log, streamed):
    a, b = (live.states(spark, f"{streamed[name]}/checkpoint").select("trial_id", *live.Held._fields) for name in ("all", "seeded"))
    want = live.seeded(live.records(log, RULES), RULES, DAY).select(a.columns)
    assert plain(a) == plain(b) == plain(want) and want.count() == 40
    assert want.filter("reversal").count() > 2 and want.filter("size(recent) > 2").count() > 2


def test_changes_of_a_stream_equal_those_of_the_log(spark, log, streamed):
    made = spark.read.parquet(f"{streamed['all']}/changes").drop("batch")
    want = live.history_changes(live.records(log.filter(F.col("effective_date") <= F.lit(DAY)), RULES), RULES)
    assert plain(made) == plain(want.select(made.columns))


def test_features_from_state_equal_those_from_histories(spark, log, streamed):
    known, identity = log.filter(F.col("effective_date") <= F.lit(DAY)), F.col("sponsor_key").isNotNull()
    keys = live.served(population.served_rows(population.open_on(known, RULES, DAY), RULES, DAY, BANDS, 6), DAY)
    met = features.at_landmarks(keys.select("trial_id", "landmark_index", "landmark_date", "window_start"), features.history(known, RULES))
    met = met.crossJoin(population.open_states(known, RULES, DAY).agg(F.count("*").alias("open_interventional_trials")))
    st = cohort.states(known, RULES)
    st = st.select("trial_id", "effective_date", "sponsor_key", (F.col("study_type") == "INTERVENTIONAL").alias("interventional"), F.col("status").isin("TERMINATED", "WITHDRAWN").alias("stopped"), (F.col("status") == "COMPLETED").alias("completed"))
    asked = met.filter(identity).select("trial_id", "landmark_index", "landmark_date", "sponsor_key")
    want = features.select_features(sponsors.with_record(met, sponsors.track_records(sponsors.sponsor_events(st, asked)), identity))
    changes = spark.read.parquet(f"{streamed['all']}/changes").drop("batch")
    got = live.live_features(live.states(spark, f"{streamed['all']}/checkpoint"), changes, RULES, DAY, BANDS, 6, identity)
    assert len(got.columns) == 3 + 57 and plain(got) == plain(want) and want.count() > 8


def test_each_kind_of_record():
    meaning = live.Meaning.of(RULES)
    record = lambda day, status, digest=0, posted=None: Row(effective_date=D(day), version=1, status=status, study_type="INTERVENTIONAL", first_post_date=posted, sponsor_key="s", digest=digest, payload=f"{{{digest}}}")
    held, action = live.applied(None, record("2020-01-01", "SUSPENDED", 1), meaning)
    assert (action, held.n_versions, held.ever_suspended, held.recent, held.t0) == (live.NEW, 1, True, [D("2020-01-01")], None)
    assert live.applied(held, record("2020-01-01", "RECRUITING", 1), meaning) == (held, live.OVERLAP)
    assert live.applied(held, record("2019-12-31", "COMPLETED", 2), meaning) == (held, live.LATE)
    again, action = live.applied(held, record("2020-01-01", "RECRUITING", 2), meaning)
    assert (action, again.n_versions, again.status, again.latest, again.first) == (live.REPLACEMENT, 1, "RECRUITING", "{2}", "{1}")
    ended, action = live.applied(again, record("2020-09-01", "TERMINATED", 3, D("2020-01-02")), meaning)
    assert (action, ended.term, ended.ended, ended.recent, ended.t0, ended.ever_suspended) == (live.VERSION, 1, True, [D("2020-09-01")], D("2020-01-02"), True)
    opened, _ = live.applied(ended, record("2020-10-01", "RECRUITING", 4), meaning)
    assert opened.reversal and opened.term == 0 and opened.n_versions == 3


def test_a_repeated_stream_changes_nothing(spark, streamed):
    folder = streamed["all"]
    before = plain(spark.read.parquet(f"{folder}/changes"))
    live.run(spark, f"{folder}/source", f"{folder}/changes", f"{folder}/checkpoint", RULES, files_per_batch=1)
    assert plain(spark.read.parquet(f"{folder}/changes")) == before


def test_lapses_are_events_of_silence(spark, log):
    held = live.seeded(live.records(log, RULES), RULES, DAY)
    states = cohort.states(log.filter(F.col("effective_date") <= F.lit(DAY)), RULES).filter("next_effective is null")
    since, until = D("2001-01-01"), D("2004-01-01")
    want = states.filter((F.col("lapse_from") > F.lit(since)) & (F.col("lapse_from") <= F.lit(until)))
    got = live.lapse_events(held, RULES, since, until)
    assert sorted((r.trial_id, r.day, r.from_status) for r in got.collect()) == sorted((r.trial_id, r.lapse_from, r.status) for r in want.collect())
    assert 3 < got.count() < 40
