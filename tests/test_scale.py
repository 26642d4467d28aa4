"""What plans and tasks read and hold, where results alone would not tell."""

from datetime import date

import numpy as np
from pyspark.sql import functions as F

from palimpsest import plans
from palimpsest.operators import cohort, features, sponsors, survival, text_svd
from palimpsest.plans import registry, sponsor_queries

D = date.fromisoformat


def planned(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_each_state_is_read_once_for_its_events(spark):
    rows = [(1, D("2000-01-01"), "a", True, False, False), (1, D("2000-02-01"), "b", True, True, False), (2, D("2000-01-05"), None, False, False, True)]
    states = spark.createDataFrame(rows, "trial_id long, effective_date date, sponsor_key string, interventional boolean, stopped boolean, completed boolean").repartition("trial_id")
    asked = spark.createDataFrame([(1, 0, D("2000-03-01"), "b")], "trial_id long, landmark_index int, landmark_date date, sponsor_key string")
    events = sponsors.sponsor_events(states, asked)
    assert planned(events).count("Window [") == 1
    found = sorted((r.day, r.kind, r.key, r.other) for r in events.collect())
    first, second = D("2000-01-01"), D("2000-02-01")
    assert found == [(first, 1, "a", None), (first, 3, "a", None), (second, 1, "b", None), (second, 2, "a", "b"), (second, 5, "b", "1"), (D("2000-03-01"), 0, "b", None)]


def test_renamed_sponsors_take_a_short_expression(spark):
    rows = [("sponsor 3", D("1996-02-29")), ("sponsor 3", D("1996-03-01")), ("sponsor 3", D("1997-06-01")), ("sponsor 11", D("1997-05-31")), ("sponsor 11", D("1997-06-01")), ("sponsor 1", D("1999-01-01")), (None, D("1999-01-01"))]
    held = sponsor_queries.renamed(spark.createDataFrame(rows, "sponsor_key string, effective_date date").repartition(1))
    assert [r.sponsor_key for r in held.collect()] == ["sponsor 3", "sponsor 11", "sponsor 19", "sponsor 11", "sponsor 19", "sponsor 1", None]
    assert planned(held).count("CASE WHEN") <= 2 * len(sponsor_queries.RENAMED)


def test_words_are_counted_where_their_text_lies(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue"), (3, None), (4, "--")], "id long, text string").repartition(2)
    counts = text_svd.word_counts(docs, "id", "text", 512)
    assert "Aggregate" not in planned(counts) and sorted((r.key, sorted(r.counts)) for r in counts.collect()) == [(1, [1, 2]), (2, [1])]
    again = docs.unionByName(spark.createDataFrame([(2, "blue green"), (None, "red"), (None, "red")], "id long, text string"))
    found = {r.key: sorted(r.counts) for r in text_svd.word_counts(again, "id", "text", 512).collect()}
    assert found == {1: [1, 2], 2: [1, 2], None: [2]}


def test_draws_are_made_for_few_rows_of_a_score_at_a_time(spark, monkeypatch):
    rows = spark.range(6_000).select("id", (F.col("id") % 2).alias("score"), (F.col("id") % 3 % 2).alias("label"), F.lit(1.0).alias("weight"))
    draws, most = survival.poisson_draws, survival.DRAWN

    def few(clusters, replicates):
        assert len(clusters) <= most
        return draws(clusters, replicates)

    monkeypatch.setattr(survival, "poisson_draws", few)
    got = {r.replicate: r.auc for r in survival.bootstrap_auc(rows, "score", "label", "weight", "id", 20).collect()}
    held = rows.select("score", "label", F.xxhash64("id", F.lit(42)).alias("h")).toArrow()
    score, label = (held.column(c).to_numpy() for c in ("score", "label"))
    times = draws(held.column("h").to_numpy(), np.arange(1, 21))
    p, n = ((times * (label == k)[:, None]) for k in (1, 0))
    low = [x[score == 0].sum(axis=0) for x in (p, n)]
    high = [x[score == 1].sum(axis=0) for x in (p, n)]
    want = (low[0] * low[1] / 2 + high[0] * (low[1] + high[1] / 2)) / ((low[0] + high[0]) * (low[1] + high[1]))
    assert np.allclose([got[i] for i in range(1, 21)], want)


def test_hazards_read_stored_periods(spark):
    assert "o_orderkey" not in planned(plans.QUERIES["discrete_time_risks"](spark, "/root/testdata/sf0.001"))


def test_history_is_built_for_trials_with_rows(spark, monkeypatch):
    seen, history = [], features.history
    monkeypatch.setattr(features, "history", lambda held, rules: seen.append(planned(held)) or history(held, rules))
    plans.QUERIES["features_at_landmark"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "LeftSemi" in seen[0]


def test_pages_pass_to_python_in_batches_of_few_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    plans.QUERIES["normalized_texts"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_landmark_states_take_one_shuffle_and_give_the_kept_rows(spark):
    held = registry.versions(spark, "/root/testdata/sf0.001", dealt=True)
    for before in (None, D("1998-01-01")):
        log = cohort.landmark_states(held, registry.STUDY, before)
        plan = log._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        columns = ("trial_id", "landmark_index", "landmark_date", "event", "event_date")
        want = cohort.landmarks(held, registry.STUDY, before).filter("excluded is null").select(*columns)
        assert sorted(cohort.kept_rows(log).select(*columns).collect()) == sorted(want.collect()) != []


def test_a_key_is_dealt_whole_for_its_aliases(spark):
    rows = [(D("2000-01-01"), sponsors.REPLACEMENT, "a", "b", 1, None), (D("2000-01-02"), sponsors.REPLACEMENT, "a", "b", 2, None)]
    found = sponsors.alias_candidates(spark.createDataFrame(rows, sponsors.EVENT))
    assert "Join" not in planned(found)  # rows of a join may be split, and the repartition after it left out
    assert [(r.key, r.to) for r in found.collect()] == [("a", "b")]
