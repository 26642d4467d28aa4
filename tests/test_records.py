"""Checked joins, guards, populations, drift references and displayed values."""

import hashlib
from datetime import date

import numpy as np
import pytest
from palimpsest.config import study
from palimpsest.functions import dates, text
from palimpsest.operators import drift, population, recalibration, records
from palimpsest.operators.ranks import percentiles, positions, sum_before
from pyspark.sql import functions as F

D = date.fromisoformat
one = lambda spark, c: spark.range(1).select(c.alias("x")).first()["x"]


def test_refusals(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, l string")
    right = spark.createDataFrame([(2, "x"), (3, "y")], "k int, r string")
    assert {(r.k, r.side) for r in records.one_to_one(left, right, ["k"]).collect()} == {(1, "left_only"), (2, "both"), (3, "right_only")}
    with pytest.raises(Exception, match="twice on the right"):
        records.one_to_one(left, right.unionByName(right), ["k"]).collect()
    with pytest.raises(Exception, match="no order"):
        records.guarded(left, F.col("k") > 1, "no order").collect()
    assert records.guarded(left, F.col("k") > 5, "no order").count() == 3
    assert records.misaligned(left, left, ["k"]).count() == 0 and [(r.k, r.n_left, r.n_right) for r in records.misaligned(left.filter("k = 1"), left.filter("k = 2"), ["k"]).orderBy("k").collect()] == [(1, 1, 0), (2, 0, 1)]


def test_digest_ignores_order_and_left_out_columns(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "k int, v string, at int")
    digest = lambda f: tuple(records.without_column_digest(f, "at").first())
    assert digest(rows) == digest(rows.orderBy(F.desc("k")).withColumn("at", F.lit(9))) != digest(rows.withColumn("v", F.lit("a")))


def test_nested_pairs_and_layouts(spark):
    items = spark.createDataFrame([(1, [("x", "B"), ("x", "B"), ("y", "A"), ("", "C"), (None, "C"), ("z", None), ("w", "B")]), (2, None)], "k int, items array<struct<name:string,kind:string>>")
    assert {r.k: r.v for r in items.select("k", records.named_kinds(F.col("items")).alias("v")).collect()} == {1: ["A", "B", "B"], 2: None}
    old = spark.createDataFrame([(1, ["p", "q"], None, D("2000-01-01")), (2, [], D("1999-01-01"), None)], "k int, list array<string>, a date, b date")
    got = records.adapted(old, {"k": "long", "first": "string", "day": "date", "new": "double"}, {"first": "list"}, {"day": ["a", "b", "c"]})
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(1, "p", D("2000-01-01"), None), (2, None, D("1999-01-01"), None)]


def test_ranks_against_numpy(spark):
    r = np.random.default_rng(2)
    rows = [(i, int(i % 3), float(v)) for i, v in enumerate(r.integers(0, 40, 300))] + [(900, None, 1.0), (901, 1, None)]
    frame = spark.createDataFrame(rows, "id int, g int, v double").repartition(5)
    for by in (["g"], []):
        got = {x.id: (x.at, x.n) for x in positions(frame, by, ["v", "id"], "at", "n").collect()}
        for group in ({x[1] for x in rows} if by else {0}):
            held = sorted((x for x in rows if not by or x[1] == group), key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
            assert [got[x[0]] for x in held] == [(k, len(held)) for k in range(len(held))]
    values = np.array([x[2] for x in rows if x[2] is not None and x[1] == 2])
    found = percentiles(frame, ["g"], "v", [0.1, 0.5, 1.0]).filter("g = 2").first()
    assert np.allclose([found.p0, found.p1, found.p2], np.quantile(values, [0.1, 0.5, 1.0]))
    assert [x.s for x in sum_before(frame.filter("id < 4"), [], ["id"], F.col("id"), "s").orderBy("id").collect()] == [0, 0, 1, 3]


def test_drift_reference_keeps_masses(spark):
    r = np.random.default_rng(6)
    values = [65.0] * 400 + sorted(r.normal(50, 10, 1_500).tolist())
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    known = drift.reference(frame, "v")
    parts = known.orderBy("low").collect()
    assert [p.share for p in parts if p.low == p.high] == [400 / 1_900] and abs(sum(p.share for p in parts) - 1) < 1e-12
    asked = [0.0, 50.0, 65.0, 200.0]
    got = {x.v: x.position for x in drift.position(spark.createDataFrame([(v,) for v in [*asked, None]], "v double"), "v", known).collect()}
    rank = {v: (sum(x < v for x in values) + 0.5 * sum(x == v for x in values)) / len(values) for v in asked}
    assert got[None] is None and all(abs(got[v] - rank[v]) < 0.01 for v in asked) and got[0.0] == 0 and got[200.0] == 1
    assert drift.reference(frame.limit(0), "v").count() == 0


def test_served_rows(spark):
    people = spark.createDataFrame([(1, D("2000-01-31"), False), (2, D("1990-01-31"), False), (3, D("1996-01-31"), True)], "trial_id int, t0 date, reversal boolean")
    rows = {r.trial_id: r for r in population.served_rows(people, study(), D("2000-09-15"), {"old": (8, 12, True), "older": (13, 25, False)}, 26).collect()}
    assert (rows[1].true_index, rows[1].k_star, rows[1].landmark_date, rows[1].window_start, rows[1].reason) == (1, 1, D("2000-07-31"), D("2000-03-17"), None)
    assert (rows[2].true_index, rows[2].k_star, rows[2].flagged, rows[2].reason) == (21, 6, False, "band") and (rows[3].flagged, rows[3].reason) == (True, "reversal")
    row = "trial_id int, landmark_date date, event int, event_date date"
    known = spark.createDataFrame([(1, D("1999-01-01"), 1, D("1999-02-01")), (2, D("1999-06-01"), 0, D("2000-01-01"))], row)
    assert [r.time for r in population.training_rows(known, D("2000-01-01")).orderBy("trial_id").collect()] == [31, 214]
    assert population.evaluation_rows(known, D("1999-06-01")).count() == 1
    with pytest.raises(Exception, match="after the origin"):
        population.training_rows(known, D("1999-12-31")).collect()


def test_displayed_values(spark):
    lit = lambda v: F.lit(v).cast("double")
    numbers = {12.0: "12", 12345.0: "12,345", 1234.5: "1,234", 0.12345: "0.123", 99.96: "100", -0.5: "-0.5", 0.0: "0", None: "not given"}
    assert {v: one(spark, text.shown(lit(v), "number")) for v in numbers} == numbers
    assert [one(spark, text.shown(F.lit(v), k)) for v, k in ((True, "flag"), (0.2, "flag"), ("X", "category"), (None, "category"))] == ["yes", "no", "X", "not given"]
    assert one(spark, text.reason_text(F.lit(" “No\n  funds” (2019). "))) == "no funds” (2019"
    assert [one(spark, text.rendered(F.lit(v).cast(k), k)) for v, k in ((18.0, "double"), (12345678.5, "double"), (True, "boolean"), (None, "int"))] == ["18.0", "12345678.5", "true", ""]
    assert one(spark, text.marker_names(F.lit(5), ["a", "b", "c"])) == ["a", "c"] and one(spark, text.marker_names(F.lit(0), ["a"])) == ["record"]
    assert one(spark, text.area_codes(F.array(F.lit("x"), F.lit("y"), F.lit("x")), {"x": 2, "y": 1})) == [1, 2]
    assert one(spark, dates.weekly_dates(F.lit(D("2024-01-01")), F.lit(D("2024-01-12")))) == [D("2024-01-05"), D("2024-01-12")]
    assert one(spark, dates.weekly_dates(F.lit(D("2024-01-01")), F.lit(D("2024-01-03")))) == []


def test_recalibration_finds_the_truth(spark):
    r = np.random.default_rng(8)
    n = 6_000
    index, p1, p2 = r.integers(0, 3, n), r.uniform(0.05, 0.4, n), r.uniform(0.05, 0.4, n)
    x, z = np.log(p1 / (1 - p1 - p2)), np.log(p2 / (1 - p1 - p2))
    u, v = np.array([0.5, -0.3, 0.0])[index] + 0.7 * x, np.array([-0.2, 0.1, 0.4])[index] + 1.3 * z
    weights = np.stack([np.ones(n), np.exp(u), np.exp(v)])
    y = (r.uniform(size=n)[None] > np.cumsum(weights / weights.sum(axis=0), axis=0)).sum(axis=0)
    rows = spark.createDataFrame([(i, int(index[i]), float(p1[i]), float(p2[i]), float(1 - p1[i] - p2[i]), int(y[i])) for i in range(n)], "id int, k int, p_stop double, p_complete double, p_continue double, y int")
    fitted = recalibration.fit_recalibration(rows, "k", "y")
    assert abs(fitted.stop_slope - 0.7) < 0.15 and abs(fitted.complete_slope - 1.3) < 0.15 and abs(fitted.stop[0] - 0.5) < 0.3
    q = np.array([[t.p_continue, t.p_stop, t.p_complete, t.k, t.y] for t in recalibration.recalibrated(rows, fitted, "k").orderBy("id").collect()])
    assert np.allclose(q[:, :3].sum(axis=1), 1)
    for c in (1, 2):  # the gradient is zero: chances add up to outcomes for each index and along the log-odds
        off = q[:, c] - (q[:, 4] == c)
        assert all(abs(off[q[:, 3] == k].sum()) < 1e-3 for k in range(3)) and abs((off * (x if c == 1 else z)).sum()) < 1e-3


def test_paired_difference(spark):
    r = np.random.default_rng(9)
    y = r.integers(0, 2, 400)
    rows = spark.createDataFrame([(i, int(v), float(v + r.normal()), float(r.normal()), 1.0) for i, v in enumerate(y)], "id int, label int, good double, noise double, weight double")
    found = recalibration.paired_difference(rows, "good", "noise", "label", "weight", "id", 200).first()
    assert 0 < found.low < found.difference < found.high and found.valid == 200
    same = recalibration.paired_difference(rows, "good", "good", "label", "weight", "id", 200).first()
    assert (same.low, same.difference, same.high) == (0, 0, 0)
    none = recalibration.paired_difference(rows.filter("label = 1"), "good", "noise", "label", "weight", "id", 50).first()
    assert none.valid == 0 and none.low is None


def test_canonical_rows_and_their_contract(spark):
    from palimpsest.operators.canonical import Layout, canonical, contract, split_valid

    layout = Layout(dates=("posted",), precise=("start",), enums=("overall_status", "last_known_status"), ages={"age": "years"}, texts=("title",), interventions="given")
    schema = "trial_id long, version int, source string, posted string, start string, start_type string, overall_status string, last_known_status string, age string, title string, lead_sponsor_name string, lead_sponsor_class string, given array<struct<name: string, type: string>>"
    base = dict(trial_id=1, version=0, source="history", posted="2020-01-02", start="2020-03", start_type="actual", overall_status=" recruiting", last_known_status=None, age="2 Years", title="A&amp;B", lead_sponsor_name="Acme Co.", lead_sponsor_class="industry", given=[("x", "drug"), ("x", "Drug"), ("y", "drug"), (None, "device")])
    changed = [{}, dict(version=1, lead_sponsor_name="Jo Roe, MD", start="soon", title=" "), dict(version=2, overall_status="odd", last_known_status="Recruiting"), dict(version=3), dict(version=3), dict(version=None), dict(version=None, source="api", trial_id=2)]
    rows = canonical(spark.createDataFrame([tuple((base | c).values()) for c in changed], schema), layout)
    got = {r.version: r for r in rows.filter("version < 3").collect()}
    r = got[0]
    assert (str(r.posted), str(r.start), r.start_precision, r.start_type, r.overall_status, r.years, r.lead_sponsor_name, r.sponsor_key, r.intervention_types) == ("2020-01-02", "2020-03-01", "month", "ACTUAL", "RECRUITING", 2.0, "Acme Co.", "acme co", ["DRUG", "DRUG"])
    assert r.title_hash == hashlib.sha256(b"A&B").hexdigest() and got[1].title_hash is None and len(r.content_hash) == 64 and r.content_hash != got[1].content_hash
    assert (got[1].lead_sponsor_name, got[1].sponsor_key, got[1].sponsor_is_individual, got[1].start, got[1].start_type) == (None, None, True, None, None)
    valid, failing = split_valid(rows, contract(layout, {"overall_status": ["RECRUITING"]}, ["UNKNOWN"]))
    assert sorted((x.trial_id, x.version if x.version is not None else -1) for x in valid.collect()) == [(1, 0), (1, 1), (2, -1)]
    reasons = {x.version: x.reasons for x in failing.collect()}
    assert reasons == {2: "overall_status: allowed; row: last known status only behind an unknown one", 3: "row: version is unique", None: "row: history has a version"}
    forged = rows.filter("version = 1").withColumns({"sponsor_key": F.lit("dr roe"), "start_type": F.lit("ACTUAL"), "years": F.lit(-1.0)})
    assert split_valid(forged, contract(layout, {}, ["UNKNOWN"]))[1].first().reasons == "row: no key of a title; row: no name of a person; row: precision and type match the date; years: not negative"
