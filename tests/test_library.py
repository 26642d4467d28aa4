"""Sponsors, survival, comparison, serving, streaming, readers and writers on small inputs."""

import json
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from palimpsest.functions import dates, numbers, text
from palimpsest.operators import compare, models, monitoring, serving, sponsors, survival
from palimpsest.operators.graph import component_labels
from palimpsest.sources import readers, writers
from palimpsest.streaming import daily
from palimpsest.streaming.state import RECORD, Held, apply_record, batch_changes
from pyspark.sql import functions as F

D = date.fromisoformat

TERMINAL = frozenset({"COMPLETED", "TERMINATED"})


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dates(spark):
    lit = lambda d: F.lit(D(d))
    assert [one(spark, dates.true_index(lit("2000-08-31"), lit(d), 6)) for d in ("2000-08-30", "2000-08-31", "2001-02-27", "2001-02-28", "2001-08-31")] == [-1, 0, 0, 1, 2]
    parsed = [one(spark, dates.partial_date(F.lit(t))) for t in ("2019", "2019-02", "2019-02-30", "x", None)]
    assert [(r.day, r.precision) for r in parsed] == [(D("2019-01-01"), "year"), (D("2019-02-01"), "month"), (None, None), (None, None), (None, None)]
    assert one(spark, dates.valid_date(lit("2100-12-31"))) is None and one(spark, dates.valid_date(lit("2099-12-31"))) == D("2099-12-31")
    assert one(spark, dates.months_between(lit("2020-02-01"), lit("2020-01-31"))) == 1


def test_texts(spark):
    assert one(spark, text.canonical_enum(F.lit("\u00a0 early stop "), {"EARLY STOP": "STOPPED"})) == "STOPPED" and one(spark, text.canonical_enum(F.lit(" "))) is None
    assert [one(spark, text.age_in_years(F.lit(t))) for t in ("6 Months", "18 Years", "1 Year", "1.5 years", "many", None)] == [0.5, 18.0, 1.0, 1.5, None, None]
    titles = {
        "Phase II study": "PHASE2", "A phase 1/2 trial": "PHASE1_PHASE2", "PHASE IIIb": "PHASE3", "phase": "NONE", "phases 2 and 3": "NONE", "phase 12": "NONE", None: "NONE", "": "NONE",
        "Phase 2 to phase 3": "PHASE2_PHASE3", "phase-4": "PHASE4", "Phase 0, first in man": "EARLY_PHASE1", "Phase I-II": "PHASE1_PHASE2", "phase 2, then phase 4": "OTHER", "monophasic 2": "NONE",
        "phase2b/phase 3": "PHASE2_PHASE3", "phase - 1 , and 2": "PHASE1", "Phase I/IIa or III": "OTHER", "phase 1 2": "PHASE1", "phase phase 3": "PHASE3", "PHASE_1": "NONE", "phase 1b & phase-2": "PHASE1_PHASE2",
    }
    assert {t: one(spark, text.title_phase(F.lit(t).cast("string"))) for t in titles} == titles
    assert [one(spark, text.resolved_phase(F.lit(a).cast("string"), F.lit(b))) for a, b in ((None, "phase 3"), ("a study", "phase 3"), ("phase 2", "phase 3"))] == ["PHASE3", "PHASE3", "PHASE2"]
    normal = lambda t: one(spark, text.normalize_text(F.lit(t).cast("string")))
    assert normal("<p>a &amp;amp; b</p><p>x@y.org</p>") == "a & b\n[email removed]"
    assert normal("one\ntwo\n\n* item\n1. first\n2. second\n<!-- c -->\n\\*end") == "one two\nitem\nfirst\nsecond\n*end"
    assert normal("text\n3. goes on\n1. opens\n4. next\n\n   inside\n7. still\n\nplain\n8. joins") == "text 3. goes on\nopens\nnext\ninside\nstill\nplain 8. joins"
    assert normal("a &lt; b and c \\> d") == "a < b and c > d" and normal("age <5 or >60") == "age <5 or >60"
    assert normal(" \n") is None and normal(None) is None
    people = {("Jo Roe", "Indiv"): True, ("Jo Roe, MD", None): True, ("Roe Hospital, MD", None): False, ("Jo Roe MDs", None): False, ("Univ.-Prof. Jo Roe", "OTHER"): True, ("Dr. Roe Universitätsspital", None): False, ("ASST Milano", None): False, (None, "OTHER"): False}
    assert {p: one(spark, text.is_individual(*(F.lit(x).cast("string") for x in p))) for p in people} == people
    assert [one(spark, text.sponsor_key(F.lit(x).cast("string"))) for x in ("ＡＣＭＥ  Co.", "a_b", "--", None)] == ["acme co", "a_b", None, None]
    assert [one(spark, text.has_identity(F.lit(k).cast("string"), F.lit(i).cast("boolean"))) for k, i in (("acme", None), ("acme", True), ("redacted", False), ("dr roe", False), (None, False), ("", False))] == [True, False, False, False, False, False]
    stats = lambda t: [one(spark, c) for c in text.criteria_statistics(F.lit(t).cast("string")).values()]
    criteria = "Inclusion Criteria:\nage at least 18\n\nno exclusion so far\n Main exclusion criteria \nunder 5\nexclusion criteria may change"
    assert stats(criteria) == [2, 2, len(criteria), 2] and stats("weight ≥ 5 >=3\n:") == [2, 0, 16, 2] and stats(None)[2:] == [None, None]
    import hashlib
    import hmac

    assert one(spark, text.keyed_hash(F.lit("name"), "secret")) == hmac.new(b"secret", b"name", hashlib.sha256).hexdigest()
    assert one(spark, text.marker_code([(F.lit(1), F.lit(1)), (F.lit(None), F.lit(2)), (F.lit(None), F.lit(None))])) == 2
    assert one(spark, numbers.cif_from_hazards(F.array(F.struct(F.lit(0.1).alias("stop"), F.lit(0.2).alias("complete")), F.struct(F.lit(0.5).alias("stop"), F.lit(0.0).alias("complete"))))) == pytest.approx([0.1, 0.45])


def sponsor_log(seed, trials=60, names=8):
    r, rows = random.Random(seed), []
    for t in range(trials):
        day, key = D("2000-01-01") + timedelta(r.randrange(900)), f"s{r.randrange(names)}"
        for _ in range(r.randint(1, 6)):
            if r.random() < 0.4:
                key = None if r.random() < 0.1 else f"s{(int(key[1:]) + 1) % names if key else 0}"
            end = r.random()
            rows.append((t, day, key, end < 0.15, 0.15 <= end < 0.3, t % 7 != 0))
            day += timedelta(r.choice([20, 90, 200, 400]))
    return rows


class Replay:
    """The whole log in order, one event at a time, with every count looked up anew for each query."""

    def __init__(self, least=2, wait=365):
        self.least, self.wait = least, wait
        self.parent, self.runs, self.pending = {}, {}, {}
        self.registered, self.ended = {}, {}

    def root(self, key):
        return self.root(self.parent[key]) if key in self.parent else key

    def majority(self, key):
        run = self.runs[key]
        for other, n in run["taken"].items():
            if other and n >= self.least and 2 * n > sum(run["taken"].values()) + len(run["posting"]):
                return other
        return None

    def judged(self, key, day):
        found, run = (self.majority(key) if key in self.runs else None), self.runs.get(key)
        if found != self.pending.get(key, (None,))[0]:
            self.parent.pop(key, None)
            self.pending.pop(key, None)
            if found:
                self.pending[key] = [found, max(day, run["day"] + self.wait) + 1, False]

    def play(self, events):
        out = []
        for day, kind, key, other, trial, index in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3] or "", e[4])):
            for name, link in sorted(self.pending.items(), key=lambda x: (x[1][1], x[0])):
                if link[1] <= day and not link[2]:
                    link[2] = True
                    if self.root(link[0]) != name:
                        self.parent[name] = link[0]
            if kind == sponsors.QUERY:
                top = self.root(key)
                own = [t for t, k in self.registered.items() if t != trial and self.root(k) == top]
                ends = [term for t, (k, term) in self.ended.items() if t != trial and self.root(k) == top]
                out.append((trial, index, key, len(own), len(ends), ends.count("1")))
            elif kind == sponsors.APPEARANCE and key in self.runs:
                run = self.runs[key]
                if day > run["day"] and trial not in run["posting"]:
                    run["posting"].add(trial)
                    if len(run["posting"]) > sum(run["taken"].values()):
                        del self.runs[key]
                    self.judged(key, day)
            elif kind == sponsors.REPLACEMENT:
                run = self.runs.setdefault(key, {"day": day, "taken": {}, "posting": set()})
                run["taken"][other or ""] = run["taken"].get(other or "", 0) + 1
                run["posting"].discard(trial)
                self.judged(key, day)
            elif kind == sponsors.REGISTRATION:
                self.registered[trial] = key
            elif kind == sponsors.ENTER:
                self.ended[trial] = (key, other)
            elif kind == sponsors.LEAVE:
                self.ended.pop(trial, None)
        return out


def renamed_log(seed, trials=90, names=7):
    """Trials whose sponsors are renamed on a day, most of them for good, some back and forth, in chains and loops."""
    r, rows = random.Random(seed), []
    renames = sorted((D("2000-06-01") + timedelta(r.randrange(1_500)), f"s{r.randrange(names)}", f"s{r.randrange(names)}") for _ in range(9))
    for t in range(trials):
        day, key = D("2000-01-01") + timedelta(r.randrange(900)), f"s{r.randrange(names)}"
        for _ in range(r.randint(2, 9)):
            for since, old, new in renames:
                if since <= day and key == old and r.random() < 0.8:
                    key = new
            end = r.random()
            rows.append((t, day, key if r.random() > 0.05 else None, end < 0.15, 0.15 <= end < 0.3, t % 7 != 0))
            day += timedelta(r.choice([20, 90, 200, 300]))
    return rows


STATES = "trial_id long, effective_date date, sponsor_key string, stopped boolean, completed boolean, interventional boolean"


@pytest.mark.parametrize("log", [sponsor_log(1), renamed_log(2), renamed_log(3, 150, 5), renamed_log(4, 60, 12)])
def test_track_records_equal_a_replay(spark, log):
    states = spark.createDataFrame(log, STATES)
    queries = states.select("trial_id", (F.datediff("effective_date", F.lit(D("2000-01-01"))) % 50).cast("int").alias("landmark_index"), F.date_add("effective_date", 30).alias("landmark_date"), "sponsor_key").dropDuplicates(["trial_id", "landmark_index"])
    queries = spark.createDataFrame(queries.collect(), queries.schema)
    events = sponsors.sponsor_events(states, queries)
    rows = [((r.day - D("1970-01-01")).days, r.kind, r.key, r.other, r.trial_id, r.landmark_index) for r in events.collect()]
    want = sorted(Replay().play(rows))
    assert sorted(map(tuple, sponsors.track_records(events).collect())) == want
    assert sorted(map(tuple, sponsors.strict_counts(events).collect())) != want  # there are aliases


def test_alias_counts_after_a_year_and_loops_are_not_closed(spark):
    day = lambda n: D("2000-01-01") + timedelta(n)
    rows = [(day(0), kind, "old", None, t, None) for t in range(3) for kind in (sponsors.APPEARANCE, sponsors.REGISTRATION)]
    rows += [(day(10), sponsors.REPLACEMENT, "old", "new", t, None) for t in range(3)] + [(day(10), sponsors.APPEARANCE, "new", None, t, None) for t in range(3)]
    rows += [(day(500), sponsors.REPLACEMENT, "new", "old", t, None) for t in range(2)]
    rows += [(day(n), sponsors.QUERY, "new", None, t, i) for i, (n, t) in enumerate([(200, 9), (375, 9), (376, 9), (376, 1), (2_000, 9)])]
    events = spark.createDataFrame(rows, sponsors.EVENT)
    got = {r.landmark_index: r.registrations for r in sponsors.track_records(events).collect()}
    assert got == {0: 0, 1: 0, 2: 3, 3: 2, 4: 3}
    spans = [tuple(r) for r in sponsors.alias_spans(sponsors.alias_candidates(events)).collect()]
    assert spans == [("old", "new", day(376), None)]


def test_own_trial_is_no_other_trial(spark):
    rows = [(D("2000-01-01"), sponsors.REGISTRATION, "a", None, 1, None), (D("2000-02-01"), sponsors.ENTER, "a", "1", 1, None), (D("2000-03-01"), sponsors.QUERY, "a", None, 1, 0), (D("2000-03-01"), sponsors.QUERY, "a", None, 2, 0)]
    got = {r.trial_id: (r.registrations, r.ended, r.stopped) for r in sponsors.strict_counts(spark.createDataFrame(rows, sponsors.EVENT)).collect()}
    assert got == {1: (0, 0, 0), 2: (1, 1, 1)}


def test_strict_counts_exclude_the_day(spark):
    rows = [(D("2000-01-01"), sponsors.REGISTRATION, "a", None, 1, None), (D("2000-01-02"), sponsors.QUERY, "a", None, 9, 0), (D("2000-01-02"), sponsors.REGISTRATION, "a", None, 2, None), (D("2000-01-02"), sponsors.ENTER, "a", "1", 2, None), (D("2000-01-03"), sponsors.QUERY, "a", None, 9, 1)]
    got = {r.landmark_index: (r.registrations, r.ended, r.stopped) for r in sponsors.strict_counts(spark.createDataFrame(rows, sponsors.EVENT.replace("key string, other string, trial_id long", "key string, other string, trial_id long"))).collect()}
    assert got == {0: (1, 0, 0), 1: (2, 1, 1)}


def test_curves_and_metrics_against_numpy(spark):
    r = np.random.default_rng(3)
    n = 400
    time, event, score = r.integers(1, 40, n), r.integers(0, 3, n), np.round(r.random(n), 2)
    rows = spark.createDataFrame([(i, "all", int(t), int(e), float(s)) for i, (t, e, s) in enumerate(zip(time, event, score))], "id long, g string, time int, event int, score double")
    s = cif = 1.0
    cif, surv, cens, g = 0.0, {}, {}, 1.0
    for t in sorted(set(time)):
        risk = (time >= t).sum()
        d = ((time == t) & (event > 0)).sum()
        cif += s * ((time == t) & (event == 1)).sum() / risk
        s *= 1 - d / risk
        left = risk - d
        g *= 1 - (((time == t) & (event == 0)).sum() / left if left else 0)
        surv[int(t)], cens[int(t)] = (s, cif), g
    km = {r.t: r.survival for r in survival.kaplan_meier(rows, ["g"], "time", "event").collect()}
    aj = {r.t: r.cif for r in survival.aalen_johansen(rows, ["g"], "time", "event").collect()}
    assert all(abs(km[t] - v[0]) < 1e-12 and abs(aj[t] - v[1]) < 1e-12 for t, v in surv.items())
    h = 20
    weighted = survival.ipcw(rows, "g", "time", "event", h)
    at = lambda x, strict: next((v for t, v in sorted(cens.items(), reverse=True) if (t < x if strict else t <= x)), 1.0)
    want = np.array([1 / at(t, True) if t <= h and e else 0.0 if t <= h else 1 / at(h, False) for t, e in zip(time, event)])
    got = {r.id: r.weight for r in weighted.collect()}
    assert np.allclose([got[i] for i in range(n)], want)
    label = (time <= h) & (event == 1)
    p, q = np.flatnonzero(label & (want > 0)), np.flatnonzero(~label & (want > 0))
    pairs = want[p][:, None] * want[q][None] * ((score[p][:, None] > score[q][None]) + 0.5 * (score[p][:, None] == score[q][None]))
    auc = survival.weighted_auc(weighted, [], "score", "label", "weight").first()["auc"]
    assert abs(auc - pairs.sum() / (want[p].sum() * want[q].sum())) < 1e-12
    low, high = survival.interval(survival.bootstrap_auc(weighted, "score", "label", "weight", "id", 200), [], "auc").first()
    assert low < auc < high
    intercept, slope = survival.calibration_slope(weighted.filter("score > 0 and score < 1"), "score", "label", "weight")
    inside = (score > 0) & (score < 1)
    x, y, w = np.log(score / np.where(inside, 1 - score, 1), where=inside, out=np.zeros(n))[inside], label[inside].astype(float), want[inside]
    e = y - 1 / (1 + np.exp(-(intercept + slope * x)))
    assert abs((w * e).sum()) < 1e-5 and abs((w * e * x).sum()) < 1e-5


def test_agreement(spark):
    rows = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15, "x string, y string")
    assert survival.agreement(rows, "x", "y").first()["kappa"] == pytest.approx(0.4)


def test_compare(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (2, "b", 1)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "a", 5), (2, "b", 1), (3, "c", None)], "k int, s string, n int")
    assert {r.column: r.n_differ for r in compare.column_differences(old, new, ["k"]).collect()} == {"s": 0, "n": 1}
    assert {r.presence: r.n for r in compare.key_overlap(old, new, ["k"]).collect()} == {"both": 2, "only_new": 1}
    assert sorted((r.k, r.side) for r in compare.multiset_difference(old, new).collect()) == [(1, "new"), (1, "old"), (2, "old"), (3, "new")]
    assert compare.checksum(old).first() == compare.checksum(old.orderBy(F.desc("k"))).first() != compare.checksum(new).first()
    log = spark.createDataFrame([(1, 1, D("2000-01-01"))], "id int, v int, d date")
    more = spark.createDataFrame([(1, 2, D("2000-01-01")), (2, 1, D("1999-01-01"))], "id int, v int, d date")
    assert compare.combine(log, more, "id", "v", "d").count() == 3
    with pytest.raises(ValueError):
        compare.combine(log, more.withColumn("v", F.lit(1)), "id", "v", "d")


def test_upsert_is_idempotent(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = serving.upsert(held, batch, ["k"])
    assert {r.k: (r.v, r.change) for r in once.collect()} == {1: ("a", "kept"), 2: ("c", "updated"), 3: ("d", "inserted")}
    again = serving.upsert(once.drop("change"), batch, ["k"])
    assert {r.change for r in again.collect()} == {"kept"}
    assert {r.k for r in serving.upsert(held, batch, ["k"], prune=True).collect()} == {2, 3}


def test_monitoring(spark):
    assert monitoring.promote(0.70, 0.696, 1.0) and not monitoring.promote(0.70, 0.69, 1.0) and not monitoring.promote(0.7, 0.8, 1.3) and not monitoring.promote(None, 0.8, 1.0)
    assert monitoring.alerts(D("2020-01-10"), D("2020-01-01"), 5, 100, 0, 10, 0.6) == ["lag", "quarantine", "auc"]
    same = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert monitoring.stability_index(same, same, "x").first()["psi"] == pytest.approx(0)
    assert monitoring.stability_index(same, same.withColumn("x", F.col("x") + 400), "x").first()["psi"] > 0.25
    assert one(spark, models.majority(F.array(F.lit("a"), F.lit("b"), F.lit("a")))) == "a" and one(spark, models.majority(F.array(F.lit("a"), F.lit("b")))) is None


def test_state_decisions():
    held, days = Held(), [D("2020-01-01"), D("2020-02-01"), D("2020-03-01")]
    go = lambda d, s, h: apply_record(held, d, s, h, TERMINAL)
    assert [go(days[0], "R", "1"), go(days[0], "R", "1"), go(days[0], "S", "2"), go(days[1], "COMPLETED", "3"), go(days[0], "R", "9"), go(days[2], "COMPLETED", "4"), go(D("2020-04-01"), "R", "5")] == ["new", "overlap", "replacement", "version", "late", "closed", "reopened"]
    assert held.n_versions == 4 and Held.loads(held.dumps()) == held


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(4)
    rows = [(i % 9, D("2020-01-01") + timedelta(n // 3), n, r.choice(["R", "SUSPENDED", "COMPLETED", None]), str(r.randrange(4))) for n, i in enumerate(r.choices(range(9), k=90))]
    log = spark.createDataFrame(rows, RECORD)
    for k, part in enumerate(range(0, 90, 30)):
        pd.DataFrame(rows[part : part + 30], columns=["id", "day", "seq", "status", "hash"]).to_parquet(tmp_path / "x.parquet")
        spark.createDataFrame(rows[part : part + 30], RECORD).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
        daily.run_stream(spark, f"{tmp_path}/source", f"{tmp_path}/sink", f"{tmp_path}/mark", TERMINAL)
    streamed = spark.read.parquet(f"{tmp_path}/sink").drop("batch")
    want = batch_changes(log, TERMINAL)
    assert streamed.exceptAll(want).count() == want.exceptAll(streamed).count() == 0 and want.count() == 90


def test_gates(spark, tmp_path):
    stored = spark.createDataFrame([(i, "x") for i in range(50)], "k int, v string")
    daily.null_gate(stored, stored, ["k"], ["v"])
    with pytest.raises(daily.GateError):
        daily.null_gate(stored, stored.withColumn("v", F.when(F.col("k") > 2, F.col("v"))), ["k"], ["v"])
    daily.overlap_gate(stored, stored.filter("k > 4"), ["k"])
    with pytest.raises(daily.GateError):
        daily.overlap_gate(stored, stored.filter("k > 9"), ["k"])
    for _ in range(2):
        daily.append_once(spark, f"{tmp_path}/t", stored, ["k"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 50


def test_readers(spark, tmp_path):
    spark.createDataFrame([(1, True)], "id long, flag boolean").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(2, 1, "x")], "id long, flag int, extra string").write.parquet(f"{tmp_path}/b")
    files = [f"{tmp_path}/a", f"{tmp_path}/b"]
    rows = readers.read_versions(spark, files, {"id": "long", "flag": "boolean", "extra": "string"}).orderBy("id").collect()
    assert [(r.id, r.flag, r.extra) for r in rows] == [(1, True, None), (2, True, "x")] and all(r.source_file and r.source_row is not None for r in rows)
    assert set(readers.drifted_columns(spark, files)) == {"flag"}
    with pytest.raises(ValueError, match="retyped flag"):
        readers.check_layout(spark.read.parquet(files[1]).schema, spark.read.parquet(files[0]).schema, allowed_new=["extra"])
    (tmp_path / "j").write_text("\n".join(json.dumps(x) for x in [{"id": 1, "v": 1, "secret": 2}, {"id": 1, "v": 2}]))
    assert [r.asDict() for r in readers.read_latest_json(spark, f"{tmp_path}/j", "id long, v long", "id", "v").collect()] == [{"id": 1, "v": 2}]
    replies = {None: {"totalCount": 3, "studies": [1, 2], "nextPageToken": "t"}, "t": {"studies": [3]}}
    assert list(readers.pages(lambda p: replies[p.get("pageToken")], {})) == [[1, 2], [3]]
    with pytest.raises(ValueError):
        list(readers.pages(lambda p: {"totalCount": 2, "studies": [1]}, {}))
    assert readers.without_keys({"a": [{"b": 1, "c": 2}]}, frozenset("b")) == {"a": [{"c": 2}]}


def test_writers(spark, tmp_path):
    rows = spark.range(100).withColumn("month", F.when(F.col("id") < 50, "m1").otherwise("m2"))
    path, manifest = f"{tmp_path}/t", f"{tmp_path}/manifest"
    first = writers.write_table(rows, path, ["id"])
    assert writers.write_manifest(spark, manifest, {"t": first}) == {"t": "new"}
    assert writers.write_manifest(spark, manifest, {"t": writers.write_table(rows.orderBy(F.desc("id")), path, ["id"])}) == {"t": "identical"}
    assert writers.retain(spark, path, F.col("id") < 30, f"{tmp_path}/archive")["archived"] == 30 and spark.read.parquet(path).count() == 70
    assert writers.retain(spark, path, F.col("id") < 50, f"{tmp_path}/archive")["archived"] == 20 and spark.read.parquet(path).count() == 50
    assert writers.retain(spark, path, F.col("id") < 50, f"{tmp_path}/archive")["archived"] == 0 and spark.read.parquet(f"{tmp_path}/archive").count() == 50
    writers.compact(spark, path)
    saved = writers.backup(spark, str(tmp_path), ["t"], f"{tmp_path}/saved")
    writers.restore(spark, f"{tmp_path}/saved", saved, f"{tmp_path}/back")
    assert spark.read.parquet(f"{tmp_path}/back/t").count() == 50
    with pytest.raises(OSError):
        writers.restore(spark, f"{tmp_path}/saved", {"t": saved["t"] | {"rows": 1}}, f"{tmp_path}/back")
    writers.write_month(rows, f"{tmp_path}/m", "month")
    writers.write_month(rows.filter("month = 'm2'").limit(3), f"{tmp_path}/m", "month")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 53


def test_text_components_against_a_dense_decomposition(spark):
    from palimpsest.operators.text_svd import fit_components, weighted, word_counts
    from palimpsest.session import shared_folder

    shared_folder(spark)
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"word{int(x)}" for x in r.zipf(1.6, 40) % 60)) for i in range(50)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    model = fit_components(docs, "id", "text", k=4, features=512)
    got = {x.id: x.components for x in model.transform(docs, "id", "text").collect()}
    dense = np.zeros((50, 512))
    for x in weighted(word_counts(docs, "id", "text", 512), model.document_counts, model.n_texts).collect():
        dense[x.key, x.terms] = x.weights
    assert np.allclose(np.linalg.norm(dense, axis=1), 1)
    values = np.linalg.svd(dense, compute_uv=False)
    found = np.array([got[i] for i in range(50)])
    assert np.allclose(found, dense @ model.basis, atol=1e-5) and np.allclose(model.basis.T @ model.basis, np.eye(4), atol=1e-8)
    energy = (found**2).sum(axis=0)
    assert abs(energy[0] / values[0] ** 2 - 1) < 1e-6 and energy.sum() > 0.99 * (values[:4] ** 2).sum() and list(energy) == sorted(energy, reverse=True)
    assert got[90] == got[91] == [0.0] * 4
