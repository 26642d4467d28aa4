"""Queries of populations, drift references, checked joins and displayed values."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.nested import flattened
from ..operators import cohort, drift, monitoring, population, records
from ..operators.canonical import Layout, canonical, contract, split_valid
from ..operators.census import census, differences, hidden_versions, judged, next_pull
from ..operators.versions import latest_per, quarantine
from .registry import STUDY, VERSIONS_SQL, cohort_sql, query, table, versions

WITH = f"WITH {VERSIONS_SQL}"
FULL = f"{WITH}, {cohort_sql()}"
DAY, ORIGIN = date(1998, 6, 15), date(2000, 1, 1)
BANDS = {"late": (7, 9, True), "very late": (10, 12, False)}


@query(f"""{FULL}, v AS (SELECT * FROM versions WHERE effective_date <= DATE '1998-06-15'),
tr AS (SELECT trial_id, arg_min(first_post_date, version) AS t0, min(version) FILTER (WHERE status IN ('COMPLETED','TERMINATED','WITHDRAWN')) AS fin, max(version) FILTER (WHERE status IN ('RECRUITING','SUSPENDED','UNKNOWN')) AS op FROM v GROUP BY 1),
n AS (SELECT trial_id, t0, coalesce(op > fin, false) AS reversal, DATE '1998-06-15' AS day FROM tr WHERE t0 BETWEEN DATE '1995-01-01' AND DATE '1998-06-15'),
p AS (SELECT n.trial_id, n.t0, reversal, coalesce(stratum, 'MISSING') AS stratum FROM n ASOF JOIN states s ON s.trial_id = n.trial_id AND n.day >= s.effective_date WHERE study_type = 'INTERVENTIONAL' AND status IN ('RECRUITING','SUSPENDED') AND NOT coalesce(lapse_from <= n.day, false)),
k AS (SELECT *, (SELECT max(i) FROM range(0, 30) r(i) WHERE CAST(t0 + to_months(CAST(6 * i AS INTEGER)) AS DATE) <= DATE '1998-06-15') AS true_index FROM p),
q AS (SELECT *, least(true_index, 6) AS k_star FROM k), l AS (SELECT *, CAST(t0 + to_months(CAST(6 * k_star AS INTEGER)) AS DATE) AS landmark_date FROM q)
SELECT trial_id, t0, reversal, stratum, true_index, k_star, landmark_date, CAST(t0 + to_months(CAST(6 * k_star - 6 AS INTEGER)) AS DATE) + CAST(date_diff('day', landmark_date, DATE '1998-06-15') AS INTEGER) AS window_start,
  true_index BETWEEN 7 AND 9 AS flagged, CASE WHEN reversal THEN 'reversal' WHEN true_index >= 13 THEN 'oldest' WHEN true_index BETWEEN 10 AND 12 THEN 'band' END AS reason FROM l""")
def population_on_a_day(spark, sf_dir):
    return population.served_rows(population.open_on(versions(spark, sf_dir), STUDY, DAY), STUDY, DAY, BANDS, 13)


FRIDAYS = f"""{FULL}, days AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '1997-07-04', DATE '1998-06-26', INTERVAL 7 DAY) s(d)),
tr AS (SELECT day, trial_id, arg_min(first_post_date, version) AS t0, min(version) FILTER (WHERE status IN ('COMPLETED','TERMINATED','WITHDRAWN')) AS fin, max(version) FILTER (WHERE status IN ('RECRUITING','SUSPENDED','UNKNOWN')) AS op
  FROM days JOIN versions ON effective_date <= day GROUP BY ALL),
n AS (SELECT day, trial_id, t0, coalesce(op > fin, false) AS reversal FROM tr WHERE t0 BETWEEN DATE '1995-01-01' AND day),
p AS (SELECT n.day, n.trial_id, n.t0, reversal, coalesce(stratum, 'MISSING') AS stratum FROM n ASOF JOIN states s ON s.trial_id = n.trial_id AND n.day >= s.effective_date WHERE study_type = 'INTERVENTIONAL' AND status IN ('RECRUITING','SUSPENDED') AND NOT coalesce(lapse_from <= n.day, false)),
k AS (SELECT *, (SELECT max(i) FROM range(0, 30) r(i) WHERE CAST(t0 + to_months(CAST(6 * i AS INTEGER)) AS DATE) <= day) AS true_index FROM p)"""


@query(f"""{FRIDAYS}
SELECT day, trial_id, t0, reversal, stratum, true_index, least(true_index, 6) AS k_star, true_index BETWEEN 7 AND 9 AS flagged, CASE WHEN reversal THEN 'reversal' WHEN true_index >= 13 THEN 'oldest' WHEN true_index BETWEEN 10 AND 12 THEN 'band' END AS reason FROM k""")
def population_on_fridays(spark, sf_dir):
    """Who is open on each Friday of a year, and how the row of that day is served."""
    people = population.open_weekly(versions(spark, sf_dir), STUDY, date(1997, 7, 1), date(1998, 6, 30))
    rows = population.served_rows(people, STUDY, F.col("day"), BANDS, 13)
    return rows.select("day", "trial_id", "t0", "reversal", "stratum", "true_index", "k_star", "flagged", "reason")


@query(f"""{FRIDAYS} SELECT k.day, k.trial_id, true_index, o.event, o.event_date, date_diff('day', k.day, o.event_date) AS "time" FROM k JOIN outcomes o USING (trial_id) WHERE NOT o.reversal AND o.event_date > k.day AND NOT k.reversal AND true_index < 10""")
def outcomes_after_fridays(spark, sf_dir):
    """What became of the trials that were scored on each Friday of a year."""
    held = versions(spark, sf_dir)
    people = population.open_weekly(held, STUDY, date(1997, 7, 1), date(1998, 6, 30))
    scored = population.served_rows(people, STUDY, F.col("day"), BANDS, 13).filter("reason is null").select("trial_id", "day", "true_index")
    return monitoring.replay_outcomes(scored, cohort.outcomes(held, STUDY)).select("day", "trial_id", "true_index", "event", "event_date", "time")


@query(f"""{FULL}, {cohort_sql('2000-01-01', '2000-01-01', 'a_')}
SELECT 'training' AS part, trial_id, landmark_index, event, date_diff('day', landmark_date, event_date) AS "time" FROM a_landmarks WHERE excluded IS NULL AND landmark_date < DATE '2000-01-01'
UNION ALL SELECT 'evaluation', trial_id, landmark_index, event, date_diff('day', landmark_date, event_date) FROM landmarks WHERE excluded IS NULL AND landmark_date >= DATE '2000-01-01' AND landmark_date < DATE '2001-01-01'""")
def rows_of_an_origin(spark, sf_dir):
    held = versions(spark, sf_dir)
    known = cohort.landmarks(held, STUDY, before=ORIGIN).filter("excluded is null").filter(F.col("landmark_date") < F.lit(ORIGIN))
    later = cohort.landmarks(held, STUDY).filter("excluded is null")
    parts = {"training": population.training_rows(known, ORIGIN), "evaluation": population.evaluation_rows(later, ORIGIN)}
    each = [rows.select(F.lit(name).alias("part"), "trial_id", "landmark_index", "event", "time") for name, rows in parts.items()]
    return each[0].unionByName(each[1])


@query(f"""{FULL}, g AS (SELECT trial_id, t0, 'between' AS kind, CAST(k AS INTEGER) AS landmark_index, CAST(6 * k + 3 AS INTEGER) AS m FROM outcomes, range(7) r(k) UNION ALL SELECT trial_id, t0, 'beyond', CAST(k AS INTEGER), CAST(6 * k AS INTEGER) FROM outcomes, range(7, 12) r(k)),
d AS (SELECT trial_id, kind, landmark_index, CAST(t0 + to_months(m) AS DATE) AS landmark_date, CAST(t0 + to_months(CAST(6 * landmark_index AS INTEGER)) AS DATE) AS base_date FROM g WHERE t0 IS NOT NULL)
SELECT * FROM d WHERE landmark_date >= DATE '1997-01-01' AND landmark_date < DATE '1998-01-01'""")
def off_grid_candidates(spark, sf_dir):
    trials = cohort.outcomes(versions(spark, sf_dir), STUDY).select("trial_id", "t0")
    return population.off_grid_rows(trials, STUDY, date(1997, 1, 1), date(1998, 1, 1), 12)


@query("""WITH q AS (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), list_transform(range(0, 101), lambda i: i / 100.0)) AS e, count(*) AS n FROM orders),
d AS (SELECT list_sort(list_distinct(e)) AS e, n FROM q), b AS (SELECT e, n, unnest(range(1, len(e))) AS i FROM d)
SELECT e[i] AS low, e[i + 1] AS high, (SELECT count(*) FROM orders WHERE o_totalprice >= e[i] AND (o_totalprice < e[i + 1] OR (i + 1 = len(e) AND o_totalprice <= e[i + 1]))) / n AS share FROM b""")
def drift_reference(spark, sf_dir):
    """Percentile bins of a column without point masses."""
    return drift.reference(table(spark, sf_dir, "orders"), "o_totalprice")


@query("""WITH n AS (SELECT s_nationkey AS v, count(*) AS n FROM supplier GROUP BY 1) SELECT c_custkey, (SELECT coalesce(sum(CASE WHEN v < c_nationkey THEN n WHEN v = c_nationkey THEN n / 2 ELSE 0 END), 0) / sum(n) FROM n) AS "position" FROM customer""")
def drift_positions(spark, sf_dir):
    known = drift.reference(table(spark, sf_dir, "supplier"), "s_nationkey")
    return drift.position(table(spark, sf_dir, "customer"), "c_nationkey", known).select("c_custkey", "position")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS text_id, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def dictionary_join(spark, sf_dir):
    """Texts leave the rows for a dictionary under their hash, and come back by it."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.text_hash(F.col("text")).alias("hash"), "text")
    dictionary = docs.groupBy("hash").agg(F.min("doc_id").alias("text_id"), F.first("text").alias("text"))
    return docs.select("doc_id", "hash").join(dictionary, "hash").select("doc_id", "text_id", F.length("text").alias("n_chars"))


@query(f"""{WITH}, m AS (SELECT coalesce(sponsor_key, '') AS k, min(version) AS first_version FROM versions GROUP BY 1) SELECT v.trial_id, v.version, first_version FROM versions v JOIN m ON coalesce(v.sponsor_key, '') = m.k""")
def names_with_missing_ones(spark, sf_dir):
    held = versions(spark, sf_dir).select("trial_id", "version", "sponsor_key")
    names = held.groupBy(F.nullif(F.coalesce("sponsor_key", F.lit("")), F.lit("")).alias("sponsor_key")).agg(F.min("version").alias("first_version"))
    return records.mapped_values(held, names, "sponsor_key", "first_version").select("trial_id", "version", "first_version")


@query("""SELECT coalesce(c_custkey, s_suppkey) AS id, c_acctbal, s_acctbal, CASE WHEN s_suppkey IS NULL THEN 'left_only' WHEN c_custkey IS NULL THEN 'right_only' ELSE 'both' END AS side FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) FULL JOIN supplier ON c_custkey = s_suppkey""")
def one_to_one_merge(spark, sf_dir):
    left = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return records.one_to_one(left, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal"), ["id"])


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def misaligned_keys(spark, sf_dir):
    return records.misaligned(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query(f"""{WITH}, e AS (SELECT year(effective_date) AS y, unnest(['status', 'stratum', 'enrollment_type']) AS "column", unnest([status, stratum, enrollment_type]) AS value FROM versions) SELECT "column", value, count(*) AS n, min(y) AS first_year, max(y) AS last_year FROM e GROUP BY ALL""")
def values_by_year_with_quarantine(spark, sf_dir):
    """Values of accepted rows and of those set aside, which hold a reason more."""
    held = versions(spark, sf_dir).withColumn("status", cohort.submitted_status(STUDY)).select("effective_date", "status", "stratum", "enrollment_type")
    good, bad = quarantine(held, {"status: not suspended": F.col("status") != "SUSPENDED"})
    return records.value_years(good, "effective_date", ["status", "stratum", "enrollment_type"], bad)


@query(f"""{WITH} SELECT sponsor_key, row_number() OVER (ORDER BY sponsor_key) - 1 AS code FROM (SELECT DISTINCT sponsor_key FROM versions WHERE sponsor_key IS NOT NULL)""")
def sponsor_codes(spark, sf_dir):
    return records.dense_codes(versions(spark, sf_dir), "sponsor_key")


@query("SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997")
def keys_of_both_years(spark, sf_dir):
    of = lambda year: table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == year).select("o_custkey")
    return of(1996).intersect(of(1997))


@query("""WITH n AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Jo Roe' WHEN 1 THEN 'Roe Trust' WHEN 2 THEN 'Roelabs' WHEN 3 THEN 'Universitas Roe' ELSE 'Jo Roe and Sons' END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'INDUSTRY' ELSE 'OTHER' END AS class, c_custkey % 9 AS led FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 5 IN (1, 2, 3) OR (class = 'INDUSTRY' AND led >= 5) THEN name END AS shown FROM n""")
def shown_names(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "Jo Roe").when(k % 5 == 1, "Roe Trust").when(k % 5 == 2, "Roelabs").when(k % 5 == 3, "Universitas Roe").otherwise("Jo Roe and Sons")
    kind = F.when(k % 2 == 0, "INDUSTRY").otherwise("OTHER")
    return table(spark, sf_dir, "customer").select("c_custkey", text.display_name(name, kind, k % 9, ["trust", "council"], ["universit"], ["INDUSTRY", "NIH"]).alias("shown"))


@query(f"""{WITH} SELECT version, sha256(concat_ws(chr(31), CAST(trial_id AS VARCHAR), coalesce(status, ''), coalesce(CAST(start_date AS VARCHAR), ''), coalesce(CAST(healthy_volunteers AS VARCHAR), ''), coalesce(CAST(maximum_age_years AS VARCHAR), ''), coalesce(array_to_string(intervention_types, '|'), ''))) AS digest FROM versions""")
def row_digests(spark, sf_dir):
    held = versions(spark, sf_dir).withColumn("status", cohort.submitted_status(STUDY))
    return held.select("version", text.row_digest(held, ["trial_id", "status", "start_date", "healthy_volunteers", "maximum_age_years", "intervention_types"]).alias("digest"))


@query("""SELECT p_partkey, lower(p_name) || CASE WHEN p_partkey % 2 = 0 THEN ' (no "funds"), or so' ELSE '' END AS reason FROM part""")
def reason_texts(spark, sf_dir):
    end = F.when(F.col("p_partkey") % 2 == 0, ' (no "funds"),\n\tor  so').otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", text.reason_text(F.concat(F.lit(' "('), F.upper("p_name"), end, F.lit('.") ...  '))).alias("reason"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey * 37 AS DOUBLE) WHEN 1 THEN p_partkey * 37 + 0.25 WHEN 2 THEN p_size / 64.0 WHEN 3 THEN -p_size / 1024.0 END AS x FROM part)
SELECT p_partkey, CASE WHEN x IS NULL THEN 'not given' WHEN x = round(x) AND abs(x) < 10000 THEN CAST(CAST(x AS BIGINT) AS VARCHAR) WHEN x = round(x) OR abs(x) >= 1000 THEN format('{:,}', CAST(floor(x) AS BIGINT)) ELSE printf('%.3g', x) END AS shown FROM p""")
def shown_values(spark, sf_dir):
    k = F.col("p_partkey")
    x = F.when(k % 5 == 0, (k * 37).cast("double")).when(k % 5 == 1, k * 37 + 0.25).when(k % 5 == 2, F.col("p_size") / 64).when(k % 5 == 3, -F.col("p_size") / 1024)
    return table(spark, sf_dir, "part").select("p_partkey", text.shown(x, "number").alias("shown"))


@query("""SELECT o_orderkey, unnest(list_filter(list_transform(range(0, o_orderkey % 20 + 1), lambda i: CAST(o_orderdate AS DATE) + CAST(i AS INTEGER)), lambda d: isodow(d) = 5)) AS friday FROM orders""")
def weekly_dates(spark, sf_dir):
    d = F.to_date("o_orderdate")
    fridays = dates.weekly_dates(d, F.date_add(d, (F.col("o_orderkey") % 20).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(fridays).alias("friday"))


@query("""WITH p AS (SELECT conv_id, CASE WHEN turn % 4 = 0 THEN '' WHEN turn % 4 = 1 THEN 'a' ELSE 'b' END AS name, CASE WHEN turn % 5 <> 0 THEN role END AS kind FROM conversations),
d AS (SELECT DISTINCT conv_id, name, kind FROM p WHERE name <> '' AND kind IS NOT NULL) SELECT c.conv_id, coalesce(string_agg(kind, '|' ORDER BY kind), '') AS kinds FROM (SELECT DISTINCT conv_id FROM p) c LEFT JOIN d USING (conv_id) GROUP BY 1""")
def named_kinds(spark, sf_dir):
    t = F.col("turn")
    pair = F.struct(F.when(t % 4 == 0, "").when(t % 4 == 1, "a").otherwise("b").alias("name"), F.when(t % 5 != 0, F.col("role")).alias("kind"))
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(pair).alias("items"))
    return nested.select("conv_id", F.array_join(records.named_kinds(F.col("items")), "|").alias("kinds"))


@query(f"""{WITH} SELECT field, applicable, present, present / applicable AS share FROM (SELECT 'completion' AS field, count(*) AS applicable, count(completion_date) AS present FROM versions
UNION ALL SELECT 'verified', count(*) FILTER (WHERE status = 'RECRUITING'), count(status_verified_date) FILTER (WHERE status = 'RECRUITING') FROM versions UNION ALL SELECT 'count', count(*) FILTER (WHERE enrollment_type = 'ACTUAL'), count(enrollment_count) FILTER (WHERE enrollment_type = 'ACTUAL') FROM versions)""")
def field_presence(spark, sf_dir):
    held = versions(spark, sf_dir).withColumn("status", cohort.submitted_status(STUDY))
    c, yes = F.col, F.lit(True)
    return records.presence(held, {"completion": (c("completion_date"), yes), "verified": (c("status_verified_date"), c("status") == "RECRUITING"), "count": (c("enrollment_count"), F.coalesce(c("enrollment_type") == "ACTUAL", F.lit(False)))})


@query(f"""{WITH} SELECT trial_id, version, coalesce(first_post_date, effective_date) AS posted, intervention_types[1] AS first_type, CAST(NULL AS DOUBLE) AS dose FROM versions""")
def adapted_rows(spark, sf_dir):
    """An older layout: a list for its first entry, two dates for one, a column that is not there."""
    types = {"trial_id": "long", "version": "long", "posted": "date", "first_type": "string", "dose": "double"}
    return records.adapted(versions(spark, sf_dir), types, {"first_type": "intervention_types"}, {"posted": ["first_post_date", "reset_date", "effective_date"]})


@query("""WITH n AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey & 1 > 0 THEN 'status' END, CASE WHEN o_orderkey & 2 > 0 THEN 'dates' END, CASE WHEN o_orderkey & 4 > 0 THEN 'enrollment' END], lambda x: x IS NOT NULL) AS l FROM orders) SELECT o_orderkey, CASE WHEN len(l) = 0 THEN 'record' ELSE array_to_string(l, '|') END AS names FROM n""")
def marker_groups(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.marker_names(F.col("o_orderkey"), ["status", "dates", "enrollment"]), "|").alias("names"))


@query(f"""{WITH}, f AS (SELECT trial_id, arg_min(first_post_date, version) AS t0 FROM versions GROUP BY 1), l AS (SELECT *, lag(status) OVER (PARTITION BY trial_id ORDER BY version) AS before FROM versions)
SELECT l.trial_id, version, effective_date, status, before, coalesce(effective_date = t0, false) AS first_posted FROM l LEFT JOIN f USING (trial_id)""")
def timeline(spark, sf_dir):
    """A record's versions in order, with what came before and whether it is the first posting."""
    held = versions(spark, sf_dir).withColumn("status", cohort.submitted_status(STUDY))
    first = held.groupBy("trial_id").agg(cohort.arg_min(F.col("first_post_date"), F.col("version")).alias("t0"))
    before = F.lag("status").over(Window.partitionBy("trial_id").orderBy("version"))
    rows = held.withColumn("before", before).join(first, "trial_id", "left")
    return rows.select("trial_id", "version", "effective_date", "status", "before", F.coalesce(F.col("effective_date") == F.col("t0"), F.lit(False)).alias("first_posted"))


@query("""SELECT substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS "year", count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def reasons_by_year(spark, sf_dir):
    """A pivot for a stacked chart."""
    year = F.substring(F.to_date("o_orderdate").cast("string"), 1, 4).alias("year")
    return table(spark, sf_dir, "orders").groupBy(year).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS "rank" FROM supplier) SELECT * FROM r WHERE s_suppkey % 4 <> 0""")
def ranks_before_flags(spark, sf_dir):
    """Ranks stay as they were when flagged rows are hidden."""
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", rank.alias("rank")).filter("s_suppkey % 4 <> 0")


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN p_size < 10 THEN 3 WHEN p_size < 20 THEN 1 END, CASE WHEN p_partkey % 2 = 0 THEN 1 END, CASE WHEN p_partkey % 3 = 0 THEN 2 END], lambda x: x IS NOT NULL))), ',') AS areas FROM part""")
def areas_of_terms(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    ids = F.array(F.when(size < 10, "C04").when(size < 20, "C14").otherwise("Z99"), F.when(k % 2 == 0, "C14"), F.when(k % 3 == 0, "C10"))
    codes = text.area_codes(F.array_compact(ids), {"C14": 1, "C10": 2, "C04": 3})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(codes.cast("array<string>"), ",").alias("areas"))


@query(f"""{WITH}, k AS (SELECT trial_id, arg_min(sponsor_key, version) AS a, arg_max(sponsor_key, version) AS b, count(DISTINCT sponsor_key) AS n FROM versions GROUP BY 1) SELECT CASE WHEN a IS NULL THEN 'never named' WHEN n = 1 THEN 'same' WHEN a = b THEN 'back again' ELSE 'renamed' END AS cause, count(*) AS trials FROM k GROUP BY 1""")
def renames_by_cause(spark, sf_dir):
    held = versions(spark, sf_dir)
    ends = held.groupBy("trial_id").agg(cohort.arg_min(F.col("sponsor_key"), F.col("version")).alias("a"), F.max_by("sponsor_key", F.when(F.col("sponsor_key").isNotNull(), F.col("version"))).alias("b"), F.countDistinct("sponsor_key").alias("n"))
    cause = F.when(F.col("a").isNull(), "never named").when(F.col("n") == 1, "same").when(F.col("a") == F.col("b"), "back again").otherwise("renamed")
    return ends.groupBy(cause.alias("cause")).agg(F.count("*").alias("trials"))


RELEASE = date(1998, 1, 1)
FIELDS = ("status", "enrollment_count", "completion_date", "sponsor_key", "allocation")


@query(f"""{WITH}, o AS (SELECT * FROM versions WHERE effective_date <= DATE '1998-01-01' QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY version DESC) = 1),
n AS (SELECT * FROM versions WHERE effective_date <= DATE '1998-06-15' QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY effective_date DESC, version DESC) = 1),
f AS (SELECT trial_id, min(effective_date) AS began FROM versions GROUP BY 1),
j AS (SELECT coalesce(o.trial_id, n.trial_id) AS trial_id, o.trial_id AS oid, n.trial_id AS nid, o.effective_date AS od, n.effective_date AS nd, {', '.join(f'o.{c} AS o_{c}, n.{c} AS n_{c}' for c in FIELDS)} FROM o FULL JOIN n ON o.trial_id = n.trial_id),
d AS (SELECT '(row)' AS "column", CASE WHEN began > DATE '1998-01-01' THEN 'registered later' ELSE 'unexplained' END AS cause FROM j JOIN f USING (trial_id) WHERE oid IS NULL
  UNION ALL SELECT '(row)', 'unexplained' FROM j WHERE nid IS NULL
  {' '.join(f"UNION ALL SELECT '{c}', CASE WHEN nd > DATE '1998-01-01' THEN 'posted later' WHEN od < nd THEN 'numbered out of order' WHEN o_{c} IS NULL THEN 'filled in' ELSE 'unexplained' END FROM j WHERE oid IS NOT NULL AND nid IS NOT NULL AND o_{c} IS DISTINCT FROM n_{c}" for c in FIELDS)}),
t AS (SELECT "column", cause, count(*) AS n FROM d GROUP BY ALL), p AS (SELECT count(*) AS size FROM n)
SELECT "column", cause, n, n / size AS share, CASE WHEN "column" = 'status' AND cause = 'numbered out of order' THEN 0.01 WHEN cause = 'unexplained' THEN 0 ELSE 1 END AS most, n / size <= CASE WHEN "column" = 'status' AND cause = 'numbered out of order' THEN 0.01 WHEN cause = 'unexplained' THEN 0 ELSE 1 END AS accepted FROM t, p""")
def census_by_cause(spark, sf_dir):
    """The last numbered version of each trial in a release against its state half a year later, each difference with its cause."""
    held = versions(spark, sf_dir).withColumn("status", cohort.submitted_status(STUDY))
    known = ["trial_id", "effective_date", *FIELDS]
    old = latest_per(held.filter(F.col("effective_date") <= F.lit(RELEASE)), ["trial_id"], "version").select(known)
    began = F.min("effective_date").over(Window.partitionBy("trial_id"))
    day = F.col("effective_date") <= F.lit(DAY)
    last = F.row_number().over(Window.partitionBy("trial_id").orderBy(day.desc(), F.desc("effective_date"), F.desc("version")))
    new = held.withColumns({"began": began, "__n": last}).filter(day & (F.col("__n") == 1)).select(*known, "began")
    causes = lambda c: [("posted later", F.col("new.effective_date") > F.lit(RELEASE)), ("numbered out of order", F.col("old.effective_date") < F.col("new.effective_date")), ("filled in", F.col(f"old.{c}").isNull())]
    found = differences(old, new, "trial_id", {c: causes(c) for c in FIELDS}, added=[("registered later", F.col("new.began") > F.lit(RELEASE))])
    return judged(census(found), new.count(), {("status", "numbered out of order"): 0.01})


@query(f"""{WITH}, v AS (SELECT trial_id, version, effective_date, lead(effective_date) OVER (PARTITION BY trial_id ORDER BY effective_date, version) AS nxt,
  CASE WHEN effective_date <= DATE '1996-01-05' THEN DATE '1996-01-05' ELSE DATE '1996-01-05' + CAST(ceil((effective_date - DATE '1996-01-05') / 28) * 28 AS INTEGER) END AS pull FROM versions)
SELECT trial_id, version, effective_date, CASE WHEN nxt = effective_date THEN 'same day' ELSE 'between pulls' END AS cause FROM v WHERE nxt <= pull""")
def versions_hidden_from_pulls(spark, sf_dir):
    """Versions that a feed pulled every four weeks never showed."""
    return hidden_versions(versions(spark, sf_dir), "trial_id", "version", "effective_date", next_pull(F.col("effective_date"), date(1996, 1, 5), 28))


@query("""WITH l AS (SELECT l_orderkey, list({'n': l_linenumber, 'mode': 'm' || (l_suppkey % 7), 'flag': CASE WHEN l_returnflag <> 'N' THEN l_returnflag END} ORDER BY l_linenumber, l_suppkey % 7) AS ls FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_orderstatus AS status, array_to_string(list_transform(ls, lambda x: x.mode), '|') AS modes, array_to_string(list_sort(list_distinct(list_filter(list_transform(ls, lambda x: x.flag), lambda x: x IS NOT NULL))), '|') AS flags,
  coalesce(len(ls), 0) AS n_lines, len(list_distinct(list_transform(ls, lambda x: x.mode))) AS n_modes, coalesce(2 * len(list_filter(ls, lambda x: x.flag IS NOT NULL)), 0) AS n_marks FROM orders JOIN l ON l_orderkey = o_orderkey""")
def flattened_records(spark, sf_dir):
    """Orders as nested records, flattened by paths."""
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    line = F.struct(F.col("l_linenumber").alias("n"), F.struct(F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string")).alias("mode"), F.array(F.struct(flag.alias("flag")), F.struct(flag.alias("flag"))).alias("marks")).alias("how"), flag.alias("flag"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("items"))  # of one order
    o = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    records = o.select(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("status"), "items").alias("body")).alias("study"))
    flat = flattened(
        records, {"id": "study.id", "status": "study.body.status"}, {"modes": "study.body.items.how.mode"}, {"flags": "study.body.items.flag"},
        {"n_lines": "study.body.items.n", "n_marks": "study.body.items.how.marks.flag"}, {"n_modes": "study.body.items.how.mode"},
    )
    return flat.withColumns({c: F.array_join(c, "|") for c in ("modes", "flags")})


RAW = Layout(dates=("first_post_date",), precise=("start_date",), enums=("overall_status", "last_known_status", "allocation"), ages={"minimum_age": "minimum_age_years"}, interventions="interventions", aliases={"overall_status": {"SUSPENDED.": "SUSPENDED"}})
STATES = ("RECRUITING", "SUSPENDED", "UNKNOWN")


def raw_versions(spark, sf_dir):
    """Orders as raw text of versions, some of them against the contract."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    pair = lambda name, kind: F.struct(F.lit(name).cast("string").alias("name"), F.lit(kind).cast("string").alias("type"))
    return table(spark, sf_dir, "orders").select(
        c.alias("trial_id"),
        F.when(k % 101 != 0, F.when(k % 103 == 0, F.lit(-1)).otherwise(k)).alias("version"),
        F.lit("history").alias("source"),
        F.when(k % 11 != 0, day).alias("first_post_date"),
        F.when(k % 3 == 0, F.substr(day, F.lit(1), F.lit(7))).when(k % 3 == 1, F.substr(day, F.lit(1), F.lit(4))).when(k % 7 != 0, day).otherwise("soon").alias("start_date"),
        F.when(k % 2 == 0, " estimated").otherwise("Actual ").alias("start_date_type"),
        F.when(k % 5 == 0, "Unknown").when(k % 5 == 1, " suspended. ").when(k % 59 == 0, "Closed").otherwise("recruiting").alias("overall_status"),
        F.when((k % 5 == 0) | (k % 107 == 0), "Recruiting").alias("last_known_status"),
        F.when(k % 4 != 0, "Randomized").otherwise("").alias("allocation"),
        F.when(k % 6 == 0, "18 Years").when(k % 6 == 1, "6 months").when(k % 6 == 2, "N/A").alias("minimum_age"),
        F.when(k % 9 == 0, "Dr. Jane Roe").when(k % 9 == 1, "Jane Roe, MD").when(k % 9 == 2, " ").otherwise(F.concat(F.lit("Clinic No. "), (c % 40).cast("string"))).alias("lead_sponsor_name"),
        F.when(k % 2 == 0, "Industry").otherwise("other").alias("lead_sponsor_class"),
        F.when(k % 8 != 0, F.array(pair("a", "Drug"), pair("a", " drug"), pair("b", "Drug"), pair("c", "device"), pair("", "Other"), pair("d", None))).alias("interventions"),
    )


RAW_SQL = """WITH r AS (SELECT o_custkey AS trial_id, o_orderkey AS k, CASE WHEN o_orderkey % 101 <> 0 THEN CASE WHEN o_orderkey % 103 = 0 THEN -1 ELSE o_orderkey END END AS version, CAST(o_orderdate AS DATE) AS d FROM orders),
c AS (SELECT trial_id, version, 'history' AS source, CASE WHEN k % 11 <> 0 THEN d END AS first_post_date,
  CASE WHEN k % 3 = 0 THEN CAST(date_trunc('month', d) AS DATE) WHEN k % 3 = 1 THEN CAST(date_trunc('year', d) AS DATE) WHEN k % 7 <> 0 THEN d END AS start_date, CASE WHEN k % 3 = 0 THEN 'month' WHEN k % 3 = 1 THEN 'year' WHEN k % 7 <> 0 THEN 'day' END AS start_date_precision,
  CASE WHEN k % 3 < 2 OR k % 7 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'ESTIMATED' ELSE 'ACTUAL' END END AS start_date_type, CASE WHEN k % 5 = 0 THEN 'UNKNOWN' WHEN k % 5 = 1 THEN 'SUSPENDED' WHEN k % 59 = 0 THEN 'CLOSED' ELSE 'RECRUITING' END AS overall_status,
  CASE WHEN k % 5 = 0 OR k % 107 = 0 THEN 'RECRUITING' END AS last_known_status, CASE WHEN k % 4 <> 0 THEN 'RANDOMIZED' END AS allocation, CASE WHEN k % 2 = 0 THEN 'INDUSTRY' ELSE 'OTHER' END AS lead_sponsor_class,
  CASE WHEN k % 6 = 0 THEN 18.0 WHEN k % 6 = 1 THEN 0.5 END AS minimum_age_years, CASE WHEN k % 9 > 2 THEN 'Clinic No. ' || (trial_id % 40) END AS lead_sponsor_name, CASE WHEN k % 9 > 2 THEN 'clinic no ' || (trial_id % 40) END AS sponsor_key,
  k % 9 IN (0, 1) AS sponsor_is_individual, CASE WHEN k % 8 <> 0 THEN 'DEVICE|DRUG|DRUG' ELSE '' END AS intervention_types, count(*) OVER (PARTITION BY trial_id, version) AS copies FROM r),
j AS (SELECT *, list_sort(list_filter([CASE WHEN overall_status = 'CLOSED' THEN 'overall_status: allowed' END, CASE WHEN version IS NULL THEN 'row: history has a version' END, CASE WHEN copies > 1 THEN 'row: version is unique' END,
  CASE WHEN last_known_status IS NOT NULL AND overall_status <> 'UNKNOWN' THEN 'row: last known status only behind an unknown one' END], lambda x: x IS NOT NULL)) AS reasons FROM c)"""


@query(f"{RAW_SQL} SELECT * EXCLUDE (copies, reasons) FROM j WHERE len(reasons) = 0")
def canonical_versions(spark, sf_dir):
    """Raw versions in canonical form, those that keep the contract."""
    rows = canonical(raw_versions(spark, sf_dir), RAW)
    valid, _ = split_valid(rows, contract(RAW, {"overall_status": STATES}, STUDY.status.unknown))
    return valid.drop("content_hash").withColumn("intervention_types", F.array_join("intervention_types", "|"))


@query(f"{RAW_SQL} SELECT trial_id, version, array_to_string(reasons, '; ') AS reasons FROM j WHERE len(reasons) > 0")
def contract_failures(spark, sf_dir):
    """Canonical rows that break the contract, with their reasons."""
    rows = canonical(raw_versions(spark, sf_dir), RAW)
    return split_valid(rows, contract(RAW, {"overall_status": STATES}, STUDY.status.unknown))[1].select("trial_id", "version", "reasons")
