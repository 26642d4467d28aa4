"""Queries of survival curves and evaluation metrics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.numbers import cif_from_hazards, logit, signed_log, wilson
from ..operators import cohort, survival
from ..operators.ranks import sum_before
from ..operators.recalibration import paired_difference
from ..operators.sponsors import class_priors, shrunk_rates
from ..operators.walkforward import run
from ..session import stored
from .registry import STUDY, VERSIONS_SQL, cohort_sql, query, table, versions

FULL = f"WITH {VERSIONS_SQL}, {cohort_sql()}"
ROWS = f"""{FULL}, r0 AS (SELECT trial_id, landmark_index, stratum, event, datediff('day', landmark_date, event_date) AS "time", ((trial_id * 37 + landmark_index * 11) % 100) / 100.0 AS score FROM landmarks WHERE excluded IS NULL)"""
HORIZON = 365


def evaluation_rows(spark, sf_dir):
    rows = cohort.landmarks(versions(spark, sf_dir), STUDY).filter("excluded is null")
    score = ((F.col("trial_id") * 37 + F.col("landmark_index") * 11) % 100) / 100.0
    return rows.select("trial_id", "landmark_index", "stratum", "event", F.datediff("event_date", "landmark_date").alias("time"), score.alias("score"))


RISK = ', n AS (SELECT stratum, "time" AS t, count(*) AS n, count(*) FILTER (WHERE event = 0) AS d0, count(*) FILTER (WHERE event = 1) AS d1, count(*) FILTER (WHERE event = 2) AS d2 FROM r0 GROUP BY ALL), risk AS (SELECT *, sum(n) OVER (PARTITION BY stratum ORDER BY t DESC) AS n_risk FROM n)'


@query(f"{ROWS}{RISK} SELECT stratum, t, product(1 - (d1 + d2) / n_risk) OVER (PARTITION BY stratum ORDER BY t) AS survival FROM risk")
def kaplan_meier_curve(spark, sf_dir):
    return survival.kaplan_meier(evaluation_rows(spark, sf_dir), ["stratum"], "time", "event")


@query(f"{ROWS}{RISK} SELECT stratum, t, product(1 - CASE WHEN n_risk - d1 - d2 > 0 THEN d0 / (n_risk - d1 - d2) ELSE 0 END) OVER (PARTITION BY stratum ORDER BY t) AS g FROM risk")
def censoring_curve(spark, sf_dir):
    return survival.censoring_survival(evaluation_rows(spark, sf_dir), ["stratum"], "time", "event")


@query(f"""{ROWS}{RISK}, s AS (SELECT *, product(1 - (d1 + d2) / n_risk) OVER (PARTITION BY stratum ORDER BY t) AS s FROM risk), b AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY stratum ORDER BY t), 1) AS before FROM s)
SELECT stratum, t, sum(before * d1 / n_risk) OVER (PARTITION BY stratum ORDER BY t) AS cif FROM b""")
def aalen_johansen_cif(spark, sf_dir):
    return survival.aalen_johansen(evaluation_rows(spark, sf_dir), ["stratum"], "time", "event")


WEIGHTS = f"""{ROWS}, r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY stratum) >= 350 THEN stratum ELSE 'POOLED' END AS censoring_group FROM r0),
cn AS (SELECT censoring_group AS cg, "time" AS t, count(*) AS n, count(*) FILTER (WHERE event = 0) AS d0, count(*) FILTER (WHERE event > 0) AS de FROM r GROUP BY ALL),
cr AS (SELECT *, sum(n) OVER (PARTITION BY cg ORDER BY t DESC) - de AS risk FROM cn), cg AS (SELECT cg, t, product(1 - CASE WHEN risk > 0 THEN d0 / risk ELSE 0 END) OVER (PARTITION BY cg ORDER BY t) AS g FROM cr),
w AS (SELECT r.*, 1 / coalesce(g, 1) AS weight FROM (SELECT * FROM r WHERE "time" <= {HORIZON} AND event > 0) r ASOF LEFT JOIN cg ON censoring_group = cg AND "time" > t
  UNION ALL SELECT x.* EXCLUDE (h), CASE WHEN x."time" <= {HORIZON} THEN 0 ELSE 1 / coalesce(g, 1) END FROM (SELECT *, {HORIZON} AS h FROM r WHERE NOT ("time" <= {HORIZON} AND event > 0)) x ASOF LEFT JOIN cg ON x.censoring_group = cg AND h >= t),
wl AS (SELECT *, CASE WHEN "time" <= {HORIZON} AND event = 1 THEN 1 ELSE 0 END AS label FROM w)"""


def weighted_rows(spark, sf_dir):
    rows = survival.censoring_group(evaluation_rows(spark, sf_dir), "stratum", 350)
    return survival.ipcw(rows, "censoring_group", "time", "event", HORIZON)


@query(f"{WEIGHTS} SELECT trial_id, landmark_index, censoring_group, label, weight FROM wl")
def ipcw_weights(spark, sf_dir):
    return weighted_rows(spark, sf_dir).select("trial_id", "landmark_index", "censoring_group", "label", "weight")


@query(f"""{WEIGHTS}, g AS (SELECT landmark_index, score, sum(weight * label) AS p, sum(weight * (1 - label)) AS n FROM wl GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY landmark_index ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT landmark_index, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM b GROUP BY ALL""")
def weighted_auc_by_index(spark, sf_dir):
    return survival.weighted_auc(weighted_rows(spark, sf_dir), ["landmark_index"], "score", "label", "weight")


@query(f"{WEIGHTS} SELECT landmark_index, sum(weight * (label - score) * (label - score)) / count(*) AS brier FROM wl GROUP BY ALL")
def ipcw_brier(spark, sf_dir):
    return survival.weighted_brier(weighted_rows(spark, sf_dir), ["landmark_index"], "score", "label", "weight")


@query(f"""{WEIGHTS}, t AS (SELECT *, row_number() OVER (PARTITION BY landmark_index ORDER BY score DESC, trial_id) AS k, count(*) OVER (PARTITION BY landmark_index) AS n FROM wl)
SELECT landmark_index, (sum(weight * label) FILTER (WHERE k <= greatest(1, ceil(n * 0.1))) / sum(weight) FILTER (WHERE k <= greatest(1, ceil(n * 0.1)))) / (sum(weight * label) / sum(weight)) AS lift FROM t GROUP BY ALL""")
def lift_at_tenth(spark, sf_dir):
    return survival.lift(weighted_rows(spark, sf_dir), ["landmark_index"], "score", "label", "weight", ["trial_id"])


@query(f"""{WEIGHTS}, t AS (SELECT *, ntile(10) OVER (ORDER BY score, trial_id, landmark_index) AS bin FROM wl) SELECT bin, count(*) AS n, avg(score) AS predicted, sum(weight * label) / sum(weight) AS observed FROM t GROUP BY ALL""")
def calibration_deciles(spark, sf_dir):
    binned = survival.equal_bins(weighted_rows(spark, sf_dir), [], "score", ["trial_id", "landmark_index"], 10)
    return survival.calibration(binned, ["bin"], "score", "label", "weight")


@query()
def calibration_slope_intercept(spark, sf_dir):
    """Two fitted numbers; tested against a numpy fit."""
    intercept, slope = survival.calibration_slope(weighted_rows(spark, sf_dir), "score", "label", "weight")
    return spark.createDataFrame([(intercept, slope)], "intercept double, slope double")


@query()
def bootstrap_auc_interval(spark, sf_dir):
    """A resampling interval; tested for coverage of the point value."""
    return survival.interval(survival.bootstrap_auc(weighted_rows(spark, sf_dir), "score", "label", "weight", "trial_id"), [], "auc")


@query()
def paired_auc_difference(spark, sf_dir):
    """Two scores on the same draws; tested for its sign and for equal scores."""
    rows = weighted_rows(spark, sf_dir).withColumn("other", F.pmod(F.xxhash64("trial_id"), F.lit(100)) / 100)
    return paired_difference(rows, "score", "other", "label", "weight", "trial_id")


ORIGINS, MONTHS, GROUPED = (date(1998, 1, 1), date(1999, 1, 1)), (12, 24), 75
PRIORS = ", ".join(
    f"""f{i} AS (SELECT trial_id, arg_min(event, landmark_index) AS event, arg_min(stratum, landmark_index) AS stratum FROM o{i}_landmarks WHERE excluded IS NULL AND landmark_date < DATE '{day}' GROUP BY 1),
s{i} AS (SELECT stratum, count(*) FILTER (WHERE event <> 0) AS e, count(*) FILTER (WHERE event = 1) AS s FROM f{i} GROUP BY 1), t{i} AS (SELECT CASE WHEN sum(e) > 0 THEN CAST(sum(s) AS DOUBLE) / sum(e) ELSE 0 END AS overall FROM s{i}),
p{i} AS (SELECT DATE '{day}' AS origin, stratum, (s + 10 * overall) / (e + 10) AS prior FROM s{i}, t{i})"""
    for i, day in enumerate(ORIGINS)
)


def sql_weights(name: str, curve: str, of: str) -> str:
    """A CTE `name` of the rows of `laid` with their weights by curves of rows that share the columns `of`."""
    cols = [c.strip() for c in of.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols)
    return f"""{curve}n AS (SELECT {of}, "time" AS t, count(*) FILTER (WHERE months = 12) AS n, count(*) FILTER (WHERE months = 12 AND event = 0) AS d0, count(*) FILTER (WHERE months = 12 AND event > 0) AS de FROM laid GROUP BY ALL),
{curve}r AS (SELECT *, sum(n) OVER (PARTITION BY {of} ORDER BY t DESC) - de AS risk FROM {curve}n), {curve} AS (SELECT {of}, t, product(1 - CASE WHEN risk > 0 THEN d0 / risk ELSE 0 END) OVER (PARTITION BY {of} ORDER BY t) AS g FROM {curve}r),
{name} AS (SELECT x.*, 1 / coalesce(g, 1) AS weight FROM (SELECT * FROM laid WHERE "time" <= horizon AND event > 0) x ASOF LEFT JOIN {curve} c ON {on('x', 'c')} AND x."time" > c.t
  UNION ALL SELECT x.*, CASE WHEN x."time" <= horizon THEN 0 ELSE 1 / coalesce(g, 1) END FROM (SELECT * FROM laid WHERE NOT ("time" <= horizon AND event > 0)) x ASOF LEFT JOIN {curve} c ON {on('x', 'c')} AND x.horizon >= c.t)"""


def sql_metrics(name: str, rows: str) -> str:
    return f"""{name}s AS (SELECT *, CASE WHEN "time" <= horizon AND event = 1 THEN 1 ELSE 0 END AS label FROM {rows}),
{name}g AS (SELECT origin, months, slice, score, sum(weight * label) AS p, sum(weight * (1 - label)) AS n FROM {name}s GROUP BY ALL),
{name}b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY origin, months, slice ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}g),
{name}a AS (SELECT origin, months, slice, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM {name}b GROUP BY ALL),
{name}k AS (SELECT *, row_number() OVER (PARTITION BY origin, months, slice ORDER BY score DESC, trial_id, landmark_index) AS k, count(*) OVER (PARTITION BY origin, months, slice) AS n FROM {name}s),
{name} AS (SELECT origin, months, slice, count(*) AS n_rows, count(DISTINCT trial_id) AS n_trials, any_value(auc) AS auc, sum(weight * (label - score) * (label - score)) / count(*) AS brier,
  (sum(weight * label) FILTER (WHERE k <= greatest(1, ceil(n * 0.1))) / nullif(sum(weight) FILTER (WHERE k <= greatest(1, ceil(n * 0.1))), 0)) / nullif(sum(weight * label) / nullif(sum(weight), 0), 0) AS lift FROM {name}k JOIN {name}a USING (origin, months, slice) GROUP BY ALL)"""


@query(f"""{FULL}, {', '.join(cohort_sql(str(day), str(day), f'o{i}_') for i, day in enumerate(ORIGINS))}, {PRIORS},
ev AS (SELECT l.*, o.origin, datediff('day', landmark_date, event_date) AS "time", count(*) OVER (PARTITION BY o.origin, stratum) AS size FROM (SELECT * FROM landmarks WHERE excluded IS NULL) l
  JOIN (SELECT DATE '{ORIGINS[0]}' AS origin UNION ALL SELECT DATE '{ORIGINS[1]}') o ON landmark_date >= origin AND landmark_date < origin + INTERVAL 12 MONTH),
sc AS (SELECT ev.*, CASE WHEN size >= {GROUPED} THEN ev.stratum ELSE 'POOLED' END AS cg, coalesce(prior, CASE WHEN ev.origin = DATE '{ORIGINS[0]}' THEN (SELECT overall FROM t0) ELSE (SELECT overall FROM t1) END) AS prior FROM ev LEFT JOIN (SELECT * FROM p0 UNION ALL SELECT * FROM p1) p ON ev.origin = p.origin AND ev.stratum = p.stratum),
laid AS (SELECT origin, trial_id, landmark_index, event, "time", cg, months, prior * months / 24 * (1 + landmark_index / 10) AS score, datediff('day', landmark_date, CAST(landmark_date + to_months(months) AS DATE)) AS horizon, slice
  FROM sc, (SELECT CAST(unnest([12, 24]) AS INTEGER) AS months), LATERAL (SELECT CAST(unnest([-1, landmark_index]) AS INTEGER) AS slice)),
{sql_weights('w', 'c', 'origin, slice, cg')}, {sql_weights('w1', 'c1', 'origin, slice')}, {sql_metrics('m', 'w')}, {sql_metrics('o', 'w1')}
SELECT origin, months, CASE WHEN slice >= 0 THEN slice END AS slice, m.n_rows, m.n_trials, m.auc, m.brier, m.lift, o.auc AS single_auc, o.brier AS single_brier, o.lift AS single_lift FROM m JOIN o USING (origin, months, slice)""")
def walk_forward(spark, sf_dir):
    """What early-stop rates of classes, as known at two origins, are worth in the year after: two horizons, pooled and by index."""
    held = stored(versions(spark, sf_dir))

    def fit(origin):
        known = cohort.landmarks(held, STUDY, before=origin).filter("excluded is null").filter(F.col("landmark_date") < F.lit(origin))
        priors = stored(class_priors(known, origin))

        def predict(rows):
            rated = shrunk_rates(rows.withColumns({"sponsor_prior_ended": F.lit(0), "sponsor_prior_stopped": F.lit(0)}), priors)
            risk = F.col("rate") * (1 + F.col("landmark_index") / 10)
            return rated.withColumns({f"score_{m}": risk * m / 24 for m in MONTHS}).drop("rate", "sponsor_prior_ended", "sponsor_prior_stopped")

        return predict

    rows = cohort.landmarks(held, STUDY).filter("excluded is null").drop("excluded")
    return run(rows, ORIGINS, MONTHS, fit, least=GROUPED)


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE a = b) AS same FROM c), e AS (SELECT sum(r.r * k.k) AS rc FROM (SELECT a, sum(n) AS r FROM c GROUP BY a) r JOIN (SELECT b, sum(n) AS k FROM c GROUP BY b) k ON a = b)
SELECT CAST(n AS BIGINT) AS n, same / n AS accuracy, (same / n - rc / (n * n)) / (1 - rc / (n * n)) AS kappa FROM t, e""")
def label_agreement(spark, sf_dir):
    return survival.agreement(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("""WITH s AS (SELECT quality AS label, 1 AS t, 0 AS g, 0 AS b FROM labels UNION ALL SELECT toxic, 0, 1, CASE WHEN quality = toxic THEN 1 ELSE 0 END FROM labels)
SELECT label, sum(b) / nullif(sum(g), 0) AS "precision", sum(b) / nullif(sum(t), 0) AS recall, 2 * sum(b) / (sum(t) + sum(g)) AS f1 FROM s GROUP BY label""")
def label_precision_recall(spark, sf_dir):
    return survival.label_scores(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("""SELECT o_orderkey, 0.1 + 0.8 * (0.05 * (o_orderkey % 3)) AS cif_2, 0.1 AS cif_1 FROM orders""")
def cif_from_interval_hazards(spark, sf_dir):
    second = F.struct((F.col("o_orderkey") % 3 * 0.05).alias("stop"), F.lit(0.2).alias("complete"))
    cif = cif_from_hazards(F.array(F.struct(F.lit(0.1).alias("stop"), F.lit(0.1).alias("complete")), second))
    return table(spark, sf_dir, "orders").select("o_orderkey", cif.alias("cif")).select("o_orderkey", F.col("cif")[0].alias("cif_1"), F.col("cif")[1].alias("cif_2"))


@query("""WITH k AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS k FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, k, (k / n + 3.8414588206941236 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.8414588206941236 / (4.0 * n * n))) / (1 + 3.8414588206941236 / n) AS low,
  (k / n + 3.8414588206941236 / (2 * n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.8414588206941236 / (4.0 * n * n))) / (1 + 3.8414588206941236 / n) AS high FROM k""")
def wilson_intervals(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return counts.select("l_returnflag", "n", "k", low.alias("low"), high.alias("high"))


@query("""SELECT c_custkey, sign(c_acctbal) * ln(1 + abs(c_acctbal)) AS signed_log, ln((0.01 + c_custkey % 90 / 100) / (0.99 - c_custkey % 90 / 100)) AS log_odds FROM customer""")
def number_transforms(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", signed_log(F.col("c_acctbal")).alias("signed_log"), logit(0.01 + F.col("c_custkey") % 90 / 100).alias("log_odds"))


@query("SELECT s_nationkey, regr_slope(s_acctbal, s_suppkey) AS slope FROM supplier GROUP BY s_nationkey HAVING count(*) > 2")
def least_squares_slope(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.regr_slope("s_acctbal", "s_suppkey").alias("slope")).filter("n > 2").drop("n")


@query("""WITH r AS (SELECT p_partkey, avg(a) OVER (PARTITION BY p_size) AS x, avg(b) OVER (PARTITION BY p_retailprice) AS y FROM (SELECT *, row_number() OVER (ORDER BY p_size, p_partkey) AS a, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS b FROM part))
SELECT corr(x, y) AS rho FROM r""")
def rank_correlation(spark, sf_dir):
    """Spearman's rho: the mean rank of each distinct value, by running counts over ranges of values."""
    parts = table(spark, sf_dir, "part")

    def ranks(column, name):
        counts = sum_before(parts.groupBy(column).agg(F.count("*").alias("n")), [], [column], F.col("n"), "before")
        return counts.select(column, (F.col("before") + (F.col("n") + 1) / 2).alias(name))

    both = parts.join(ranks("p_size", "x"), "p_size").join(ranks("p_retailprice", "y"), "p_retailprice")
    return both.agg(F.corr("x", "y").alias("rho"))
