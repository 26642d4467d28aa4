"""The driver's tables seen as a registry of record versions, and the book in which queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STUDY = study()


def query(sql: str | None = None):
    """Registers a query under its function's name, with the DuckDB SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Orders as versions of their customers' records. dealt: by trial, while an order has few columns; as many parts as
    the session shuffles to, as their size then says little of what versions take."""
    o = table(spark, sf_dir, "orders")
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey") if dealt else o
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("stratum"))
    k, trial, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    status = (
        F.when((F.col("o_orderstatus") == "F") & urgent, "COMPLETED")
        .when((F.col("o_orderstatus") == "P") & urgent, "TERMINATED")
        .when((F.col("o_orderstatus") == "O") & low, "UNKNOWN")
        .when((F.col("o_orderstatus") == "P") & low, "SUSPENDED")
        .otherwise("RECRUITING")
    )
    unless = lambda n, value: F.when(k % n != 0, value)
    shift = lambda base, days: F.date_add(base, days.cast("int"))
    return o.join(customers, "o_custkey", "left").select(
        trial.alias("trial_id"),
        k.alias("version"),
        day.alias("effective_date"),
        status.alias("overall_status"),
        F.when((status == "UNKNOWN") & (k % 2 == 0), "RECRUITING").alias("last_known_status"),
        F.when(trial % 10 == 0, "OBSERVATIONAL").otherwise("INTERVENTIONAL").alias("study_type"),
        unless(11, day).alias("first_post_date"),
        unless(13, shift(day, -(k % 400))).alias("status_verified_date"),
        shift(day, k % 200 - 100).alias("start_date"),
        unless(7, shift(day, k % 700)).alias("completion_date"),
        F.when(k % 7 != 0, F.when(k % 3 == 0, "month").otherwise("day")).alias("completion_date_precision"),
        unless(5, shift(day, k % 500)).alias("primary_completion_date"),
        F.when(k % 5 != 0, F.lit("year")).alias("primary_completion_date_precision"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("enrollment_count"),
        F.when(F.col("o_orderstatus") == "F", "ACTUAL").when(k % 17 != 0, "ESTIMATED").alias("enrollment_type"),
        F.when(k % 19 != 0, F.concat(F.lit("sponsor "), (F.when(k % 23 == 0, trial + 1).otherwise(trial) % 40).cast("string"))).alias("sponsor_key"),
        "stratum",
        F.when(k % 3 == 0, "RANDOMIZED").when(k % 3 == 1, "NON_RANDOMIZED").alias("allocation"),
        F.when(k % 2 == 0, "PARALLEL").otherwise("SINGLE_GROUP").alias("intervention_model"),
        unless(9, F.lit("TREATMENT")).alias("primary_purpose"),
        F.when(k % 4 == 0, "NONE").when(k % 4 == 1, "DOUBLE").alias("masking"),
        unless(13, k % 6 == 0).alias("healthy_volunteers"),
        F.when(k % 5 == 0, "FEMALE").otherwise("ALL").alias("sex"),
        unless(14, (k % 60).cast("double")).alias("minimum_age_years"),
        unless(8, (k % 60 + k % 30).cast("double")).alias("maximum_age_years"),
        F.col("o_orderpriority").alias("organization_class"),
        F.when(k % 9 == 0, "ACTUAL").when(k % 9 < 7, "ESTIMATED").alias("primary_completion_date_type"),
        F.when(k % 6 == 0, "A Phase 1/2 study").when(k % 6 == 1, "PHASE III, randomized").when(k % 6 == 2, "phase IIb and Phase 3").when(k % 6 == 3, "Biphasic insulin").when(k % 6 == 4, "Phase 1 or 3").alias("official_title"),
        F.when(k % 4 == 0, "Post-marketing phase-IV").when(k % 4 == 1, "A trial in phases").when(k % 4 == 2, "Early Phase 0").alias("brief_title"),
        unless(10, F.concat(F.lit("Inclusion Criteria:\nage at least "), (k % 90).cast("string"), F.lit("\n\ndose >= 2"), F.when(k % 3 == 0, "").otherwise("\n Key EXCLUSION criteria\nunder 5 years\nsee exclusion criteria"))).alias("criteria"),
        F.when(k % 4 != 0, F.array(F.when(k % 2 == 0, F.lit("DRUG")).otherwise(F.lit("DEVICE")), F.lit("OTHER"), F.lit("OTHER"))).alias("intervention_types"),
    )


VERSIONS_SQL = """
versions AS (
  SELECT o_custkey AS trial_id, o_orderkey AS version, CAST(o_orderdate AS DATE) AS effective_date, s.status AS overall_status,
    CASE WHEN s.status = 'UNKNOWN' AND o_orderkey % 2 = 0 THEN 'RECRUITING' END AS last_known_status,
    CASE WHEN o_custkey % 10 = 0 THEN 'OBSERVATIONAL' ELSE 'INTERVENTIONAL' END AS study_type,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS first_post_date,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 400 AS INTEGER) END AS status_verified_date,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 - 100 AS INTEGER) AS start_date,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 700 AS INTEGER) END AS completion_date,
    CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'month' ELSE 'day' END END AS completion_date_precision,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 500 AS INTEGER) END AS primary_completion_date,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'year' END AS primary_completion_date_precision,
    CAST(floor(o_totalprice / 1000) AS INTEGER) AS enrollment_count,
    CASE WHEN o_orderstatus = 'F' THEN 'ACTUAL' WHEN o_orderkey % 17 <> 0 THEN 'ESTIMATED' END AS enrollment_type,
    CASE WHEN o_orderkey % 19 <> 0 THEN 'sponsor ' || ((CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 1 ELSE o_custkey END) % 40) END AS sponsor_key,
    c_mktsegment AS stratum, CASE o_orderkey % 3 WHEN 0 THEN 'RANDOMIZED' WHEN 1 THEN 'NON_RANDOMIZED' END AS allocation, CASE o_orderkey % 2 WHEN 0 THEN 'PARALLEL' ELSE 'SINGLE_GROUP' END AS intervention_model,
    CASE WHEN o_orderkey % 9 <> 0 THEN 'TREATMENT' END AS primary_purpose, CASE o_orderkey % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'DOUBLE' END AS masking, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 6 = 0 END AS healthy_volunteers,
    CASE o_orderkey % 5 WHEN 0 THEN 'FEMALE' ELSE 'ALL' END AS sex, CASE WHEN o_orderkey % 14 <> 0 THEN CAST(o_orderkey % 60 AS DOUBLE) END AS minimum_age_years, CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderkey % 60 + o_orderkey % 30 AS DOUBLE) END AS maximum_age_years,
    o_orderpriority AS organization_class, CASE WHEN o_orderkey % 9 = 0 THEN 'ACTUAL' WHEN o_orderkey % 9 < 7 THEN 'ESTIMATED' END AS primary_completion_date_type,
    CASE WHEN o_orderkey % 6 = 0 THEN 'PHASE1_PHASE2' WHEN o_orderkey % 6 = 1 THEN 'PHASE3' WHEN o_orderkey % 6 = 2 THEN 'PHASE2_PHASE3' WHEN o_orderkey % 6 = 4 THEN 'OTHER' WHEN o_orderkey % 4 = 0 THEN 'PHASE4' WHEN o_orderkey % 4 = 2 THEN 'EARLY_PHASE1' ELSE 'NONE' END AS title_phase,
    CASE WHEN o_orderkey % 10 <> 0 THEN 'Inclusion Criteria:' || chr(10) || 'age at least ' || (o_orderkey % 90) || chr(10) || chr(10) || 'dose >= 2' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE chr(10) || ' Key EXCLUSION criteria' || chr(10) || 'under 5 years' || chr(10) || 'see exclusion criteria' END END AS criteria,
    CASE WHEN o_orderkey % 4 <> 0 THEN [CASE o_orderkey % 2 WHEN 0 THEN 'DRUG' ELSE 'DEVICE' END, 'OTHER', 'OTHER'] END AS intervention_types,
    CASE WHEN s.status = 'UNKNOWN' AND o_orderkey % 2 = 0 THEN 'RECRUITING' ELSE s.status END AS status
  FROM (SELECT *, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'COMPLETED' WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'TERMINATED'
      WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'UNKNOWN' WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'SUSPENDED' ELSE 'RECRUITING' END AS status FROM orders) s
  LEFT JOIN customer ON o_custkey = c_custkey)"""


def cohort_sql(cutoff: str = "2001-08-01", before: str | None = None, prefix: str = "") -> str:
    """CTEs (prefixed) states, outcomes and landmarks of the rules, for oracles."""
    p, strict = prefix, f"AND effective_date < DATE '{before}'" if before else ""
    return f"""
{p}known AS (SELECT * FROM versions WHERE effective_date <= DATE '{cutoff}' {strict}),
{p}daily AS (SELECT *, lead(effective_date) OVER (PARTITION BY trial_id ORDER BY effective_date) AS next_effective FROM
  (SELECT * FROM {p}known QUALIFY row_number() OVER (PARTITION BY trial_id, effective_date ORDER BY version DESC) = 1)),
{p}refs AS (SELECT *, coalesce(CASE completion_date_precision WHEN 'month' THEN last_day(completion_date) ELSE completion_date END,
    make_date(CAST(year(primary_completion_date) AS INTEGER), 12, 31)) + 1 AS done,
  last_day(CAST(coalesce(status_verified_date, effective_date) + INTERVAL 24 MONTH AS DATE)) + 1 AS silent FROM {p}daily),
{p}states AS (SELECT *, CASE WHEN status = 'UNKNOWN' THEN effective_date
    WHEN status IN ('NOT_YET_RECRUITING','RECRUITING','ENROLLING_BY_INVITATION','ACTIVE_NOT_RECRUITING') THEN greatest(effective_date, coalesce(done, effective_date), silent) END AS lapse_from FROM {p}refs),
{p}per AS (SELECT trial_id, arg_min(first_post_date, version) AS t0, min(version) FILTER (WHERE status IN ('TERMINATED','WITHDRAWN','COMPLETED')) AS end_version,
    max(version) FILTER (WHERE status IN ('RECRUITING','SUSPENDED','UNKNOWN')) AS last_open, bool_or(study_type = 'INTERVENTIONAL') AS in_population, arg_max(overall_status, version) = 'UNKNOWN' AS registry_unknown FROM {p}known GROUP BY trial_id),
{p}ended AS (SELECT p.*, k.status AS end_status, k.effective_date AS end_date, s.lapse_from, coalesce(s.status_verified_date, s.effective_date) AS quiet,
    coalesce(p.end_version IS NULL AND s.lapse_from <= DATE '{cutoff}', false) AS lapsed
  FROM {p}per p LEFT JOIN {p}known k ON p.end_version = k.version JOIN {p}states s ON p.trial_id = s.trial_id AND s.next_effective IS NULL),
{p}outcomes AS (SELECT trial_id, t0, t0 >= DATE '1995-01-01' AS in_window, in_population,
    CASE WHEN end_status IN ('TERMINATED','WITHDRAWN') THEN 1 WHEN end_version IS NOT NULL THEN 2 ELSE 0 END AS event,
    CASE WHEN end_version IS NOT NULL THEN end_date WHEN lapsed THEN least(quiet, DATE '{cutoff}') ELSE DATE '{cutoff}' END AS event_date,
    CASE WHEN end_version IS NULL THEN CASE WHEN lapsed THEN 'unknown' ELSE 'cutoff' END END AS censor_reason,
    coalesce(last_open > end_version, false) AS reversal, CASE WHEN lapsed THEN lapse_from END AS lapse_date, CAST(year(t0) AS INTEGER) AS first_post_year, end_status AS terminal_status, end_date AS terminal_date, registry_unknown FROM {p}ended),
{p}grid AS (SELECT trial_id, t0, event, event_date, CAST(k AS INTEGER) AS landmark_index, CAST(t0 + to_months(CAST(6 * k AS INTEGER)) AS DATE) AS landmark_date
  FROM {p}outcomes, range(7) r(k) WHERE in_window AND in_population AND NOT reversal AND t0 IS NOT NULL),
{p}landmarks AS (SELECT g.trial_id, landmark_index, landmark_date, event, event_date, coalesce(stratum, 'MISSING') AS stratum,
    CASE WHEN event_date <= landmark_date THEN 'ended' WHEN s.effective_date IS NULL THEN 'no_state' WHEN study_type IS DISTINCT FROM 'INTERVENTIONAL' THEN 'not_interventional'
      WHEN status NOT IN ('RECRUITING','SUSPENDED') THEN 'not_open' WHEN lapse_from <= landmark_date THEN 'lapsed' END AS excluded
  FROM (SELECT * FROM {p}grid WHERE landmark_date <= DATE '{cutoff}') g ASOF LEFT JOIN {p}states s ON g.trial_id = s.trial_id AND g.landmark_date >= s.effective_date)"""
