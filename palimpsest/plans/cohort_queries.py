"""Queries over version logs: states, cohorts, features, competition."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.text import EXCLUSIONS, HEADING, THRESHOLD, criteria_statistics, resolved_phase
from ..operators import cohort, features, sponsors
from ..operators.asof import asof_join
from ..operators.versions import changes, latest_per, open_counts, out_of_order, repeats, running_history
from .registry import STUDY, VERSIONS_SQL, cohort_sql, query, table, versions
from .sponsor_queries import COUNTS, READ, identity, records_of, trial_log

ORIGIN = date(2000, 1, 1)
WITH = f"WITH {VERSIONS_SQL}"
FULL = f"{WITH}, {cohort_sql()}"


def event_states(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.to_date("ts").alias("day"), "event_type", "value")
    return latest_per(events, ["user_id", "day"], "event_id")


@query("""
WITH st AS (SELECT user_id, event_id, CAST(ts AS DATE) AS day, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) = 1),
k AS (SELECT user_id, CAST(i AS INTEGER) AS landmark_index, min(day) + CAST(7 * i AS INTEGER) AS landmark_date FROM st, range(4) r(i) GROUP BY user_id, i)
SELECT landmark_index, event_type, count(*) AS n FROM k ASOF LEFT JOIN st ON k.user_id = st.user_id AND k.landmark_date >= st.day GROUP BY ALL""")
def state_at_landmark(spark, sf_dir):
    """Counts of users by their state 0 to 3 weeks after their first event."""
    held = event_states(spark, sf_dir)
    grid = held.groupBy("user_id").agg(F.min("day").alias("first")).select("user_id", "first", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("landmark_index"))
    keys = grid.select("user_id", "landmark_index", F.date_add("first", F.col("landmark_index") * 7).alias("landmark_date"))
    met = asof_join(keys, held.select("user_id", "day", "event_type"), ["user_id"], "landmark_date", "day")
    return met.groupBy("landmark_index", "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) = 1")
def dedupe_latest_per_day(spark, sf_dir):
    return event_states(spark, sf_dir)


@query(f"""{WITH} SELECT trial_id, version, row_number() OVER w AS n_versions, first_value(first_post_date) OVER w AS first_first_post_date, first_value(enrollment_count) OVER w AS first_enrollment_count,
  bool_or(status = 'SUSPENDED') OVER w AS ever_suspended FROM versions WINDOW w AS (PARTITION BY trial_id ORDER BY effective_date, version ROWS UNBOUNDED PRECEDING)""")
def running_history_query(spark, sf_dir):
    held = versions(spark, sf_dir).withColumn("status", cohort.submitted_status(STUDY))
    ran = running_history(held, "trial_id", ["effective_date", "version"], ["first_post_date", "enrollment_count"], {"ever_suspended": F.col("status") == "SUSPENDED"})
    return ran.select("trial_id", "version", "n_versions", "first_first_post_date", "first_enrollment_count", "ever_suspended")


@query(f"{FULL} SELECT trial_id, effective_date, next_effective, status, lapse_from FROM states")
def states_with_validity(spark, sf_dir):
    return cohort.states(versions(spark, sf_dir), STUDY).select("trial_id", "effective_date", "next_effective", "status", "lapse_from")


@query(f"{FULL} SELECT * FROM outcomes")
def outcomes_first_terminal(spark, sf_dir):
    return cohort.outcomes(versions(spark, sf_dir), STUDY)


@query(f"{FULL} SELECT * FROM landmarks")
def landmark_rows(spark, sf_dir):
    return cohort.landmarks(versions(spark, sf_dir), STUDY)


@query(f"{FULL} SELECT landmark_index, coalesce(excluded, 'kept') AS fate, count(*) AS n, count(DISTINCT trial_id) AS trials FROM landmarks GROUP BY ALL")
def cohort_funnel(spark, sf_dir):
    rows = cohort.landmarks(versions(spark, sf_dir), STUDY)
    return rows.groupBy("landmark_index", F.coalesce("excluded", F.lit("kept")).alias("fate")).agg(F.count("*").alias("n"), F.countDistinct("trial_id").alias("trials"))


PERIODS = """, periods AS (SELECT *, CASE WHEN event_date <= interval_end THEN event ELSE 0 END AS outcome FROM (
  SELECT trial_id, landmark_index, landmark_date, event, event_date, stratum, CAST(j AS INTEGER) AS "interval", CAST(landmark_date + to_months(CAST(6 * (j - 1) AS INTEGER)) AS DATE) AS interval_start,
    CAST(landmark_date + to_months(CAST(6 * j AS INTEGER)) AS DATE) AS interval_end FROM landmarks, range(1, 5) r(j) WHERE excluded IS NULL)
  WHERE interval_end <= DATE '2001-08-01' AND CASE WHEN event > 0 THEN event_date > interval_start ELSE event_date >= interval_end END)"""


@query(f'{FULL}{PERIODS} SELECT trial_id, landmark_index, "interval", interval_start, interval_end, outcome, stratum FROM periods')
def person_period_expand(spark, sf_dir):
    rows = cohort.landmarks(versions(spark, sf_dir), STUDY).filter("excluded is null")
    return cohort.person_periods(rows, STUDY).select("trial_id", "landmark_index", "interval", "interval_start", "interval_end", "outcome", "stratum")


BOTH = f"{FULL}, {cohort_sql('2000-01-01', '2000-01-01', 'a_')}"


@query(f"{BOTH} SELECT trial_id, event, event_date, censor_reason, reversal FROM a_outcomes")
def outcomes_as_of_origin(spark, sf_dir):
    return cohort.outcomes(versions(spark, sf_dir), STUDY, before=ORIGIN).select("trial_id", "event", "event_date", "censor_reason", "reversal")


@query(f"""{BOTH}, f AS (SELECT trial_id, CASE WHEN event_date >= DATE '2000-01-01' THEN 0 ELSE event END AS final_event, least(event_date, DATE '2000-01-01') AS final_date FROM outcomes),
k AS (SELECT trial_id, event AS known_event, event_date AS known_date FROM a_outcomes)
SELECT CASE WHEN known_event IS NULL THEN 'only_final' WHEN final_event IS NULL THEN 'only_as_of' WHEN known_event <> final_event THEN 'event_differs' WHEN known_date <> final_date THEN 'date_differs' ELSE 'same' END AS category,
  count(*) AS n FROM k FULL JOIN f USING (trial_id) GROUP BY ALL""")
def as_of_origin_labels_diff(spark, sf_dir):
    held = versions(spark, sf_dir)
    return cohort.label_changes(cohort.outcomes(held, STUDY, before=ORIGIN), cohort.outcomes(held, STUDY), ORIGIN).groupBy("category").agg(F.count("*").alias("n"))


@query(f"""{WITH}, d AS (SELECT opened AS day, 1 AS change FROM (SELECT trial_id, min(effective_date) AS opened, max(effective_date) AS closed FROM versions GROUP BY trial_id)
  UNION ALL SELECT closed, -1 FROM (SELECT trial_id, max(effective_date) AS closed FROM versions GROUP BY trial_id))
SELECT day, CAST(sum(sum(change)) OVER (ORDER BY day) AS BIGINT) AS n_open FROM d GROUP BY day""")
def open_count_sweep(spark, sf_dir):
    spans = versions(spark, sf_dir).groupBy("trial_id").agg(F.min("effective_date").alias("opened"), F.max("effective_date").alias("closed"))
    return open_counts(spans, "opened", "closed")


def feature_rows(spark, sf_dir):
    """All inputs of the features at the kept landmark rows, with event and event_date: state and history, title and text,
    and what the other tables say that day. States are found in a log of few columns; the other columns are read for the
    trials that have rows, and dealt by trial while they are few."""
    held = versions(spark, sf_dir, dealt=True)
    log = trial_log(held.select(*READ))
    kept = cohort.kept_rows(log, "effective_date")
    states = features.history(held.join(kept.select("trial_id").hint("shuffle_hash"), "trial_id", "left_semi"), STUDY)  # the other trials have no row
    stats = {f"eligibility_{name}": c for name, c in criteria_statistics(F.col("criteria")).items()}
    met = states.drop("version").join(kept.hint("shuffle_hash"), ["trial_id", "effective_date"])
    met = met.withColumns({"title_phase": resolved_phase(F.col("official_title"), F.col("brief_title")), **stats}).drop("criteria", "official_title", "brief_title")
    rows = features.competition(met, log.filter("opened is not null").select("opened", "closed")).withColumnRenamed("open_trials", "open_interventional_trials")
    return sponsors.with_record(rows, records_of(log), identity())


FEATURES = """, hist AS (SELECT *, row_number() OVER w AS n_versions, first_value(first_post_date) OVER w AS f_post, first_value(start_date) OVER w AS f_start, first_value(completion_date) OVER w AS f_comp, first_value(primary_completion_date) OVER w AS f_prim,
    first_value(enrollment_count) OVER w AS f_count, first_value(enrollment_type) OVER w AS f_type, coalesce(bool_or(status = 'SUSPENDED') OVER w, false) AS ever_suspended
  FROM versions WINDOW w AS (PARTITION BY trial_id ORDER BY effective_date, version ROWS UNBOUNDED PRECEDING)),
hst AS (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY trial_id, effective_date ORDER BY version DESC) = 1),
keys AS (SELECT l.trial_id, landmark_index, landmark_date, CAST(CASE WHEN 6 * landmark_index - 6 >= 0 AND t0 IS NOT NULL THEN t0 + to_months(CAST(6 * landmark_index - 6 AS INTEGER)) ELSE landmark_date - INTERVAL 6 MONTH END AS DATE) AS window_start
  FROM landmarks l JOIN outcomes USING (trial_id) WHERE excluded IS NULL),
bef AS (SELECT k.trial_id, k.landmark_index, h.n_versions AS then_n FROM keys k ASOF LEFT JOIN hst h ON k.trial_id = h.trial_id AND k.window_start >= h.effective_date),
cur AS (SELECT k.landmark_index, k.landmark_date, h.* FROM keys k ASOF LEFT JOIN hst h ON k.trial_id = h.trial_id AND k.landmark_date >= h.effective_date)"""
MI = lambda d: f"(year({d}) * 12 + month({d}))"
LINES = "string_split(criteria, chr(10))"
FLAGS = ", ".join(f"coalesce(list_contains(intervention_types, '{k}'), false) AS intervention_{k.lower()}" for k in features.INTERVENTION_KINDS)
TEXTS = f"""SELECT *, list_filter(CASE WHEN o_first > 0 THEN ls[1:o_first - 1] ELSE ls END, lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(x, '{HEADING}')) AS inc,
  list_filter(CASE WHEN o_first > 0 THEN ls[o_first:] ELSE [] END, lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(x, '{HEADING}')) AS exc
  FROM (SELECT *, {LINES} AS ls, list_position(list_transform({LINES}, lambda x: regexp_matches(x, '{EXCLUSIONS}')), true) AS o_first FROM cur)"""


FEATURE_COLUMNS = f"""SELECT c.trial_id, c.landmark_index, c.landmark_date, allocation, intervention_model, primary_purpose, masking, healthy_volunteers, sex, minimum_age_years, maximum_age_years,
  CAST(enrollment_count AS DOUBLE) AS enrollment_count, {MI('primary_completion_date')} - {MI('start_date')} AS planned_duration_months,
  {MI('start_date')} > {MI('c.landmark_date')} AS start_anticipated, {MI('start_date')} < {MI('first_post_date')} AS registered_after_start, {MI('first_post_date')} - {MI('start_date')} AS registration_lag_months,
  year(first_post_date) AS registration_year, status, n_versions, n_versions - coalesce(then_n, 0) AS n_versions_recent, {MI('c.landmark_date')} - {MI('effective_date')} AS months_since_last_update,
  {MI('primary_completion_date')} - {MI('f_prim')} AS primary_completion_slip_months, {MI('completion_date')} - {MI('f_comp')} AS completion_slip_months,
  {MI('start_date')} - {MI('f_start')} AS start_slip_months, CASE enrollment_type WHEN 'ACTUAL' THEN true WHEN 'ESTIMATED' THEN false END AS enrollment_closed,
  CASE WHEN enrollment_type = 'ESTIMATED' AND f_type = 'ESTIMATED' AND f_count > 0 THEN enrollment_count / f_count END AS enrollment_target_ratio,
  CASE WHEN enrollment_type = 'ACTUAL' AND f_type = 'ESTIMATED' AND f_count > 0 THEN enrollment_count / f_count END AS enrolled_to_first_target_ratio,
  ever_suspended, status = 'SUSPENDED' AS currently_suspended, CASE WHEN status <> 'NOT_YET_RECRUITING' THEN false ELSE {MI('start_date')} < {MI('c.landmark_date')} END AS start_overdue,
  CASE WHEN primary_completion_date_type = 'ACTUAL' THEN false ELSE {MI('primary_completion_date')} < {MI('c.landmark_date')} END AS primary_completion_overdue, primary_completion_date_type = 'ACTUAL' AS primary_completion_reached,
  {MI('c.landmark_date')} - {MI('status_verified_date')} AS months_since_status_verified, coalesce(stratum, 'MISSING') AS sponsor_class, organization_class, maximum_age_years - minimum_age_years AS eligibility_age_span_years,
  {MI('c.landmark_date')} - {MI('first_post_date')} AS months_since_t0, title_phase, coalesce(len(intervention_types), 0) AS n_interventions, coalesce(len(list_distinct(intervention_types)), 0) AS n_intervention_types, {FLAGS},
  c.sponsor_key IS NOT NULL AS sponsor_has_identity, registrations AS sponsor_prior_registrations, ended AS sponsor_prior_ended, stopped AS sponsor_prior_stopped, n_open AS open_interventional_trials,
  CASE WHEN criteria IS NOT NULL THEN len(inc) END AS eligibility_n_inclusion, CASE WHEN criteria IS NOT NULL THEN len(exc) END AS eligibility_n_exclusion, length(criteria) AS eligibility_length, len(regexp_extract_all(criteria, '{THRESHOLD}')) AS eligibility_n_thresholds"""


@query(f"""{COUNTS}{FEATURES}, spans AS (SELECT min(effective_date) AS opened, max(effective_date) AS closed FROM versions GROUP BY trial_id),
ch AS (SELECT opened AS day, 1 AS c FROM spans UNION ALL SELECT closed, -1 FROM spans), tl AS (SELECT day, sum(sum(c)) OVER (ORDER BY day) AS n_open FROM ch GROUP BY day),
txt AS ({TEXTS}), opn AS (SELECT txt.*, coalesce(n_open, 0) AS n_open FROM txt ASOF LEFT JOIN tl ON txt.landmark_date >= tl.day)
{FEATURE_COLUMNS}
FROM opn c JOIN bef b ON c.trial_id = b.trial_id AND c.landmark_index = b.landmark_index LEFT JOIN cnt ON cnt.trial_id = c.trial_id AND cnt.landmark_index = c.landmark_index""")
def features_at_landmark(spark, sf_dir):
    """All features of every kept landmark row."""
    return features.select_features(feature_rows(spark, sf_dir))


@query(f"""{FULL}, spans AS (SELECT min(effective_date) AS opened, max(effective_date) AS closed FROM versions GROUP BY trial_id),
ch AS (SELECT opened AS day, 1 AS c FROM spans UNION ALL SELECT closed, -1 FROM spans), tl AS (SELECT day, sum(sum(c)) OVER (ORDER BY day) AS n FROM ch GROUP BY day)
SELECT trial_id, landmark_index, CAST(coalesce(n, 0) AS BIGINT) AS open_trials FROM (SELECT * FROM landmarks WHERE excluded IS NULL) l ASOF LEFT JOIN tl ON l.landmark_date >= tl.day""")
def competition_at_landmark(spark, sf_dir):
    held = versions(spark, sf_dir)
    keys = cohort.landmarks(held, STUDY).filter("excluded is null").select("trial_id", "landmark_index", "landmark_date")
    spans = held.groupBy("trial_id").agg(F.min("effective_date").alias("opened"), F.max("effective_date").alias("closed"))
    return features.competition(keys, spans).select("trial_id", "landmark_index", "open_trials")


@query(f"{WITH} SELECT trial_id, version, effective_date, m AS max_before FROM (SELECT *, max(effective_date) OVER (PARTITION BY trial_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM versions) WHERE effective_date < m")
def post_dates_out_of_order(spark, sf_dir):
    return out_of_order(versions(spark, sf_dir), "trial_id", "version", "effective_date").select("trial_id", "version", "effective_date", "max_before")


@query("SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n > 1 AND p IS NOT DISTINCT FROM event_type")
def consecutive_repeats(spark, sf_dir):
    return repeats(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"]).select("user_id", "event_id")


@query(f"""{WITH}, l AS (SELECT *, lag(status) OVER w AS a, lag(sponsor_key) OVER w AS b, lag(enrollment_type) OVER w AS c, row_number() OVER w AS n FROM versions WINDOW w AS (PARTITION BY trial_id ORDER BY version))
SELECT trial_id, version, list_aggregate(list_filter([CASE WHEN status IS DISTINCT FROM a THEN 'status' END, CASE WHEN sponsor_key IS DISTINCT FROM b THEN 'sponsor_key' END, CASE WHEN enrollment_type IS DISTINCT FROM c THEN 'enrollment_type' END], lambda x: x IS NOT NULL), 'string_agg', '|') AS changed
FROM l WHERE n > 1 AND (status IS DISTINCT FROM a OR sponsor_key IS DISTINCT FROM b OR enrollment_type IS DISTINCT FROM c)""")
def version_changes(spark, sf_dir):
    held = versions(spark, sf_dir).withColumn("status", cohort.submitted_status(STUDY))
    found = changes(held, "trial_id", "version", ["status", "sponsor_key", "enrollment_type"])
    return found.select("trial_id", "version", F.array_join("changed", "|").alias("changed"))
