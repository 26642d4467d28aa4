"""Queries that train: checked by held-out metrics and schema in the tests, as no SQL gives their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, cohort, cox, models, recalibration
from ..operators.features import select_features
from ..operators.text_svd import fit_components
from ..session import shared_folder, stored
from ..streaming.state import batch_changes
from .cohort_queries import feature_rows
from .registry import STUDY, query, table, versions
from .sponsor_queries import READ


@query()
def text_component_features(spark, sf_dir):
    """32 components of every document; tested against a dense decomposition."""
    shared_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fit_components(docs, "doc_id", "text").transform(docs, "doc_id", "text")


@query()
def discrete_time_risks(spark, sf_dir):
    held = stored(versions(spark, sf_dir).select(*READ))
    rows = cohort.person_periods(cohort.landmarks(held, STUDY).filter("excluded is null"), STUDY)
    months = (F.col("interval") * 6 + F.col("landmark_index")).alias("months")
    rows = stored(rows.select("trial_id", "landmark_index", "interval", "stratum", "outcome", months))  # every stage of the model reads them
    model = models.fit_hazards(rows, ["months"], ["stratum"])
    return models.risks(model, rows, ["months"], ["trial_id", "landmark_index"])


@query()
def change_stream_batch(spark, sf_dir):
    """The state machine over the whole log; the stream gives the same rows file by file."""
    held = versions(spark, sf_dir).withColumn("status", cohort.submitted_status(STUDY))
    records = held.select(F.col("trial_id").alias("id"), F.col("effective_date").alias("day"), F.col("version").alias("seq"), "status", F.md5(F.concat_ws("|", "status", F.col("enrollment_count").cast("string"))).alias("hash"))
    return batch_changes(records, frozenset(STUDY.status.ended))


@query()
def recalibrated_risks(spark, sf_dir):
    """Three chances corrected by index; the fit is tested against its own gradient and against known parameters."""
    held = cohort.landmarks(versions(spark, sf_dir), STUDY).filter("excluded is null")
    third = F.pmod(F.col("trial_id"), F.lit(10)) / 40 + 0.1
    rows = held.select("trial_id", "landmark_index", "event", third.alias("p_stop"), (third + 0.1).alias("p_complete")).withColumn("p_continue", 1 - F.col("p_stop") - F.col("p_complete"))
    fitted = recalibration.fit_recalibration(rows, "landmark_index", "event")
    return recalibration.recalibrated(rows, fitted, "landmark_index").drop("event")


NUMBERS = ("landmark_index", "interval", "months_since_t0", "enrollment_count", "planned_duration_months", "n_versions", "n_versions_recent", "months_since_last_update", "primary_completion_slip_months", "sponsor_prior_ended")


@query()
def boosted_hazards(spark, sf_dir):
    """Chances of (going on, stop, completion) per person-period from boosted trees, and the five features that move the
    chance of a stop most; tested for a lower held-out loss than a linear model's, and by brute force over subsets."""
    found = select_features(feature_rows(spark, sf_dir), "event", "event_date")
    rows = stored(cohort.person_periods(found, STUDY).select("trial_id", "outcome", *NUMBERS))
    flagged = rows.withColumn("check", F.pmod(F.xxhash64("trial_id"), F.lit(5)) == 0)
    model = boosting.fit(flagged, NUMBERS, "outcome", 3, validation="check", rounds=12, depth=3)
    return boosting.explained(rows, model, 1, ["trial_id", "landmark_index", "interval"])


@query()
def proportional_hazards(spark, sf_dir):
    """Cause-specific hazards of a stop and of a completion by landmark and class, with the test of proportionality;
    tested against a dense fit."""
    rows = cohort.landmarks(versions(spark, sf_dir), STUDY).filter("excluded is null")
    rows = stored(rows.select("event", F.datediff("event_date", "landmark_date").alias("time"), "landmark_index", F.year("landmark_date").alias("year"), "stratum"))
    parts = []
    for cause, kind in ((1, "stop"), (2, "completion")):
        model = cox.fit(rows, "time", F.col("event") == cause, ["landmark_index", "year"], ["stratum"])
        fitted = spark.createDataFrame([(f, float(b), float(v) ** 0.5) for f, b, v in zip(model.features, model.beta, model.covariance.diagonal())], "feature string, beta double, error double")
        parts.append(fitted.join(cox.proportionality(rows, model, "time", F.col("event") == cause, ["stratum"]), "feature").withColumn("cause", F.lit(kind)))
    return parts[0].unionByName(parts[1])
