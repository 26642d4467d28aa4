"""Queries of audits, comparisons, texts and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import cohort, compare
from ..operators.ranks import percentiles
from ..operators.versions import arg_max, arg_min, quarantine, unique_in
from .registry import STUDY, VERSIONS_SQL, query, table, versions

WITH = f"WITH {VERSIONS_SQL}"


@query(f"""{WITH} SELECT trial_id, arg_min(first_post_date, version) AS t0, min(effective_date) AS first_date, max(effective_date) AS last_date, count(*) AS n_versions, arg_max(status, version) AS last_status,
  any_value(stratum) AS stratum, count(DISTINCT (study_type, sponsor_key)) AS n_pairs FROM versions GROUP BY trial_id""")
def trials_summary(spark, sf_dir):
    held = versions(spark, sf_dir).withColumn("status", cohort.submitted_status(STUDY))
    v = F.col("version")
    return held.groupBy("trial_id").agg(
        arg_min(F.col("first_post_date"), v).alias("t0"), F.min("effective_date").alias("first_date"), F.max("effective_date").alias("last_date"), F.count("*").alias("n_versions"),
        arg_max(F.col("status"), v).alias("last_status"), F.any_value("stratum", True).alias("stratum"), F.countDistinct(F.struct("study_type", "sponsor_key")).alias("n_pairs"),
    )


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS types, count(DISTINCT (l_partkey, l_returnflag)) AS n FROM lineitem GROUP BY l_orderkey")
def type_lists(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("types"), F.countDistinct(F.struct("l_partkey", "l_returnflag")).alias("n"))


@query("""WITH j AS (SELECT *, CASE WHEN value < 0.5 THEN NULL ELSE value END AS v, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type) AS same FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN same > 1 THEN 'key: unique' END, CASE WHEN event_type = 'error' THEN 'type: known' END, CASE WHEN v > 90 THEN 'value: range' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM j WHERE same > 1 OR event_type = 'error' OR coalesce(v > 90, false)""")
def quarantined_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("v", F.when(F.col("value") >= 0.5, F.col("value")))
    checks = {"key: unique": unique_in(e, "user_id", "day", "event_type"), "type: known": F.col("event_type") != "error", "value: range": F.col("v") <= 90}
    return quarantine(e, checks)[1].select("event_id", "reasons")


OLD = "old AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0)"
NEW = "new AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0)"


def releases(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    new = o.filter(k % 11 != 0).withColumn("o_orderstatus", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(k % 9 != 0, F.col("o_totalprice")))
    return o.filter(k % 10 != 0), new


@query(f"""WITH {OLD}, {NEW}, j AS (SELECT a.*, b.o_custkey AS c2, b.o_orderstatus AS s2, b.o_totalprice AS p2, b.o_orderdate AS d2, b.o_orderpriority AS r2 FROM old a JOIN new b USING (o_orderkey))
SELECT 'o_custkey' AS "column", count(*) FILTER (WHERE o_custkey IS DISTINCT FROM c2) AS n_differ FROM j UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM s2) FROM j
UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE o_totalprice IS DISTINCT FROM p2) FROM j UNION ALL SELECT 'o_orderdate', count(*) FILTER (WHERE o_orderdate IS DISTINCT FROM d2) FROM j
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority IS DISTINCT FROM r2) FROM j""")
def release_column_differences(spark, sf_dir):
    return compare.column_differences(*releases(spark, sf_dir), ["o_orderkey"])


@query(f"WITH {OLD}, {NEW} SELECT CASE WHEN a.o_orderkey IS NULL THEN 'only_new' WHEN b.o_orderkey IS NULL THEN 'only_old' ELSE 'both' END AS presence, count(*) AS n FROM old a FULL JOIN new b ON a.o_orderkey = b.o_orderkey GROUP BY ALL")
def release_key_overlap(spark, sf_dir):
    return compare.key_overlap(*releases(spark, sf_dir), ["o_orderkey"])


@query(f"WITH {OLD}, {NEW}, a AS (SELECT o_custkey, o_orderstatus FROM old), b AS (SELECT o_custkey, o_orderstatus FROM new) SELECT *, 'old' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def release_multiset_difference(spark, sf_dir):
    old, new = (r.select("o_custkey", "o_orderstatus") for r in releases(spark, sf_dir))
    return compare.multiset_difference(old, new)


@query(f"{WITH} SELECT 'first_post_date' AS \"column\", avg((first_post_date IS NULL)::INT) AS share FROM versions UNION ALL SELECT 'completion_date', avg((completion_date IS NULL)::INT) FROM versions UNION ALL SELECT 'sponsor_key', avg((sponsor_key IS NULL)::INT) FROM versions")
def null_share_by_column(spark, sf_dir):
    return compare.null_shares(versions(spark, sf_dir), ["first_post_date", "completion_date", "sponsor_key"])


@query(f"{WITH} SELECT overall_status, count(*) AS n, min(year(effective_date)) AS first_year, max(year(effective_date)) AS last_year FROM versions GROUP BY 1")
def enum_values_by_year(spark, sf_dir):
    return versions(spark, sf_dir).groupBy("overall_status").agg(F.count("*").alias("n"), F.min(F.year("effective_date")).alias("first_year"), F.max(F.year("effective_date")).alias("last_year"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id, length(any_value(text)) AS chars FROM documents GROUP BY 1")
def text_dictionary(spark, sf_dir):
    """Distinct texts under their content address, with the lowest id."""
    return table(spark, sf_dir, "documents").groupBy(text.text_hash(F.col("text")).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.length(F.any_value("text", True)).alias("chars"))


@query("""SELECT c_custkey, sha256(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END)) AS content_hash FROM customer""")
def content_hashes(spark, sf_dir):
    segment = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.content_hash(F.col("c_custkey"), F.col("c_name"), segment).alias("content_hash"))


@query(f"""{WITH}, l AS (SELECT *, lag(status) OVER w AS a, lag(completion_date) OVER w AS b, lag(enrollment_count) OVER w AS c FROM versions WINDOW w AS (PARTITION BY trial_id ORDER BY version))
SELECT trial_id, version, (CASE WHEN a IS DISTINCT FROM status THEN 1 ELSE 0 END) + (CASE WHEN b IS DISTINCT FROM completion_date THEN 2 ELSE 0 END) + (CASE WHEN c IS DISTINCT FROM enrollment_count THEN 4 ELSE 0 END) AS marker FROM l""")
def change_markers(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("trial_id").orderBy("version")
    held = versions(spark, sf_dir).withColumn("status", cohort.submitted_status(STUDY))
    return held.select("trial_id", "version", text.marker_code([(F.lag(c).over(w), F.col(c)) for c in ("status", "completion_date", "enrollment_count")]).alias("marker"))


@query("""SELECT p_partkey, CASE upper(p_brand) WHEN '' THEN NULL WHEN 'BRAND#1' THEN 'FIRST' ELSE upper(p_brand) END AS brand,
  CASE p_partkey % 5 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size / 12 WHEN 2 THEN p_size * 7 / 365.25 WHEN 3 THEN p_size / 365.25 END AS age,
  CASE p_partkey % 8 WHEN 0 THEN 'PHASE1_PHASE2' WHEN 1 THEN 'PHASE3' WHEN 2 THEN 'PHASE4' WHEN 3 THEN 'OTHER' WHEN 4 THEN 'PHASE2_PHASE3' WHEN 5 THEN 'EARLY_PHASE1' ELSE 'NONE' END AS phase FROM part""")
def canonical_values(spark, sf_dir):
    k = F.col("p_partkey")
    unit = F.when(k % 5 == 0, " Years").when(k % 5 == 1, " Months").when(k % 5 == 2, " Weeks").when(k % 5 == 3, " Day").otherwise(" moons")
    age = text.age_in_years(F.concat(F.col("p_size").cast("string"), unit))
    title = F.concat(F.lit("A "), F.when(k % 8 == 0, "Phase I/II").when(k % 8 == 1, "phase 3").when(k % 8 == 2, "PHASE-IV").when(k % 8 == 3, "phase 1, then phase 3").when(k % 8 == 4, "phase 2a or phase 3").when(k % 8 == 5, "Early Phase 0").otherwise("phased"), F.lit(" trial of "), F.col("p_name"))
    brand = text.canonical_enum(F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" ")), {"BRAND#1": "FIRST"})
    return table(spark, sf_dir, "part").select("p_partkey", brand.alias("brand"), age.alias("age"), text.title_phase(title).alias("phase"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN make_date(CAST(year(d) AS INTEGER), 1, 1) WHEN 1 THEN CAST(date_trunc('month', d) AS DATE) ELSE d END AS day, CASE o_orderkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS "precision",
  CASE o_orderkey % 3 WHEN 0 THEN make_date(CAST(year(d) AS INTEGER), 12, 31) WHEN 1 THEN last_day(d) ELSE d END AS period_end FROM s""")
def partial_dates(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    written = F.when(k % 3 == 0, F.date_format(d, "yyyy")).when(k % 3 == 1, F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", dates.partial_date(written).alias("p")).select("o_orderkey", "p.day", "p.precision")
    return parsed.withColumn("period_end", dates.period_end(F.col("day"), F.col("precision")))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3000 - 100 AS INTEGER) AS e FROM orders)
SELECT o_orderkey, CASE WHEN e < d THEN -1 ELSE (SELECT max(k) FROM range(0, 30) r(k) WHERE CAST(d + to_months(CAST(6 * k AS INTEGER)) AS DATE) <= e) END AS true_index, date_diff('month', d, e) AS months FROM s""")
def landmark_indices(spark, sf_dir):
    d = F.to_date("o_orderdate")
    e = F.date_add(d, (F.col("o_orderkey") % 3000 - 100).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.true_index(d, e, 6).alias("true_index"), dates.months_between(e, d).alias("months"))


@query(f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(x, '{text.EXCLUSIONS}')), true) AS f FROM l)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN len(list_filter(CASE WHEN f > 0 THEN ls[1:f - 1] ELSE ls END, lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(x, '{text.HEADING}'))) END AS n_inclusion,
  CASE WHEN f > 0 THEN len(list_filter(ls[f:], lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(x, '{text.HEADING}'))) WHEN text IS NOT NULL THEN 0 END AS n_exclusion, length(text) AS length, len(regexp_extract_all(text, '{text.THRESHOLD}')) AS n_thresholds FROM p""")
def criteria_statistics(spark, sf_dir):
    stats = text.criteria_statistics(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in stats.items()])


@query(r"""SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email removed]', 'g') AS text, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n FROM documents WHERE contains(text, '@')""")
def scrubbed_emails(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@")))
    return d.select("doc_id", text.scrub_emails(F.col("text")).alias("text"), F.regexp_count("text", F.lit(text.EMAIL)).alias("n"))


@query()
def normalized_texts(spark, sf_dir):
    """Line grouping reads lines in order; tested on written-out cases."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # pages differ in length
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_text("html").alias("text"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS right_type FROM events")
def json_fields(spark, sf_dir):
    """A field by path with its type checked, so that a wrong type is told from a missing value."""
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.schema_of_variant(v).like("%k: BIGINT%").alias("right_type"))


@query("SELECT o_orderpriority, quantile_cont(o_totalprice, 0.9) AS p90, median(o_totalprice) AS p50, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS share FROM orders GROUP BY 1")
def exact_quantiles(spark, sf_dir):
    done = F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    orders = table(spark, sf_dir, "orders")
    found = percentiles(orders, ["o_orderpriority"], "o_totalprice", [0.9, 0.5]).select("o_orderpriority", F.col("p0").alias("p90"), F.col("p1").alias("p50"))
    return found.join(orders.groupBy("o_orderpriority").agg(done.alias("share")), "o_orderpriority")


@query(f"""{WITH}, t AS (SELECT trial_id, min(effective_date) AS a, max(effective_date) AS b FROM versions GROUP BY 1), m AS (SELECT CAST(d AS DATE) AS "month" FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-07-01', INTERVAL 1 MONTH) g(d))
SELECT "month", count(t.trial_id) AS n_open FROM m LEFT JOIN t ON a <= "month" AND b > "month" GROUP BY 1""")
def open_by_month(spark, sf_dir):
    """Months against intervals by a sweep of changes, not by an interval join."""
    from ..operators.asof import asof_value
    from ..operators.versions import open_counts

    spans = versions(spark, sf_dir).groupBy("trial_id").agg(F.min("effective_date").alias("opened"), F.max("effective_date").alias("closed"))
    months = spark.sql("SELECT explode(sequence(DATE '1995-01-01', DATE '2001-07-01', INTERVAL 1 MONTH)) AS month")
    return asof_value(months, open_counts(spans, "opened", "closed"), "month", "day", "n_open").select("month", F.coalesce("n_open", F.lit(0)).alias("n_open"))


@query("SELECT coalesce(r_name, 'All') AS r_name, coalesce(c_mktsegment, 'All') AS c_mktsegment, count(*) AS n, avg(c_acctbal) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, c_mktsegment), (r_name), ())")
def groups_with_all(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rolled = rows.rollup("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"))
    return rolled.select(F.coalesce("r_name", F.lit("All")).alias("r_name"), F.coalesce("c_mktsegment", F.lit("All")).alias("c_mktsegment"), "n", "mean")


@query(f"""{WITH}, w AS (SELECT *, lag(effective_date) OVER (PARTITION BY trial_id ORDER BY version) AS p FROM versions) SELECT year(effective_date) AS "year", stratum, count(*) AS n, median(abs(date_diff('day', p, effective_date))) AS median_gap FROM w GROUP BY ALL""")
def posting_lags(spark, sf_dir):
    from pyspark.sql import Window

    gap = F.abs(F.datediff("effective_date", F.lag("effective_date").over(Window.partitionBy("trial_id").orderBy("version"))))
    return versions(spark, sf_dir).withColumn("gap", gap).groupBy(F.year("effective_date").alias("year"), "stratum").agg(F.count("*").alias("n"), F.median("gap").alias("median_gap"))


@query(f"""{WITH}, r AS (SELECT date_trunc('month', effective_date)::DATE AS "month", coalesce(sponsor_key, 'none') AS reason, stratum FROM versions WHERE status = 'TERMINATED') SELECT "month", reason, stratum, count(*) AS n FROM r GROUP BY ALL""")
def stop_reason_cube(spark, sf_dir):
    held = versions(spark, sf_dir).withColumn("status", cohort.submitted_status(STUDY)).filter("status = 'TERMINATED'")
    return held.groupBy(F.trunc("effective_date", "month").alias("month"), F.coalesce("sponsor_key", F.lit("none")).alias("reason"), "stratum").agg(F.count("*").alias("n"))
