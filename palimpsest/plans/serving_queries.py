"""Queries of the serving and monitoring side."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import monitoring, serving, survival
from ..operators.ranks import percentiles
from .registry import query, table


def scores(spark, sf_dir):
    """Customers as scored records."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k % 7).alias("hash"), (k % 5).cast("int").alias("index"), F.when(k % 3 == 0, "m2").otherwise("m1").alias("model"), ((k * 37 % 100) / 100.0).alias("risk"))


def earlier_scores(spark, sf_dir):
    k = F.col("id")
    s = scores(spark, sf_dir).filter(k % 11 != 0)
    return s.withColumn("hash", F.when(k % 13 == 0, 99).otherwise(F.col("hash"))).withColumn("model", F.lit("m1")).withColumn("index", F.when(k % 17 == 0, -1).otherwise(F.col("index"))).withColumn("risk", F.when(k % 2 == 0, F.col("risk") + 0.02).otherwise(F.col("risk")))


SCORES = """s AS (SELECT c_custkey AS id, c_custkey % 7 AS hash, CAST(c_custkey % 5 AS INTEGER) AS "index", CASE WHEN c_custkey % 3 = 0 THEN 'm2' ELSE 'm1' END AS model, (c_custkey * 37 % 100) / 100.0 AS risk FROM customer),
p AS (SELECT id, CASE WHEN id % 13 = 0 THEN 99 ELSE hash END AS hash, CASE WHEN id % 17 = 0 THEN -1 ELSE "index" END AS "index", 'm1' AS model, CASE WHEN id % 2 = 0 THEN risk + 0.02 ELSE risk END AS risk FROM s WHERE id % 11 <> 0)"""


@query(f"""WITH {SCORES}, j AS (SELECT s.*, p.hash AS h, p."index" AS i, p.model AS m, p.risk AS r FROM s LEFT JOIN p USING (id)), n AS (SELECT *, list_filter([CASE WHEN hash <> h THEN 'record_change' END, CASE WHEN "index" > i THEN 'landmark_passed' END, CASE WHEN model <> m THEN 'new_model' END], lambda x: x IS NOT NULL) AS l FROM j),
o AS (SELECT id, CASE WHEN r IS NULL THEN 'first_score' WHEN len(l) > 0 THEN array_to_string(l, '|') WHEN abs(risk - r) >= 0.01 THEN 'calendar' END AS reasons FROM n) SELECT * FROM o WHERE reasons IS NOT NULL""")
def score_history_reasons(spark, sf_dir):
    return serving.history_reasons(earlier_scores(spark, sf_dir), scores(spark, sf_dir)).select("id", F.array_join("reasons", "|").alias("reasons"))


@query(f"""WITH {SCORES} SELECT id, CASE WHEN s.id IS NULL THEN 'gone' WHEN p.id IS NULL THEN 'new' ELSE 'changed' END AS scope FROM p FULL JOIN (SELECT * FROM s WHERE id % 19 <> 0) s USING (id) WHERE s.id IS NULL OR p.id IS NULL OR (s.hash, s."index", s.model) IS DISTINCT FROM (p.hash, p."index", p.model)""")
def rescore_scope(spark, sf_dir):
    return serving.rescore_scope(earlier_scores(spark, sf_dir), scores(spark, sf_dir).filter("id % 19 <> 0"))


@query(f"""WITH {SCORES} SELECT id, coalesce(s.model, p.model) AS model, coalesce(s.hash, p.hash) AS hash, CASE WHEN p.id IS NULL THEN 'inserted' WHEN s.id IS NULL OR (s.model = p.model AND s.hash = p.hash) THEN 'kept' ELSE 'updated' END AS change FROM p FULL JOIN (SELECT * FROM s WHERE id % 19 <> 0) s USING (id)""")
def upserted_scores(spark, sf_dir):
    held, batch = (f(spark, sf_dir).select("id", "model", "hash") for f in (earlier_scores, scores))
    return serving.upsert(held, batch.filter("id % 19 <> 0"), ["id"])


@query(f"WITH {SCORES} SELECT s.* FROM s ANTI JOIN p USING (id)")
def appended_new_keys(spark, sf_dir):
    return serving.insert_new(earlier_scores(spark, sf_dir), scores(spark, sf_dir), ["id"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#0000000%' ORDER BY c_name LIMIT 50")
def sponsor_search(spark, sf_dir):
    return serving.search_prefix(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "Customer#0000000")


@query("SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 20")
def portfolio_page(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'"), table(spark, sf_dir, "orders")
    counts = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_acctbal").agg(F.count("o_orderkey").alias("n"))
    return serving.page(counts, [F.desc_nulls_last("c_acctbal"), "c_custkey"], 20, 20)


@query("""WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN [] WHEN p_partkey % 2 = 0 THEN [p_brand, p_type] ELSE [p_type] END AS areas FROM part), u AS (SELECT unnest(CASE WHEN len(areas) = 0 THEN ['none'] ELSE areas END) AS area FROM a)
SELECT area, count(*) AS n FROM u GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM a""")
def area_counts(spark, sf_dir):
    k = F.col("p_partkey")
    areas = F.when(k % 6 == 0, F.array(F.lit("none"))).when(k % 2 == 0, F.array("p_brand", "p_type")).otherwise(F.array("p_type"))
    parts = table(spark, sf_dir, "part").select(areas.alias("areas"))
    total = parts.agg(F.lit("total").alias("area"), F.count("*").alias("n"))
    return parts.select(F.explode("areas").alias("area")).groupBy("area").agg(F.count("*").alias("n")).unionByName(total)


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 300000) AS flagged, avg(o_totalprice) AS mean, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS median FROM orders GROUP BY 1")
def landscape_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 300000).alias("flagged"), F.avg("o_totalprice").alias("mean"))
    return found.join(percentiles(orders, ["o_orderpriority"], "o_totalprice", [0.5]).withColumnRenamed("p0", "median"), "o_orderpriority")


@query("WITH k AS (SELECT 42 AS id) SELECT k.id, c_name, n_name, (SELECT count(*) FROM orders WHERE o_custkey = k.id) AS n_orders FROM k LEFT JOIN customer ON c_custkey = k.id LEFT JOIN nation ON n_nationkey = c_nationkey")
def single_record(spark, sf_dir):
    """One key with what each serving table knows of it, also if none does."""
    key = spark.range(42, 43)
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    counts = o.filter("o_custkey = 42").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    found = key.join(c.filter("c_custkey = 42").withColumn("id", F.col("c_custkey")), "id", "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return found.join(counts, "id", "left").select("id", "c_name", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("SELECT conv_id, turn, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations QUALIFY rank <= 2")
def latest_two_rows(spark, sf_dir):
    return serving.latest_two(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.length("text").alias("chars"), "rank")


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1")
def latest_day_only(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.join(F.broadcast(e.agg(F.max("day").alias("day"))), "day").groupBy("event_type").agg(F.count("*").alias("n"))  # one row


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, unnest(['q','d','t']) AS name, unnest([l_quantity / 50, -l_discount * 10, l_tax * 10]) AS value FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1)), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY abs(value) DESC, name) AS k FROM v)
SELECT l_orderkey, l_linenumber, name, value FROM r WHERE k <= 2""")
def top_drivers_per_row(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    once = F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber")) == 1
    values = F.array(F.col("l_quantity") / 50, -F.col("l_discount") * 10, F.col("l_tax") * 10)
    named = lines.withColumn("once", once).filter("once").select("l_orderkey", "l_linenumber", F.array(F.lit("q"), F.lit("d"), F.lit("t")).alias("names"), values.alias("values"))
    top = named.select("l_orderkey", "l_linenumber", F.explode(serving.top_drivers(F.col("names"), F.col("values"), 2)).alias("d"))
    return top.select("l_orderkey", "l_linenumber", "d.name", "d.value")


@query("""WITH z AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT *, n * 100 / sum(n) OVER () AS q FROM z), f AS (SELECT *, floor(q) AS t FROM q), r AS (SELECT *, 100 - sum(t) OVER () AS l, row_number() OVER (ORDER BY q - t DESC, source) AS k FROM f)
SELECT source, CAST(t + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS take FROM r""")
def stratified_allocation(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return serving.stratified_allocation(sizes, "source", "n", 100)


@query("""WITH p AS (SELECT user_id AS id, CAST(min(ts) AS DATE) + CAST(7 * w AS INTEGER) AS prediction_date, CAST(w AS INTEGER) AS w FROM events, range(3) r(w) GROUP BY user_id, w),
e AS (SELECT user_id AS id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'purchase' THEN 1 ELSE 2 END AS event FROM events WHERE event_type IN ('purchase', 'error'))
SELECT p.id, w, coalesce(arg_min(event, (day, event)), 0) AS event, coalesce(CAST(min(day) - prediction_date AS DOUBLE), DATE '2024-01-25' - prediction_date + 0.5) AS "time" FROM p LEFT JOIN e ON p.id = e.id AND e.day > prediction_date AND e.day <= DATE '2024-01-25' GROUP BY p.id, w, prediction_date""")
def graded_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.to_date("ts").alias("day"), "event_type")
    first = e.groupBy("id").agg(F.min("day").alias("first"))
    p = first.select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("w"), "first").select("id", "w", F.date_add("first", F.col("w") * 7).alias("prediction_date"))
    ends = e.filter(F.col("event_type").isin("purchase", "error")).select("id", "day", F.when(F.col("event_type") == "purchase", 1).otherwise(2).alias("event"))
    return monitoring.outcomes_after(p, ends, date(2024, 1, 25)).select("id", "w", "event", "time")


@query("""WITH s AS (SELECT o_orderkey % 4 AS ix, o_totalprice > 250000 AS f, o_totalprice / 600000 AS score, (o_orderstatus = 'F')::INT AS label FROM orders), x AS (SELECT -1 AS index_group, 'all' AS "group", * FROM s UNION ALL SELECT ix, 'all', * FROM s UNION ALL SELECT -1, 'flagged', * FROM s WHERE f UNION ALL SELECT ix, 'flagged', * FROM s WHERE f)
SELECT CAST(index_group AS INTEGER) AS index_group, "group", count(*) AS n, avg(score) AS predicted, sum(label) / count(*) AS observed FROM x GROUP BY 1, 2""")
def grades_by_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_orderkey") % 4).alias("ix"), (F.col("o_totalprice") > 250000).alias("f"), (F.col("o_totalprice") / 600000).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.lit(1.0).alias("w"))
    return survival.calibration(monitoring.in_groups(rows, "ix", "f"), ["index_group", "group"], "score", "label", "w")


@query("""WITH r AS (SELECT o_totalprice AS x FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT o_totalprice * 1.1 AS x FROM orders WHERE o_orderkey % 2 = 1), e AS (SELECT unnest(quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM r),
p AS (SELECT bin, count(*) / (SELECT count(*) FROM r) AS p FROM (SELECT (SELECT count(*) FROM e WHERE x > e) AS bin FROM r) GROUP BY 1), q AS (SELECT bin, count(*) / (SELECT count(*) FROM c) AS q FROM (SELECT (SELECT count(*) FROM e WHERE x > e) AS bin FROM c) GROUP BY 1)
SELECT 'x' AS "column", sum((greatest(coalesce(q, 0), 1e-4) - greatest(coalesce(p, 0), 1e-4)) * ln(greatest(coalesce(q, 0), 1e-4) / greatest(coalesce(p, 0), 1e-4))) AS psi FROM p FULL JOIN q USING (bin)""")
def drift_psi(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    reference, current = o.filter("o_orderkey % 2 = 0").select(F.col("o_totalprice").alias("x")), o.filter("o_orderkey % 2 = 1").select((F.col("o_totalprice") * 1.1).alias("x"))
    return monitoring.stability_index(reference, current, "x")


@query("""WITH p AS (SELECT o_orderpriority AS k, count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), q AS (SELECT o_orderpriority AS k, count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS q FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT 'o_orderpriority' AS "column", sum((q - p) * ln(q / p)) AS psi FROM p JOIN q USING (k)""")
def category_drift_psi(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return monitoring.category_stability(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "o_orderpriority")
