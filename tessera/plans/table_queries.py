"""Queries over tables: joins, aggregations, windows, sets, intervals, vectors, ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import nested as N
from tessera.functions import numbers as D
from tessera.functions import spans as S
from tessera.operators import aggregates as A
from tessera.operators import dedupe, gates, joins, ranking, topics, vectors
from tessera.operators import windows as W
from tessera.operators.intervals import year_spans
from tessera.plans.registry import Registry, islands_sql, spans_sql
from tessera.session import once, once_known, read

query = Registry()

MOT = "mot AS (SELECT test_id, max(COLUMNS(* EXCLUDE test_id)) FROM mot_tests GROUP BY test_id)"
ISSUES = "iss AS (SELECT DISTINCT ON (issue_id) * FROM issues)"
VIDEOS = "vid AS (SELECT DISTINCT ON (video_id) * FROM videos)"
LISTINGS = "lst AS (SELECT DISTINCT ON (listing_id) * FROM listings)"


def mot(spark, d, *columns):
    return once_known(read(spark, d, "mot_tests", "test_id", *columns), "test_id")


def issues(spark, d, *columns):
    return once(read(spark, d, "issues", "issue_id", *columns), "issue_id")


def videos(spark, d, *columns):
    return once(read(spark, d, "videos", "video_id", *columns), "video_id")


def listings(spark, d, *columns):
    return once(read(spark, d, "listings", "listing_id", *columns), "listing_id")


# -- joins


@query("SELECT o_orderkey, coalesce(n, 0) AS n_lines, coalesce(q, 0) AS quantity FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def left_zero_fill(spark, d):
    counts = read(spark, d, "lineitem", "l_orderkey", "l_quantity").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    return joins.zero_filled(read(spark, d, "orders", "o_orderkey"), counts, "o_orderkey", "n_lines", "quantity")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join_keys(spark, d):
    wanted = read(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").join(wanted, "l_orderkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_processed(spark, d):
    done = read(spark, d, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    return joins.processed_removed(read(spark, d, "customer", "c_custkey", "c_name"), done, "c_custkey")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dictionary_lookup(spark, d):
    nation = read(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return read(spark, d, "supplier", "s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query(f"WITH {MOT} SELECT t.engine_code, count(*) AS n FROM (SELECT test_id, e.engine_code FROM mot JOIN engines e ON mot.make = e.make AND abs(mot.cylinder_capacity - e.displacement_cc) <= 30) t GROUP BY 1")
def band_join(spark, d):
    m = mot(spark, d, "make", "cylinder_capacity").where("cylinder_capacity is not null")
    e = read(spark, d, "engines", "engine_code", F.col("make").alias("e_make"), "displacement_cc")
    hit = joins.band(m, e, "cylinder_capacity", "displacement_cc", 30).where("make = e_make")
    return hit.groupBy("engine_code").agg(F.count("*").alias("n"))


@query(f"WITH {MOT}, f AS (SELECT make, year(first_use_date) AS y FROM mot WHERE first_use_date IS NOT NULL) SELECT e.engine_code, count(*) AS n FROM f JOIN engines e ON f.make = e.make AND f.y >= e.year_lo AND f.y < e.year_hi + 1 GROUP BY 1")
def cohort_range_join(spark, d):
    f = mot(spark, d, "make", "first_use_date").where("first_use_date is not null").select("make", F.year("first_use_date").alias("y"))
    e = read(spark, d, "engines").select("engine_code", "make", F.col("year_lo").alias("lo"), (F.col("year_hi") + 1).alias("hi"))
    # counts first: a cohort join needs a make and a year once
    n = f.groupBy("make", "y").agg(F.count("*").alias("c"))
    return joins.in_range(n, e, "y", "lo", "hi", 5, "make").groupBy("engine_code").agg(F.sum("c").alias("n"))


@query(
    f"WITH {MOT}, e AS (SELECT displacement_cc AS cylinder_capacity, make, fuel_type, min(engine_code) AS code FROM engines GROUP BY ALL), r AS (SELECT displacement_cc AS cylinder_capacity, min(engine_code) AS code FROM engines GROUP BY ALL) "
    "SELECT test_id, coalesce(e.code, r.code) AS code, CASE WHEN e.code IS NOT NULL THEN 'exact' WHEN r.code IS NOT NULL THEN 'approximate' ELSE 'none' END AS confidence FROM mot LEFT JOIN e USING (cylinder_capacity, make, fuel_type) LEFT JOIN r USING (cylinder_capacity)"
)
def exact_then_fallback(spark, d):
    e = read(spark, d, "engines").withColumnRenamed("displacement_cc", "cylinder_capacity")
    exact = e.groupBy("cylinder_capacity", "make", "fuel_type").agg(F.min("engine_code").alias("code"))
    rough = e.groupBy("cylinder_capacity").agg(F.min("engine_code").alias("code"))
    m = mot(spark, d, "cylinder_capacity", "make", "fuel_type")
    return joins.exact_then_fallback(m, exact, ["cylinder_capacity", "make", "fuel_type"], rough, ["cylinder_capacity"], "code").select("test_id", "code", "confidence")


@query(f"WITH {MOT}, f AS (SELECT vehicle_id, make FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY test_date, test_id) AS r FROM mot) WHERE r = 1) SELECT f.make, count(*) AS n FROM mot JOIN f USING (vehicle_id) GROUP BY 1")
def dimension_once_join(spark, d):
    m = mot(spark, d, "vehicle_id", "make", "test_date")
    return joins.on_first(m.select("test_id", "vehicle_id"), m.select("vehicle_id", "make", "test_date", F.col("test_id").alias("t")), "vehicle_id", "test_date", "t").groupBy("make").agg(F.count("*").alias("n"))


@query(
    "SELECT c.c_nationkey AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT n_nationkey AS c_nationkey FROM nation) c LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) USING (c_nationkey) LEFT JOIN (SELECT s_nationkey AS c_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) USING (c_nationkey)"
)
def star_left_joins(spark, d):
    c = read(spark, d, "customer", "c_nationkey").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = read(spark, d, "supplier", "s_nationkey").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return joins.star(read(spark, d, "nation").select(F.col("n_nationkey").alias("nation")), "nation", c, s)


@query(
    f"WITH {ISSUES}, {VIDEOS}, e AS (SELECT issue_id, unnest(source_videos).video_id AS video_id FROM iss) SELECT issue_id, count(*) AS n, count(DISTINCT vid.channel) AS channels FROM e JOIN vid USING (video_id) GROUP BY 1"
)
def evidence_resolution(spark, d):
    i = issues(spark, d, "source_videos").select("issue_id", F.transform("source_videos", lambda v: v["video_id"]).alias("evidence"))
    r = joins.resolved_evidence(i, "issue_id", "evidence", videos(spark, d, "channel", "title"), "video_id", "channel", "title")
    return r.where("evidence is not null").select("issue_id", F.size("evidence").cast("bigint").alias("n"), F.col("distinct_channel").alias("channels"))


@query(
    f"WITH {ISSUES}, {VIDEOS}, e AS (SELECT DISTINCT u.video_id, u.title AS t, u.channel AS c FROM (SELECT unnest(source_videos) AS u FROM iss)) SELECT e.video_id, coalesce(nullif(trim(e.t), ''), nullif(trim(vid.title), '')) AS title, coalesce(nullif(trim(e.c), ''), nullif(trim(vid.channel), '')) AS channel FROM e LEFT JOIN vid ON e.video_id = vid.video_id"
)
def fallback_coalesce_join(spark, d):
    e = issues(spark, d, "source_videos").select(F.inline("source_videos")).select("video_id", "title", "channel").distinct()
    return joins.fallback_fields(e, videos(spark, d, "title", "channel"), "video_id", "title", "channel")


@query(
    "WITH e AS (SELECT engine_code, row_number() OVER (ORDER BY engine_code) AS k FROM engines), q AS (SELECT k, 0 AS template_no, replace(engine_code, '_', ' ') || ' common problems' AS query FROM e UNION ALL SELECT k, 1, split_part(engine_code, '_', 2) || ' engine review' FROM e) SELECT k, template_no, query FROM (SELECT *, row_number() OVER (PARTITION BY lower(query) ORDER BY k, template_no) AS r FROM q) WHERE r = 1"
)
def entity_queries(spark, d):
    # the reference list is of fixed size, so one window numbers it
    e = read(spark, d, "engines", "engine_code").withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("engine_code")))
    a = joins.entity_templates(e.withColumn("name", F.replace("engine_code", F.lit("_"), F.lit(" "))), ["{entity} common problems"], "name", "k")
    b = joins.entity_templates(e.withColumn("name", F.split("engine_code", "_")[1]), ["{entity} engine review"], "name", "k").withColumn("template_no", F.lit(1))
    return a.unionByName(b)


@query(
    "SELECT r_name, nation_count, pos FROM (SELECT r_regionkey, r_name FROM region) JOIN (SELECT n_regionkey, count(*) AS nation_count, list(n_name ORDER BY n_name)[1] AS pos FROM nation GROUP BY 1) ON r_regionkey = n_regionkey"
)
def group_first_value(spark, d):
    n = read(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("nation_count"), F.min("n_name").alias("pos"))
    return read(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "nation_count", "pos")


# -- aggregations


@query(
    f"WITH {MOT} SELECT engine_spec, year(first_use_date) AS reg_year, count(*) AS tests, CAST(sum(CASE WHEN upper(test_result) = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS passes, round(100e0 * avg(CASE WHEN upper(test_result) = 'F' THEN 1 ELSE 0 END), 1) AS fail_rate, round(avg(test_mileage), 2) AS mean_mileage FROM mot WHERE test_result IS NOT NULL GROUP BY 1, 2"
)
def failure_rates(spark, d):
    m = mot(spark, d, "engine_spec", "first_use_date", "test_result", "test_mileage").where("test_result is not null").withColumn("reg_year", F.year("first_use_date"))
    r = F.upper("test_result")
    return A.failure_rates(m, "engine_spec", "reg_year", failed=r == "F", passed=r == "P", mileage=F.col("test_mileage"))


@query(f"WITH {MOT} SELECT make, test_result, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY make), 2) AS share_of_a, round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY test_result), 2) AS share_of_b FROM mot GROUP BY 1, 2")
def two_way_shares(spark, d):
    return A.shares(mot(spark, d, "make", "test_result"), "make", "test_result")


@query(
    f"WITH {MOT} SELECT engine_spec, count(test_mileage) FILTER (test_result = 'F') AS n, CASE WHEN count(test_mileage) FILTER (test_result = 'F') >= 5 THEN round(quantile_cont(CASE WHEN test_result = 'F' THEN test_mileage END, 0.2), 4) END AS p20, CASE WHEN count(test_mileage) FILTER (test_result = 'F') >= 5 THEN round(quantile_cont(CASE WHEN test_result = 'F' THEN test_mileage END, 0.5), 4) END AS median, CASE WHEN count(test_mileage) FILTER (test_result = 'F') >= 5 THEN round(quantile_cont(CASE WHEN test_result = 'F' THEN test_mileage END, 0.8), 4) END AS p80 FROM mot GROUP BY 1"
)
def guarded_quantiles(spark, d):
    q = A.guarded_quantiles(mot(spark, d, "engine_spec", "test_result", "test_mileage"), "engine_spec", F.col("test_mileage"), 5, F.col("test_result") == "F")
    return q.select("engine_spec", "n", *[F.round(c, 4).alias(c) for c in ("p20", "median", "p80")])


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted, round(avg(l_extendedprice), 4) AS plain FROM lineitem GROUP BY 1")
def weighted_means(spark, d):
    return read(spark, d, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity").groupBy("l_returnflag").agg(
        F.round(A.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("weighted"), F.round(F.avg("l_extendedprice"), 4).alias("plain")
    )


@query(
    f"WITH {MOT}, c AS (SELECT make, model AS v, count(*) AS c FROM mot WHERE model IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY make ORDER BY c DESC, v) AS k, round(100e0 * c / sum(c) OVER (PARTITION BY make), 1) AS p FROM c) SELECT make, string_agg(printf('%s: %.1f%%', v, p), '; ' ORDER BY k) AS top FROM r WHERE k <= 4 GROUP BY 1"
)
def top_value_string(spark, d):
    return A.top_values(mot(spark, d, "make", "model"), "make", "model", 4)


@query(f"WITH {VIDEOS}, m AS (SELECT video_id, unnest(matched_queries) AS q FROM vid) SELECT trim(q) AS value, count(*) AS n FROM m WHERE trim(q) <> '' GROUP BY 1")
def exploded_counts(spark, d):
    return A.exploded_counts(videos(spark, d, "matched_queries"), F.col("matched_queries"))


@query(
    f"WITH {ISSUES} "
    + " UNION ALL ".join(f"SELECT '{c}' AS facet, coalesce({c}, 'unknown') AS value, count(*) AS n FROM iss GROUP BY 2" for c in ("system_component", "issue_type", "severity", "confidence", "data_quality"))
)
def kpi_histograms(spark, d):
    columns = ("system_component", "issue_type", "severity", "confidence", "data_quality")
    return A.histograms(issues(spark, d, *columns), *columns)


@query(
    f"WITH {ISSUES} SELECT count(*) AS issues, CAST(sum(mention_count) AS BIGINT) AS mentions, count_if(len(warning_signs) > 0) AS with_signs, count_if(severity = 'high') AS severe, count(DISTINCT system_component) AS components FROM iss"
)
def kpi_counters(spark, d):
    return issues(spark, d, "mention_count", "warning_signs", "severity", "system_component").agg(
        F.count("*").alias("issues"), F.sum("mention_count").alias("mentions"), F.count_if(F.size("warning_signs") > 0).alias("with_signs"), F.count_if(F.col("severity") == "high").alias("severe"), F.count_distinct("system_component").alias("components")
    )


@query(
    f"WITH {ISSUES}, v AS (SELECT DISTINCT issue_id, u.video_id, coalesce(nullif(u.channel, ''), 'v:' || u.video_id) AS channel, u.video_type_category AS cat FROM (SELECT issue_id, unnest(source_videos) AS u FROM iss)) SELECT issue_id, count(DISTINCT video_id) AS videos, count(DISTINCT channel) AS channels, count(DISTINCT CASE WHEN cat <> 'list_format' THEN video_id END) + count(DISTINCT CASE WHEN cat = 'list_format' THEN channel END) AS corroboration FROM v GROUP BY 1"
)
def issue_counters(spark, d):
    v = issues(spark, d, "source_videos").select("issue_id", F.inline("source_videos"))
    channel, cat = F.coalesce(F.nullif("channel", F.lit("")), F.concat(F.lit("v:"), "video_id")), F.col("video_type_category")
    return v.groupBy("issue_id").agg(
        F.count_distinct("video_id").alias("videos"), F.count_distinct(channel).alias("channels"), (F.count_distinct(F.when(cat != "list_format", F.col("video_id"))) + F.count_distinct(F.when(cat == "list_format", channel))).alias("corroboration")
    )


@query(
    f"WITH {ISSUES} SELECT system_component AS component, arg_max(issue_id, {{'n': len(source_videos), 'm': mention_count, 'i': issue_id}}) AS issue_id, count(*) AS merged, CAST(sum(mention_count) AS BIGINT) AS mention_count, arg_max(symptom, {{'n': length(symptom), 's': symptom}}) AS symptom, arg_min(label_short, {{'n': length(label_short), 's': label_short}}) AS label_short FROM iss WHERE system_component IS NOT NULL AND mention_count IS NOT NULL AND source_videos IS NOT NULL GROUP BY 1"
)
def cluster_merge(spark, d):
    i = issues(spark, d, "system_component", "source_videos", "mention_count", "symptom", "label_short").where("system_component is not null and mention_count is not null and source_videos is not null")
    m = A.merge_clusters(i.withColumnRenamed("system_component", "component"), "component", "issue_id", [F.size("source_videos"), F.col("mention_count")], longest=["symptom"], shortest=["label_short"], sums=["mention_count"])
    return m.drop("merged_ids")


@query(
    f"WITH {ISSUES} SELECT system_component AS component, engine, count(*) AS n FROM (SELECT system_component, unnest(affected_engines) AS engine FROM iss) WHERE engine <> 'all' GROUP BY 1, 2 HAVING count(*) > 0"
)
def trim_histogram(spark, d):
    return issues(spark, d, "system_component", "affected_engines").select(F.col("system_component").alias("component"), F.explode("affected_engines").alias("engine")).where("engine <> 'all'").groupBy("component", "engine").agg(F.count("*").alias("n"))


@query(
    f"WITH {MOT}, s AS (SELECT test_id, test_mileage, test_result FROM mot WHERE test_mileage IS NOT NULL) SELECT CASE WHEN test_mileage < 30000 THEN '0-30k' WHEN test_mileage < 60000 THEN '30-60k' WHEN test_mileage < 90000 THEN '60-90k' WHEN test_mileage < 120000 THEN '90-120k' WHEN test_mileage < 150000 THEN '120-150k' WHEN test_mileage < 180000 THEN '150-180k' WHEN test_mileage < 210000 THEN '180-210k' ELSE '210k+' END AS band, count(*) AS n FROM s GROUP BY 1"
)
def mileage_bands(spark, d):
    return mot(spark, d, "test_mileage").where("test_mileage is not null").groupBy(D.mileage_band(F.col("test_mileage")).alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {VIDEOS} SELECT video_id, CASE WHEN view_count_raw >= 1000000 THEN 4 WHEN view_count_raw >= 100000 THEN 3 WHEN view_count_raw >= 10000 THEN 2 WHEN view_count_raw >= 1000 THEN 1 ELSE 0 END AS score FROM (SELECT video_id, max(view_count_raw) AS view_count_raw FROM videos GROUP BY 1)")
def view_buckets(spark, d):
    v = read(spark, d, "videos", "video_id", "view_count_raw").groupBy("video_id").agg(F.max("view_count_raw").alias("v"))
    return v.select("video_id", D.steps(F.col("v"), [1_000, 10_000, 100_000, 1_000_000]).alias("score"))


@query(
    f"WITH {MOT} SELECT make, count(*) AS n, round(100e0 * count(test_mileage) / count(*), 2) AS mileage, round(100e0 * count(first_use_date) / count(*), 2) AS first_use, round(100e0 * count(fuel_type) / count(*), 2) AS fuel FROM mot GROUP BY 1"
)
def metadata_coverage(spark, d):
    found = lambda c: F.round(100.0 * F.count(c) / F.count("*"), 2)
    return mot(spark, d, "make", "test_mileage", "first_use_date", "fuel_type").groupBy("make").agg(F.count("*").alias("n"), found("test_mileage").alias("mileage"), found("first_use_date").alias("first_use"), found("fuel_type").alias("fuel"))


@query("SELECT l_returnflag AS k, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS sd FROM lineitem GROUP BY 1")
def mean_and_sd(spark, d):
    return read(spark, d, "lineitem", "l_returnflag", "l_discount").groupBy(F.col("l_returnflag").alias("k")).agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.stddev_samp("l_discount"), 6).alias("sd"))


# -- windows, ranks, sets


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def top_n_per_group(spark, d):
    return W.top_n(read(spark, d, "customer", "c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], 3, F.desc("c_acctbal"), F.col("c_custkey"))


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r <= 2")
def top_n_with_ties(spark, d):
    return W.top_n(read(spark, d, "part", "p_brand", "p_partkey", "p_size"), ["p_brand"], 2, F.desc("p_size"), ties=True)


@query("SELECT key, name, src FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s) AS r FROM (SELECT s_suppkey AS key, s_name AS name, 'supplier' AS src, 0 AS s FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer', 1 FROM customer)) WHERE r = 1")
def union_first_wins(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("src"))
    b = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("src"))
    return W.union_first_wins("key", a, b)


@query(
    f"WITH {LISTINGS}, a AS (SELECT listing_id, coalesce(engine_families, []) AS x, coalesce(transmissions, []) AS y FROM lst) SELECT listing_id, list_has_any(x, ['VX21', 'VD28']) AS overlaps, len(list_distinct(list_concat(x, y))) AS united, len([e FOR e IN list_distinct(x) IF e <> 'VX21']) AS rest, list_has_all(['manual', 'auto'], y) AS inside FROM a"
)
def array_set_operations(spark, d):
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    x, y = some("engine_families"), some("transmissions")
    return listings(spark, d, "engine_families", "transmissions").select(
        "listing_id",
        F.coalesce(F.arrays_overlap(x, F.array(F.lit("VX21"), F.lit("VD28"))), F.lit(False)).alias("overlaps"),
        F.size(F.filter(F.array_union(x, y), lambda e: e.isNotNull())).cast("bigint").alias("united"),
        F.size(F.filter(F.array_except(x, F.array(F.lit("VX21"))), lambda e: e.isNotNull())).cast("bigint").alias("rest"),
        (F.size(F.array_except(y, F.array(F.lit("manual"), F.lit("auto")))) == 0).alias("inside"),
    )


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def except_keys(spark, d):
    o = read(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    a, b = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key")).distinct(), o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key")).distinct()
    return joins.processed_removed(a, b, "key")


@query("SELECT o_orderstatus, y, n, n - lag(n) OVER (PARTITION BY o_orderstatus ORDER BY y) AS n_delta FROM (SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2)")
def run_delta(spark, d):
    o = read(spark, d, "orders", "o_orderstatus", "o_orderdate").groupBy("o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return W.run_delta(o, "o_orderstatus", "y", "n")


@query("SELECT y, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 END), 0)::BIGINT AS f, coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN 1 END), 0)::BIGINT AS o, coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END), 0)::BIGINT AS p FROM (SELECT year(o_orderdate) AS y, o_orderstatus FROM orders) GROUP BY 1")
def pivot_status(spark, d):
    return read(spark, d, "orders", "o_orderstatus", "o_orderdate").groupBy(F.year("o_orderdate").alias("y")).pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0).toDF("y", "f", "o", "p")


@query("SELECT p_partkey, measure, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR measure IN (size, price))")
def unpivot_measures(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return joins.long(p, "p_partkey", ["size", "price"], "measure", "value")


@query(
    "WITH o AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS c, o_totalprice FROM orders), n AS (SELECT count_if(NOT c) AS k FROM o), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM o WHERE c) SELECT o_orderkey FROM o WHERE NOT c UNION ALL SELECT o_orderkey FROM r, n WHERE rn <= floor(0.1 * k / (1 - 0.1))"
)
def share_cap(spark, d):
    o = read(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    return W.share_cap(o, F.col("o_orderpriority") == "1-URGENT", 0.1, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey")


@query("WITH t AS (SELECT o_orderkey, CAST(o_totalprice / 20000 AS INT) AS tier, o_totalprice FROM orders), n AS (SELECT tier, count(*) AS c FROM t GROUP BY 1), b AS (SELECT tier, coalesce(sum(c) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT o_orderkey, tier FROM t JOIN b USING (tier) WHERE before < 30 ORDER BY tier, o_totalprice, o_orderkey LIMIT 60")
def tier_quota(spark, d):
    t = read(spark, d, "orders", "o_orderkey", "o_totalprice").withColumn("tier", F.round(F.col("o_totalprice") / 20000).cast("int"))
    return W.quota_walk(t, "tier", 30, 60, F.col("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "tier")


@query("WITH n AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_brand FROM part) SELECT p_brand, b AS batch, count(*) AS n FROM (SELECT p_brand, i, i // 5 AS b FROM n UNION ALL SELECT p_brand, i, i // 5 - 1 FROM n WHERE i // 5 >= 1) WHERE b >= 0 AND i < b * 5 + 10 GROUP BY 1, 2")
def overlapping_batches(spark, d):
    n = read(spark, d, "part", "p_partkey", "p_brand").withColumn("i", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    return W.fixed_batches(n, "i", 10, 5).groupBy("p_brand", "batch").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey))::DOUBLE / count(*) OVER (PARTITION BY c_mktsegment) AS rank FROM customer")
def ecdf_rank(spark, d):
    return W.ecdf(read(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal", "rank", "c_custkey").select("c_custkey", "rank")


@query(f"WITH {VIDEOS} SELECT video_id, score FROM (SELECT video_id, 2 * coalesce(len(matched_queries), 0) + CASE WHEN video_type_category = 'list_format' THEN 0 ELSE 4 END AS score, duration_seconds FROM vid) WHERE duration_seconds IS NULL OR duration_seconds >= 120")
def candidate_scores(spark, d):
    v = videos(spark, d, "matched_queries", "video_type_category", "duration_seconds")
    v = gates.relaxed(v, F.col("duration_seconds") >= 120)
    return v.select("video_id", (2 * F.coalesce(F.size("matched_queries"), F.lit(0)) + F.when(F.col("video_type_category") == "list_format", 0).otherwise(4)).alias("score"))


@query(f"WITH {ISSUES} SELECT issue_id, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END DESC, coalesce(mention_count, 0) DESC, issue_id) AS rank FROM iss QUALIFY rank <= 100")
def issue_sort(spark, d):
    i = issues(spark, d, "severity", "mention_count").withColumn("s", F.coalesce(D.ranked(F.col("severity"), ["low", "medium", "high", "critical"]), F.lit(-1))).withColumn("m", F.coalesce("mention_count", F.lit(0)))
    # the report's head is taken by a distributed top-k before it is numbered
    head = i.orderBy(F.desc("s"), F.desc("m"), "issue_id").limit(100)
    return head.select("issue_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("s"), F.desc("m"), "issue_id")).alias("rank"))


# -- years


_JSON = "'[' || coalesce(string_agg('{\"lo\":' || lo || ',\"hi\":' || hi || '}', ',' ORDER BY lo, hi), '') || ']'"


@query(
    f"WITH {ISSUES}, " + spans_sql("SELECT issue_id AS k, affected_years AS t FROM iss") + ", " + islands_sql("span")
    + ", win(a, z) AS (VALUES (2005, 2012), (2016, 2019)), cut AS (SELECT k, greatest(lo, a) AS lo, least(hi, z) AS hi FROM isl, win WHERE greatest(lo, a) <= least(hi, z)), " + islands_sql("cut", "ins")
    + f", i AS (SELECT k, {_JSON} AS inside FROM ins GROUP BY k), c AS (SELECT k, {_JSON} AS clamped FROM (SELECT k, greatest(lo, 2008) AS lo, least(hi, 2018) AS hi FROM isl) WHERE lo <= hi GROUP BY k), l AS (SELECT k, CASE WHEN min(lo) = max(hi) THEN min(lo)::VARCHAR ELSE min(lo) || '-' || max(hi) END AS label FROM isl GROUP BY k) SELECT issue_id, l.label, coalesce(inside, '[]') AS inside, coalesce(clamped, '[]') AS clamped FROM iss LEFT JOIN l ON l.k = issue_id LEFT JOIN i ON i.k = issue_id LEFT JOIN c ON c.k = issue_id"
)
def year_span_algebra(spark, d):
    """Union, intersection with a window, clamp and label of each issue's spans."""
    window = F.array(S.span(F.lit(2005), F.lit(2012)), S.span(F.lit(2016), F.lit(2019)))
    i = issues(spark, d, "affected_years").select("issue_id", S.union(year_spans(F.col("affected_years"))).alias("spans"))
    return i.select("issue_id", F.nullif(S.label(F.col("spans")), F.lit("")).alias("label"), F.to_json(S.intersect(F.col("spans"), window)).alias("inside"), F.to_json(S.clamp(F.col("spans"), F.lit(2008), F.lit(2018))).alias("clamped"))


@query(
    f"WITH {ISSUES}, " + spans_sql("SELECT 'o' || issue_id AS k, affected_years AS t FROM iss UNION ALL SELECT k, t FROM (SELECT DISTINCT ctx_id, 'c' || issue_id AS k, years AS t FROM engine_year_context WHERE issue_id IS NOT NULL)")
    + ", base AS (SELECT issue_id AS k, lo, hi FROM iss JOIN span ON span.k = 'o' || issue_id UNION ALL SELECT issue_id, lo, hi FROM iss JOIN span ON span.k = 'c' || issue_id WHERE 'o' || issue_id NOT IN (SELECT k FROM span)), " + islands_sql("base", "bas")
    + ", win AS (SELECT DISTINCT issue_id AS k, year_lo AS a, year_hi AS z FROM (SELECT issue_id, unnest(affected_engines) AS engine_code FROM iss) JOIN engines USING (engine_code)), cut AS (SELECT b.k, greatest(lo, a) AS lo, least(hi, z) AS hi FROM base b JOIN win w ON w.k = b.k WHERE greatest(lo, a) <= least(hi, z)), "
    + islands_sql("cut", "ins")
    + ", inside AS (SELECT * FROM ins UNION ALL SELECT * FROM bas WHERE k NOT IN (SELECT k FROM win)), lab AS (SELECT k, CASE WHEN min(lo) = max(hi) THEN min(lo)::VARCHAR ELSE min(lo) || '-' || max(hi) END AS years FROM inside GROUP BY k), con AS (SELECT k, CASE WHEN min(lo) = max(hi) THEN min(lo)::VARCHAR ELSE min(lo) || '-' || max(hi) END AS years FROM bas WHERE k NOT IN (SELECT k FROM inside) GROUP BY k) SELECT issue_id, coalesce(lab.years, con.years) AS years, CASE WHEN con.k IS NOT NULL THEN 'conflict' WHEN lab.k IS NULL THEN 'none' WHEN 'o' || issue_id IN (SELECT k FROM span) THEN 'medium' ELSE 'low' END AS confidence FROM iss LEFT JOIN lab ON lab.k = issue_id LEFT JOIN con ON con.k = issue_id"
)
def year_triangulation(spark, d):
    """Spans and confidence from an issue's own phrase, its engines' contexts and its engines' production window."""
    own = issues(spark, d, "affected_years", "affected_engines").select("issue_id", year_spans(F.col("affected_years")).alias("own"), "affected_engines")
    context = once(read(spark, d, "engine_year_context", "ctx_id", "issue_id", "years"), "ctx_id").select("issue_id", F.inline(year_spans(F.col("years"))))
    context = context.groupBy("issue_id", "lo", "hi").agg(F.count("*").alias("n")).groupBy("issue_id").agg(F.collect_list(S.span(F.col("lo"), F.col("hi"))).alias("context"))
    engines = read(spark, d, "engines").select(F.col("engine_code").alias("engine"), "year_lo", "year_hi")
    window = own.select("issue_id", F.explode("affected_engines").alias("engine")).join(engines, "engine").groupBy("issue_id").agg(F.collect_set(S.span(F.col("year_lo"), F.col("year_hi"))).alias("window"))
    some = lambda c: F.coalesce(c, F.array().cast(S.SPANS))
    r = own.join(context, "issue_id", "left").join(window, "issue_id", "left").withColumn("t", ranking.triangulated(some("own"), some("context"), F.array().cast(S.SPANS), some("window")))
    return r.select("issue_id", F.nullif(S.label(F.col("t.spans")), F.lit("")).alias("years"), F.col("t.confidence").alias("confidence"))


@query("SELECT make, min(year_lo) AS lo, max(year_hi) AS hi, count(*) AS n FROM engines GROUP BY 1")
def engine_windows(spark, d):
    return read(spark, d, "engines", "make", "year_lo", "year_hi").groupBy("make").agg(F.min("year_lo").alias("lo"), F.max("year_hi").alias("hi"), F.count("*").alias("n"))


# -- vectors and ranking


@query(
    "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v a, v b WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10"
)
def knn_top10(spark, d):
    v = read(spark, d, "embeddings", "vec_id", "embedding")
    return vectors.top_k(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10, "vec_id", "embedding")


@query()
def knn_indexed(spark, d):
    """Approximate neighbours of every twentieth vector by an inverted file (recall is measured in the tests)."""
    v = read(spark, d, "embeddings", "vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.indexed_top_k(v, q, 10, "vec_id", "embedding", vectors.fit_centroids(v, "vec_id", "embedding"))


_RETRIEVAL = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 s AS (SELECT a.vec_id AS probe, b.vec_id, b.label, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v a, v b WHERE a.vec_id % 20 = 0),
 h AS (SELECT *, 0 AS pass, row_number() OVER (PARTITION BY probe ORDER BY distance, vec_id) AS rank FROM s WHERE label IN (1, 2, 3) QUALIFY rank <= 14
       UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY probe ORDER BY distance, vec_id) AS rank FROM s WHERE label <> 0 QUALIFY rank <= 8),
 f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY probe, pass, rank) = 1),
 t AS (SELECT f.vec_id, f.probe, f.distance, d.source, CASE WHEN f.label = 1 THEN 1 WHEN f.label IN (2, 3) THEN 2 ELSE 4 END AS tier,
   greatest(0, CASE WHEN d.text LIKE '%leak%' THEN 1 ELSE 0 END + CASE WHEN d.text LIKE '%overheat%' THEN 1 ELSE 0 END - CASE WHEN d.text LIKE '%never%' THEN 1 ELSE 0 END) AS signal
   FROM f LEFT JOIN documents d ON f.vec_id = d.doc_id)
SELECT vec_id, probe, distance, source, tier, signal FROM t
"""


@query(_RETRIEVAL)
def tiered_retrieval(spark, d):
    """Multi-probe retrieval with strict and broad predicates, first hit wins, joined to its document, tiered and scored."""
    v = read(spark, d, "embeddings", "vec_id", "embedding", "label")
    broad, strict = F.col("label") != 0, F.col("label").isin(1, 2, 3)
    hits = vectors.multi_probe(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "embedding"), "vec_id", "embedding", broad, strict, 14, 8, ["label"])
    docs = read(spark, d, "documents", F.col("doc_id").alias("vec_id"), "source", "text")
    tier = ranking.tiered(4, [(F.col("label").isin(2, 3), 2), (F.col("label") == 1, 1)])
    t = hits.join(docs, "vec_id", "left").withColumn("tier", tier).withColumn("signal", ranking.signal(F.coalesce("text", F.lit("")), ["leak", "overheat"], [], ["never"]))
    return t.select("vec_id", "probe", "distance", "source", "tier", "signal")


@query(_RETRIEVAL.replace("SELECT vec_id, probe, distance, source, tier, signal FROM t", ", r AS (SELECT *, row_number() OVER (ORDER BY tier, signal DESC, distance, vec_id) AS rn FROM t), c AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source, 'general') ORDER BY rn) AS k FROM r WHERE rn <= 30) SELECT vec_id, row_number() OVER (ORDER BY CASE WHEN k = 1 AND coalesce(source, 'general') <> 'general' THEN 0 ELSE 1 END, rn) AS position FROM c"))
def diversified_head(spark, d):
    """The head of the ranked evidence, the first of each source in front."""
    t = tiered_retrieval(spark, d).withColumn("category", F.coalesce("source", F.lit("general")))
    order = [F.col("tier"), F.desc("signal"), F.col("distance"), F.col("vec_id")]
    head = t.orderBy(*order).limit(30).withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return W.diversified(head, "rn", "category").select("vec_id", "position")


@query(
    f"WITH {LISTINGS} SELECT listing_id, CASE WHEN list_has_any(engines, ['2.0_Sorbek']) THEN 1 WHEN list_has_any(engine_families, ['VX21', 'NS19']) THEN 2 WHEN list_has_any(fuel_types, ['petrol']) THEN 3 ELSE 4 END AS tier FROM lst"
)
def tag_overlap_tier(spark, d):
    wanted = lambda *xs: F.array(*map(F.lit, xs))
    t = ranking.overlap_tier([(F.col("engines"), wanted("2.0_Sorbek")), (F.col("engine_families"), wanted("VX21", "NS19")), (F.col("fuel_types"), wanted("petrol"))], F.lit(False))
    return listings(spark, d, "engines", "engine_families", "fuel_types").select("listing_id", t.alias("tier"))


@query(
    f"WITH {LISTINGS}, t AS (SELECT count_if(list_has_any(engine_families, ['VX21'])) AS t1, count_if(list_has_any(fuel_types, ['petrol'])) AS t2, count_if(list_has_any(drive_types, ['belt'])) AS t3 FROM lst) SELECT t1, t2, t3, CASE WHEN t1 >= 10 OR t1 + t2 >= 15 THEN 'high' WHEN t1 >= 3 OR t1 + t2 >= 5 THEN 'medium' WHEN t1 > 0 OR t2 + t3 >= 5 THEN 'low' ELSE 'minimal' END AS grade FROM t"
)
def coverage_grade(spark, d):
    has = lambda c, v: F.count_if(F.array_contains(c, F.lit(v)))
    t = listings(spark, d, "engine_families", "fuel_types", "drive_types").agg(has("engine_families", "VX21").alias("t1"), has("fuel_types", "petrol").alias("t2"), has("drive_types", "belt").alias("t3"))
    return t.withColumn("grade", ranking.coverage(F.col("t1"), F.col("t2"), F.col("t3"), F.lit(0)))


@query(f"WITH {LISTINGS} SELECT listing_id, mileage_km FROM lst WHERE list_contains(fuel_types, 'diesel') AND mileage_km >= 100000 AND contains(lower(raw_text), 'owner')")
def faceted_filter(spark, d):
    df = listings(spark, d, "mileage_km", "fuel_types", "raw_text")
    return gates.faceted(df, F.lower("raw_text"), "owner", {"slug": "all"}, {"fuel_types": "diesel"}, {"mileage_km": 100_000}).select("listing_id", "mileage_km")


@query(f"WITH {LISTINGS}, c AS (SELECT slug, count(*) AS n FROM lst GROUP BY 1) SELECT CASE WHEN n < 8 THEN 'other' ELSE slug END AS slug, count(*) AS n FROM lst JOIN c USING (slug) GROUP BY 1")
def rare_category(spark, d):
    return gates.category_filter(listings(spark, d, "slug").where("slug is not null"), "slug", 8).groupBy("slug").agg(F.count("*").alias("n"))


@query(
    f"WITH {ISSUES} SELECT issue_id FROM iss WHERE coalesce(distinct_channel_count >= 2 OR (distinct_channel_count >= 1 AND confidence = 'high' AND (data_quality = 'high' OR coalesce(symptom, '') LIKE '%smoke%')), false)"
)
def confirmed_issues(spark, d):
    i = issues(spark, d, "distinct_channel_count", "confidence", "data_quality", "symptom")
    return i.where(ranking.confirmed(F.col("distinct_channel_count"), F.col("confidence"), F.col("data_quality"), F.contains(F.coalesce("symptom", F.lit("")), F.lit("smoke")))).select("issue_id")


@query(
    f"WITH RECURSIVE {ISSUES}, b AS (SELECT issue_id AS id, system_component AS k, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(label), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2 AND w NOT IN ('the', 'of')))) AS w FROM iss), "
    "e AS (SELECT x.id AS a, y.id AS b FROM b x JOIN b y ON x.k IS NOT DISTINCT FROM y.k AND x.id <> y.id WHERE len(x.w) > 0 AND len(y.w) > 0 AND (x.w = y.w OR (x.k = y.k AND len(list_intersect(x.w, y.w)) >= 2 AND (len(list_intersect(x.w, y.w)) = least(len(x.w), len(y.w)) OR len(list_intersect(x.w, y.w)) >= 0.55 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))))))), "
    "r(id, other) AS (SELECT id, id FROM b UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other) SELECT id, min(other) AS cluster FROM r GROUP BY 1"
)
def duplicate_clusters(spark, d):
    """Issues whose labels' token bags are alike within one component, clustered (checked against brute force in the tests)."""
    from tessera.functions.text import semantic_tokens

    i = issues(spark, d, "label", "system_component").select("issue_id", "system_component", semantic_tokens(F.col("label"), {}, {}, ["the", "of"]).alias("bag"))
    return dedupe.clusters(i, "issue_id", "system_component", "bag")


# -- nested values and models


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events", "event_id", "props").select("event_id", N.json_object(F.col("props"), "k int")["k"].alias("k"))


@query("SELECT vec_id, '[' || list_aggregate([printf('%.4f', x::DOUBLE) FOR x IN embedding], 'string_agg', ', ') || ']' AS text FROM embeddings")
def vector_text(spark, d):
    return read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", N.vector_text(F.col("embedding"), 4).alias("text"))


@query(f"WITH {LISTINGS} SELECT listing_id, list_distinct([trim(x) FOR x IN coalesce(trims, []) IF x IS NOT NULL AND trim(x) <> '']).list_sort() AS trims FROM lst")
def cleaned_lists(spark, d):
    return listings(spark, d, "trims").select("listing_id", F.array_sort(N.cleaned(F.col("trims"))).alias("trims"))


@query()
def kmeans_topics(spark, d):
    """Clusters of vectors with small ones as outliers: an approximation of density clustering."""
    return topics.cluster_vectors(read(spark, d, "embeddings", "vec_id", "embedding"), "embedding", 8, 5, reduce_to=5).select("vec_id", "topic")


@query()
def covariate_coefficients(spark, d):
    """Coefficients of test results on mileage, year and fuel."""
    m = mot(spark, d, "test_result", "test_mileage", "test_year", "fuel_type").where("test_result is not null").select(F.upper("test_result").alias("topic"), D.log_clipped(F.col("test_mileage").cast("double")).alias("mileage_log"), D.centred(F.col("test_year"), 2015).alias("year"), "fuel_type")
    return topics.covariate_model(m, "topic", ["mileage_log", "year"], ["fuel_type"])


@query(
    f"WITH {MOT}, g AS (SELECT make, fuel_type, avg(test_mileage) AS m, stddev_samp(test_mileage) / sqrt(count(test_mileage)) AS se, sum(test_mileage) AS s, count(test_mileage) AS n FROM mot WHERE fuel_type IS NOT NULL GROUP BY 1, 2) SELECT make, fuel_type, round(m, 3) AS estimate, round(m - 1.96 * se, 3) AS ci_lower, round(m + 1.96 * se, 3) AS ci_upper, round(m - sum(s) OVER (PARTITION BY make) / sum(n) OVER (PARTITION BY make), 3) AS contrast FROM g"
)
def group_effects(spark, d):
    e = topics.effects(mot(spark, d, "make", "fuel_type", "test_mileage").where("fuel_type is not null"), "make", "fuel_type", "test_mileage")
    return e.select("make", "fuel_type", *[F.round(c, 3).alias(c) for c in ("estimate", "ci_lower", "ci_upper", "contrast")])


# -- records, contexts, windows of the reference list


@query(
    f"WITH {ISSUES} SELECT issue_id, CASE WHEN label IS NULL OR lower(trim(label)) IN ('', 'null', 'none', 'nan', 'n/a', 'na', 'unknown', '-') THEN NULL ELSE trim(label) END AS label, CASE WHEN lower(trim(severity)) IN ('low', 'medium', 'high', 'critical') THEN lower(trim(severity)) ELSE 'unknown' END AS severity, list_sort(list_distinct([trim(x) FOR x IN coalesce(warning_signs, []) IF x IS NOT NULL AND trim(x) <> ''])) AS warning_signs, coalesce(mention_count, 0) AS mention_count, (source IS NOT NULL)::INT AS extras FROM iss"
)
def normal_issue_records(spark, d):
    from tessera.operators.records import normal_issues

    i = normal_issues(issues(spark, d, "label", "severity", "warning_signs", "mention_count", "source"), "issue_id", ["label"], {"severity": ["low", "medium", "high", "critical"]}, ["warning_signs"], ["mention_count"])
    return i.select("issue_id", "label", "severity", F.array_sort("warning_signs").alias("warning_signs"), "mention_count", F.size("extra_fields").alias("extras"))


@query(
    "WITH c AS (SELECT DISTINCT ctx_id, issue_id, trim(engine, ' ') AS engine, years, evidence_hits FROM engine_year_context WHERE issue_id IS NOT NULL AND trim(engine, ' ') <> ''), "
    + spans_sql("SELECT ctx_id AS k, years AS t FROM c")
    + ", y AS (SELECT issue_id, engine, y FROM c JOIN (SELECT k, unnest(range(greatest(lo, 1990), least(hi, 2030) + 1)) AS y FROM span) ON k = ctx_id), p AS (SELECT issue_id, engine, min(y)::INT AS year_lo, max(y)::INT AS year_hi, count(DISTINCT y) AS years FROM y GROUP BY 1, 2), h AS (SELECT issue_id, engine, sum(evidence_hits)::BIGINT AS hits FROM c GROUP BY 1, 2) SELECT issue_id, engine, year_lo, year_hi, coalesce(years, 0) AS years, hits FROM h LEFT JOIN p USING (issue_id, engine)"
)
def year_context_merge(spark, d):
    """Every context that names an engine, whatever form its years are written in."""
    from tessera.operators.records import year_context

    c = once(read(spark, d, "engine_year_context", "ctx_id", "issue_id", "engine", "years", "evidence_hits"), "ctx_id").where("issue_id is not null and trim(engine) <> ''").withColumn("engine", F.trim("engine"))
    return year_context(c, ["issue_id", "engine"], year_spans(F.col("years")), "evidence_hits")


@query(f"WITH {ISSUES} SELECT issue_id, min(year_lo) AS window_lo, max(year_hi) AS window_hi FROM (SELECT issue_id, unnest(affected_engines) AS engine_code FROM iss) JOIN engines USING (engine_code) GROUP BY 1")
def engine_window_lookup(spark, d):
    from tessera.operators.records import with_window

    return with_window(issues(spark, d, "affected_engines"), "issue_id", "affected_engines", read(spark, d, "engines"), "engine_code", "year_lo", "year_hi")


@query(
    f"WITH {ISSUES}, " + spans_sql("SELECT issue_id AS k, affected_years AS t FROM iss")
    + ", e AS (SELECT issue_id, unnest(affected_engines) AS engine_code FROM iss), f AS (SELECT issue_id, engine_code, year_lo IS NULL OR issue_id NOT IN (SELECT k FROM span) OR EXISTS (SELECT 1 FROM span WHERE k = issue_id AND year_lo <= hi AND lo <= year_hi) AS ok FROM e LEFT JOIN engines USING (engine_code)), g AS (SELECT issue_id, list_sort(list(DISTINCT engine_code) FILTER (ok AND engine_code IS NOT NULL)) AS fit, list_sort(list(DISTINCT engine_code) FILTER (engine_code IS NOT NULL)) AS every FROM f GROUP BY 1) SELECT issue_id, CASE WHEN len(fit) > 0 THEN fit ELSE coalesce(every, []) END AS engines, CASE WHEN len(fit) > 0 THEN len(every) - len(fit) ELSE 0 END AS dropped FROM g"
)
def engine_year_validation(spark, d):
    """Every issue that names an engine, against all spans of its years; without a readable year every engine stays."""
    from tessera.operators.records import engines_in_spans

    i = issues(spark, d, "affected_years", "affected_engines").select("issue_id", F.col("affected_engines").alias("engines"), year_spans(F.col("affected_years")).alias("spans"))
    r = engines_in_spans(i, "issue_id", "engines", "spans", read(spark, d, "engines"), "engine_code", "year_lo", "year_hi")
    return r.select("issue_id", "engines", F.size("dropped").cast("bigint").alias("dropped"))


@query(
    f"WITH {ISSUES}, v AS (SELECT DISTINCT video_id, CASE WHEN title LIKE '%problem%' THEN 'problem' WHEN title LIKE '%review%' OR title LIKE '%honest%' THEN 'review' ELSE 'other' END AS t FROM videos), c AS (SELECT issue_id, t, count(*) AS c FROM (SELECT issue_id, unnest(source_videos).video_id AS video_id FROM iss) JOIN v USING (video_id) GROUP BY 1, 2) SELECT issue_id, sum(c)::BIGINT AS n, CASE WHEN max(c)::DOUBLE / sum(c) > 0.5 THEN arg_max(t, (c, t)) ELSE 'mixed' END AS dominant FROM c GROUP BY 1"
)
def dominant_evidence_class(spark, d):
    from tessera.functions.text import first_class

    v = videos(spark, d, "title").select("video_id", first_class(F.col("title"), [("problem", "problem"), ("review", "review|honest")], "other").alias("t"))
    refs = issues(spark, d, "source_videos").select("issue_id", F.inline("source_videos")).select("issue_id", "video_id")
    c = refs.join(v, "video_id").groupBy("issue_id", "t").agg(F.count("*").alias("c"))
    return c.groupBy("issue_id").agg(F.sum("c").alias("n"), F.when(F.max("c") / F.sum("c") > 0.5, F.max_by("t", F.struct("c", "t"))).otherwise("mixed").alias("dominant"))


@query(
    f"WITH RECURSIVE {VIDEOS}, t AS (SELECT video_id, channel AS scope, unnest(matched_queries) AS entity, unnest(range(len(matched_queries))) AS pos FROM vid), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY pos || '|' || video_id) AS i FROM t), "
    "w AS (SELECT scope, entity, video_id, i, true AS kept, [video_id] AS taken, [entity] AS used FROM r WHERE i = 1 UNION ALL SELECT scope, entity, video_id, i, kept, CASE WHEN kept THEN list_append(taken, video_id) ELSE taken END, CASE WHEN kept THEN list_append(used, entity) ELSE used END FROM (SELECT r.*, w.taken, w.used, NOT list_contains(w.taken, r.video_id) AND len(list_filter(w.used, lambda x: x IS NOT DISTINCT FROM r.entity)) < 3 AS kept FROM w JOIN r ON r.scope IS NOT DISTINCT FROM w.scope AND r.i = w.i + 1)) "
    "SELECT scope, entity, video_id FROM w WHERE kept"
)
def entity_cap(spark, d):
    """At most three new videos a channel and query, first come first served (a refused video may go to a later query)."""
    v = videos(spark, d, "matched_queries", "channel").select("video_id", F.col("channel").alias("scope"), F.posexplode("matched_queries").alias("pos", "entity"))
    return W.entity_cap(v.withColumn("o", F.concat_ws("|", "pos", "video_id")), "scope", "entity", "video_id", "o", 3).select("scope", "entity", "video_id")
