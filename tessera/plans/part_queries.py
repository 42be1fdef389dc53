"""Queries over the small parts: filters, pattern builders, string and number expressions, scopes, design matrices."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import numbers as D
from tessera.functions import text as X
from tessera.operators import gates, joins, providers, ranking, records, topics
from tessera.operators import windows as W
from tessera.plans.registry import Registry
from tessera.plans.table_queries import ISSUES, LISTINGS, MOT, VIDEOS, issues, listings, mot, videos
from tessera.plans.text_queries import _TOK, COMPLAINTS, _tokens, complaints, documents
from tessera.session import read

query = Registry()


# -- filters


@query(f"WITH {LISTINGS} SELECT listing_id, NOT coalesce(mileage_km > 200000, false) AS broad, NOT coalesce(mileage_km > 200000, false) AND slug LIKE 'a%' AS strict FROM lst")
def metadata_predicates(spark, d):
    """Broad and strict predicates of a specification with an open field; flagged rows are out of both."""
    l = listings(spark, d, "mileage_km", "slug").withColumn("is_flagged", F.col("mileage_km") > 200_000).withColumn("initial", F.substring("slug", 1, 1))
    broad, strict = gates.metadata_filter({"initial": "a", "mileage_km": None})
    return l.select("listing_id", broad.alias("broad"), strict.alias("strict"))


@query(f"WITH {LISTINGS} SELECT listing_id FROM lst WHERE NOT (coalesce(fuel_types[1], '') NOT IN ('', 'unknown', 'diesel')) AND NOT coalesce(len(years) > 0 AND len([y FOR y IN years IF abs(y - 2015) <= 2]) = 0 AND NOT list_contains([y IS NULL FOR y IN years], true), false)")
def hard_exclusions(spark, d):
    """Listings whose fuel doesn't conflict and of whose years one is near; what is unknown conflicts with nothing."""
    fuel = F.try_element_at("fuel_types", F.lit(1))
    far = F.coalesce(gates.far_years(F.col("years"), F.lit(2015), 2), F.lit(False))
    return listings(spark, d, "fuel_types", "years").where(~gates.differs(fuel, "diesel") & ~far).select("listing_id")


@query(f"WITH {VIDEOS}, s AS (SELECT DISTINCT video_id, s.start AS start, s.text AS text FROM (SELECT video_id, unnest(transcript_segments) AS s FROM vid)) SELECT video_id, start, length(text) AS n FROM s WHERE length(text) >= 20 AND NOT regexp_full_match(text, '\\s*(\\[[^\\]]+\\]\\s*)+')")
def admissible_segments(spark, d):
    s = videos(spark, d, "transcript_segments").select("video_id", F.inline("transcript_segments")).select("video_id", "start", "text").distinct()
    return s.where(gates.admissible(F.col("text"), 20)).select("video_id", "start", F.length("text").cast("bigint").alias("n"))


@query(f"WITH {COMPLAINTS} SELECT complaint_id FROM cmp WHERE len(regexp_extract_all(lower(description), '\\b(the|a)\\b'))::DOUBLE / greatest(CASE WHEN trim(description, ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(description, ' '), '\\s+')) END, 1) > 0.12")
def noise_dominated(spark, d):
    c = complaints(spark, d, "description").withColumn("t", F.lower("description"))
    return c.where(X.noise_dominated(F.col("t"), r"\b(the|a)\b", 0.12)).select("complaint_id")


@query(f"WITH {ISSUES} SELECT issue_id FROM iss WHERE severity IN ('medium', 'high', 'critical') AND mention_count >= 2")
def ordered_threshold(spark, d):
    i = issues(spark, d, "severity", "mention_count")
    return i.where(gates.at_least(F.col("severity"), ["low", "medium", "high", "critical"], "medium") & (F.col("mention_count") >= 2)).select("issue_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(text), 'pump') AND length(text) >= 200")
def plain_filters(spark, d):
    """Language equality, containment, least length: predicates that reach the scan."""
    return documents(spark, d, "lang", "text").where((F.col("lang") == "en") & F.contains(F.lower("text"), F.lit("pump")) & (F.length("text") >= 200)).select("doc_id")


@query(f"WITH {COMPLAINTS} SELECT complaint_id, nullif(trim(coalesce(make, ''), ' '), '') AS make, model_year AS year, nullif(trim(description[1:100], ' '), '') IS NOT NULL AS told, left(nullif(trim(description, ' '), ''), 50) AS text, 'a; b' AS parts FROM cmp")
def flat_records(spark, d):
    """Fields out of JSON records by names that vary, lists joined, long texts cut to a limit."""
    record = F.to_json(F.struct(F.col("make").alias("Manufacturer"), F.col("model_year").cast("string").alias("modelYear"), F.col("description").alias("summary"), F.array(F.lit("a"), F.lit("b")).alias("components")))
    c = complaints(spark, d, "make", "model_year", "description").select("complaint_id", record.alias("r"))
    fields = {"make": (["make", "Manufacturer"], "string"), "year": (["year", "modelYear"], "int"), "text": (["description", "summary"], "string"), "parts": (["components"], "string")}
    flat = c.select("complaint_id", *records.flat_record(F.col("r"), fields, {"text": 50}))
    return flat.select("complaint_id", "make", "year", records.joined_sections(F.col("text")).isNotNull().alias("told"), "text", "parts")


# -- joins, windows


@query(f"WITH {ISSUES}, e AS (SELECT issue_id, unnest(affected_engines) AS engine, 2010 + mention_count % 10 AS year FROM iss) SELECT issue_id, engine, engine_code FROM e JOIN engines ON year BETWEEN year_lo AND year_hi AND (engine = engine_code OR list_contains(search_alias, engine))")
def compatibility_join(spark, d):
    e = issues(spark, d, "affected_engines", "mention_count").select("issue_id", F.explode("affected_engines").alias("engine"), (F.lit(2010) + F.col("mention_count") % 10).alias("year"))
    ref = read(spark, d, "engines", "engine_code", "search_alias", "year_lo", "year_hi").withColumn("accepted", F.array_distinct(F.concat(F.array("engine_code"), "search_alias")))
    return joins.compatible(e, ref, "engine", "accepted", "year", "year_lo", "year_hi").select("issue_id", "engine", "engine_code")


@query(f"WITH {COMPLAINTS} SELECT complaint_id, least(abs(instr(description, 'pump') - instr(description, 'leak')), abs(instr(description, 'pump') - instr(description, 'km'))) <= 60 AS near FROM cmp WHERE description IS NOT NULL")
def near_spans(spark, d):
    at = lambda w: F.instr("description", w)
    span = lambda c: F.struct(c.alias("a"), c.alias("z"))
    c = complaints(spark, d, "description").where("description is not null")
    return c.select("complaint_id", joins.near_spans(F.array(span(at("leak")), span(at("km"))), at("pump"), 60).alias("near"))


@query(f"WITH {COMPLAINTS} SELECT complaint_id, printf('doc_%05d', row_number() OVER (ORDER BY date_filed NULLS FIRST, complaint_id)) AS doc FROM cmp")
def surrogate_ids(spark, d):
    """1..n in a total order, numbered range by range."""
    ranked = W.global_rank(complaints(spark, d, "date_filed"), "n", F.col("date_filed"), F.col("complaint_id"))
    return ranked.select("complaint_id", F.format_string("doc_%05d", "n").alias("doc"))


@query(f"WITH {MOT}, g AS (SELECT make, test_result, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY make) AS gamma FROM mot WHERE make IS NOT NULL AND test_result IS NOT NULL GROUP BY 1, 2) SELECT make, test_result, round(gamma, 9) AS gamma FROM g QUALIFY row_number() OVER (PARTITION BY make ORDER BY gamma DESC, CASE test_result WHEN 'PASS' THEN 0 ELSE length(test_result) END) = 1")
def dominant_category(spark, d):
    n = mot(spark, d, "make", "test_result").where("make is not null and test_result is not null").groupBy("make", "test_result").agg(F.count("*").alias("n"))
    g = n.select("make", F.when(F.col("test_result") == "PASS", 0).otherwise(F.length("test_result")).alias("topic"), "test_result", (F.col("n") / F.sum("n").over(Window.partitionBy("make"))).alias("gamma"))
    names = g.select("make", "topic", "gamma", "test_result")
    best = topics.dominant(g, "make")
    return best.join(names, ["make", "topic", "gamma"]).select("make", "test_result", F.round("gamma", 9).alias("gamma"))


# -- patterns and strings


@query(
    f"WITH {LISTINGS} SELECT listing_id, regexp_matches(lower(raw_text), '(^|[^\\p{{L}}\\p{{N}}])2[.,]0\\s*(l|lt|litre)?[\\s_-]*sorbek($|[^\\p{{L}}\\p{{N}}])') AS code, regexp_matches(lower(raw_text), '(^|[^\\p{{L}}\\p{{N}}])one[\\s-]*owner($|[^\\p{{L}}\\p{{N}}])') AS alias, regexp_matches(lower(raw_text), '\\bservice\\s+book\\b') AS phrase, regexp_matches(lower(raw_text), '\\b(petrol|diesel)\\b') AS word FROM lst WHERE raw_text IS NOT NULL"
)
def built_patterns(spark, d):
    """Patterns built from a code, an alias, a phrase and a list of words."""
    l = listings(spark, d, "raw_text").where("raw_text is not null")
    has = lambda p: F.col("raw_text").rlike(p)
    return l.select("listing_id", has(X.displacement_pattern("2.0_Sorbek")).alias("code"), has(X.alias_pattern("one owner")).alias("alias"), has(X.flexible_pattern("service book")).alias("phrase"), has(X.one_of(["petrol", "diesel"])).alias("word"))


@query(f"WITH {LISTINGS} SELECT listing_id, trim(regexp_replace('see ' || raw_text, '\\s+', ' ', 'g')) AS text FROM lst WHERE raw_text IS NOT NULL")
def stripped_text(spark, d):
    """Links, quoted blocks, quoted lines and control characters taken out."""
    noisy = F.concat(F.lit("[quote author=x]old\n words[/quote]> older\nsee http://x.example/a?b=1 \x01"), F.col("raw_text"), F.lit("\x07 www.y.example"))
    return listings(spark, d, "raw_text").where("raw_text is not null").select("listing_id", X.strip_urls(X.sanitise(X.strip_quotes(noisy))).alias("text"))


@query("SELECT * FROM (VALUES ('generation', 'mk7'), ('generation', 'mk 7'), ('generation', 'mk-7'), ('generation', 'mark 7'), ('generation', 'mkvii'), ('generation', 'mk vii'), ('generation', 'gen 7'), ('generation', '7th gen'), ('generation', '7th generation'), ('others', 'mk7.5'), ('others', 'mk 7.5'), ('others', 'mk-7.5'), ('others', 'mark 7.5'), ('others', 'gen 7.5'), ('before_facelift', '2013'), ('after_facelift', '2014'), ('years', '2013'), ('years', '2014'), ('names', 'ilmo')) t(kind, token)")
def scope_tokens(spark, d):
    t = X.scope_tokens(["Ilmo"], "MK7", (2013, 2014), 2014, ["MK7.5"])
    return spark.createDataFrame([(k, x) for k, xs in t.items() for x in xs], "kind string, token string")


@query(
    f"WITH {ISSUES}, t AS (SELECT issue_id, lower(affected_years) AS t, [y::INT FOR y IN regexp_extract_all(affected_years, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:$|[^0-9])', 1)] || [y::INT FOR y IN regexp_extract_all(affected_years, '[0-9][^0-9]((?:19|20)[0-9][0-9])(?:$|[^0-9])', 1)] AS ys FROM iss) SELECT issue_id, CASE WHEN regexp_matches(t, '\\b(pre|before|until|up to)\\b') THEN 1990 ELSE list_min(ys) END AS lo, CASE WHEN regexp_matches(t, '\\b(post|after|since|from|onwards?)\\b|\\+') THEN 2030 ELSE list_max(ys) END AS hi FROM t WHERE len(ys) > 0"
)
def phrase_windows(spark, d):
    i = issues(spark, d, "affected_years").select("issue_id", D.phrase_window(F.col("affected_years")).alias("w")).where("w is not null")
    return i.select("issue_id", "w.lo", "w.hi")


@query("SELECT * FROM (VALUES (1, 30000, 'range'), (2, 216000, 'medium'), (3, 125000, 'medium'), (4, 126000, 'high'), (5, 94450, 'high'), (6, 239890, 'high'), (7, NULL, NULL), (8, 120000, 'range')) t(id, km, confidence)")
def mileage_forms(spark, d):
    """Every form in which a mileage is written, one each."""
    forms = ["30-40 bin km", "done 216k", "125 bin", "126.000 kilometrede", "kilometre: 94450", "Mileage = 239890", "no figure", "120,000 - 130,000 km"]
    df = spark.createDataFrame([(k + 1, t) for k, t in enumerate(forms)], "id int, t string")
    return df.select("id", D.mileage_km(F.col("t")).alias("m")).select("id", F.col("m.km").cast("int").alias("km"), "m.confidence")


# -- scopes, models, providers


@query(
    f"WITH {ISSUES}, t AS (SELECT *, lower(concat_ws(' ', label, symptom, cause)) AS t FROM iss) SELECT issue_id, CASE WHEN regexp_matches(t, 'pump|thermostat') OR regexp_matches(t, 'gearbox|clutch') THEN list_concat(CASE WHEN regexp_matches(t, 'pump|thermostat') THEN ['cooling'] ELSE [] END, CASE WHEN regexp_matches(t, 'gearbox|clutch') THEN ['gearbox'] ELSE [] END) ELSE ['all'] END AS scopes, CASE WHEN system_component IN ('cooling', 'engine', 'timing') THEN affected_engines ELSE [] END AS engines FROM t"
)
def issue_scopes(spark, d):
    i = issues(spark, d, "label", "symptom", "cause", "system_component", "affected_engines")
    blob = X.text_blob(F.col("label"), F.col("symptom"), F.col("cause"))
    return i.select("issue_id", ranking.scopes(blob, [("cooling", "pump|thermostat"), ("gearbox", "gearbox|clutch")], "all").alias("scopes"), ranking.scoped(F.col("affected_engines"), F.col("system_component"), ["cooling", "engine", "timing"]).alias("engines"))


@query(
    f"WITH {MOT}, f AS (SELECT test_id, coalesce(fuel_type, 'unknown') AS f FROM mot) SELECT test_id, 'test_mileage' AS feature, coalesce(test_mileage, (SELECT quantile_cont(test_mileage, 0.5) FROM mot))::DOUBLE AS value FROM mot UNION ALL SELECT test_id, 'fuel_type=' || f, 1 FROM f WHERE f <> (SELECT min(f) FROM f)"
)
def design_matrix(spark, d):
    return topics.design_matrix(mot(spark, d, "test_mileage", "fuel_type"), "test_id", ["test_mileage"], ["fuel_type"])


@query(f"WITH {MOT} SELECT level, round(avg(test_mileage), 6) AS mileage, count(*) AS n FROM mot, (VALUES ('petrol'), ('diesel')) l(level) GROUP BY 1")
def counterfactual_levels(spark, d):
    """All tests as if of one fuel, then of the other."""
    m = mot(spark, d, "test_mileage", "fuel_type")
    both = topics.counterfactual(m, "fuel_type", "petrol").unionByName(topics.counterfactual(m, "fuel_type", "diesel"))
    return both.groupBy(F.col("fuel_type").alias("level")).agg(F.round(F.avg("test_mileage"), 6).alias("mileage"), F.count("*").alias("n"))


@query(
    f"WITH {COMPLAINTS}, s AS (SELECT complaint_id, description, unnest(regexp_split_to_array(regexp_replace(description, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM cmp WHERE description IS NOT NULL AND description <> '') SELECT complaint_id, 'ok' AS status, count(*) FILTER (regexp_matches(lower(s), '\\b(pump|clutch)') AND regexp_matches(lower(s), '\\b(leak|overheat)')) AS found FROM s GROUP BY 1 UNION ALL SELECT complaint_id, 'empty', NULL FROM cmp WHERE coalesce(description, '') = ''"
)
def extracted_issues(spark, d):
    """Issues that the offline extractor finds in every complaint, several complaints a call."""
    answers = providers.call(complaints(spark, d, "description"), "complaint_id", "description", providers.rule_extractor(["leak", "overheat"], ["pump", "clutch"]))
    return answers.select("complaint_id", "status", F.json_array_length("answer").cast("bigint").alias("found"))


#: The 2.5th percentile of 500 evenly spaced quantiles of the normal law: rank 12.475 between the 13th and the 14th.
_LOW = NormalDist().inv_cdf(12.5 / 500) * 0.525 + NormalDist().inv_cdf(13.5 / 500) * 0.475


@query(f"WITH {MOT}, g AS (SELECT make, fuel_type, avg(test_mileage) AS m, stddev_samp(test_mileage) / sqrt(count(test_mileage)) AS se FROM mot WHERE fuel_type IS NOT NULL GROUP BY 1, 2) SELECT make, fuel_type, round(m, 3) AS estimate, round(m + {_LOW!r} * se, 3) AS ci_lower, round(m - {_LOW!r} * se, 3) AS ci_upper FROM g")
def simulated_effects(spark, d):
    e = topics.simulated_effects(mot(spark, d, "make", "fuel_type", "test_mileage").where("fuel_type is not null"), "make", "fuel_type", "test_mileage")
    return e.select("make", "fuel_type", *[F.round(c, 3).alias(c) for c in ("estimate", "ci_lower", "ci_upper")])


@query(
    f"WITH {MOT}, m AS (SELECT test_mileage::DOUBLE AS y, coalesce(test_year, (SELECT quantile_cont(test_year, 0.5) FROM mot WHERE test_mileage IS NOT NULL))::DOUBLE AS x FROM mot WHERE test_mileage IS NOT NULL), s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) AS syy, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, count(*) AS n FROM m) SELECT 'test_year' AS feature, round(b, 2) AS estimate, round(sqrt((syy - b * sxy) / (n - 2) / sxx), 2) AS std_error, abs(b / sqrt((syy - b * sxy) / (n - 2) / sxx)) > 1.96 AS significant FROM s"
)
def linear_effects(spark, d):
    """How the mileage moves with the year of the test, with its standard error."""
    e = topics.linear_effects(mot(spark, d, "test_mileage", "test_year").withColumn("test_year", F.col("test_year").cast("double")), "test_mileage", ["test_year"], [])
    return e.where("feature = 'test_year'").select("feature", F.round("estimate", 2).alias("estimate"), F.round("std_error", 2).alias("std_error"), "significant")


@query("WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, n FROM g QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC) = 1")
def dominant_ties(spark, d):
    g = read(spark, d, "customer", "c_nationkey", "c_mktsegment").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return topics.dominant_ties(g, "c_nationkey", "c_mktsegment", "n")


@query(
    f"WITH {_TOK}, t AS (SELECT complaint_id, w, CASE WHEN component IS NULL OR complaint_id % 10 = 0 THEN -1 ELSE length(component) END AS topic FROM tok WHERE w <> ''), n AS (SELECT topic, w, count(*) AS n FROM t WHERE topic >= 0 GROUP BY 1, 2), o AS (SELECT w, sum(n) AS a FROM n GROUP BY 1), m AS (SELECT sum(n)::DOUBLE / count(DISTINCT topic) AS m FROM n), sc AS (SELECT topic, w, n::DOUBLE / sum(n) OVER (PARTITION BY topic) * ln(1 + m / a) AS score FROM n JOIN o USING (w), m), b AS (SELECT complaint_id, topic, sum(score) AS s FROM (SELECT complaint_id, w FROM t WHERE topic < 0) x JOIN sc USING (w) GROUP BY 1, 2), best AS (SELECT complaint_id, topic FROM b QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY round(s, 12) DESC, topic) = 1) SELECT DISTINCT t.complaint_id, CASE WHEN t.topic < 0 THEN coalesce(best.topic, -1) ELSE t.topic END AS topic FROM t LEFT JOIN best USING (complaint_id)"
)
def reassigned_outliers(spark, d):
    """Every tenth complaint and those without a component are outliers, which go to the topic of the likest words."""
    topic = F.when(F.col("component").isNull() | (F.col("complaint_id") % 10 == 0), -1).otherwise(F.length("component"))
    return topics.reassigned(_tokens(spark, d).withColumn("topic", topic), "complaint_id", "topic", "w")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS topic, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE b.vec_id % 100 = 0) SELECT vec_id, CASE WHEN s >= 0.1 THEN topic ELSE -1 END AS topic FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, topic) = 1")
def guided_topics(spark, d):
    """Vectors under the nearest of some seed topics, or under none."""
    v = read(spark, d, "embeddings", "vec_id", "embedding")
    return topics.guided(v, "embedding", v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("topic"), "embedding"), 0.1).select("vec_id", "topic")


@query(f"WITH {_TOK}, c AS (SELECT complaint_id, component, w, count(*) AS n FROM tok WHERE w <> '' AND component IS NOT NULL GROUP BY 1, 2, 3), h AS (SELECT *, round_even(n * 0.5, 0)::BIGINT AS held FROM c), b AS (SELECT component, w, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY component) AS beta FROM c GROUP BY 1, 2) SELECT round(sum(held * ln(beta)) / sum(held), 9) AS log_likelihood FROM h JOIN b USING (component, w) WHERE held > 0")
def held_out_likelihood(spark, d):
    """Held-out likelihood of words under the distributions of their components."""
    c = _tokens(spark, d).where("component is not null").groupBy("complaint_id", "component", "w").agg(F.count("*").alias("n"))
    gamma = c.select("complaint_id", F.col("component").alias("topic"), F.lit(1.0).alias("gamma")).distinct()
    n = c.groupBy(F.col("component").alias("topic"), F.col("w").alias("term")).agg(F.sum("n").alias("n"))
    beta = n.select("topic", "term", (F.col("n") / F.sum("n").over(Window.partitionBy("topic"))).alias("beta"))
    return topics.held_out_likelihood(gamma, beta, topics.held_out(c, "n", 0.5), "complaint_id", "w").select(F.round("log_likelihood", 9).alias("log_likelihood"))


@query("WITH k AS (SELECT thread_name, date_trunc('month', posted_at) AS part, string_agg(text, ' ' ORDER BY posted_at, doc_id) AS text, count(*) AS m FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> '' AND thread_name IS NOT NULL GROUP BY 1, 2) SELECT CASE WHEN regexp_matches(lower(text), 'pump') THEN 'pump' WHEN regexp_matches(lower(text), 'clutch') THEN 'clutch' ELSE 'other' END AS class, count(*) AS parts, sum(m)::BIGINT AS messages, round(avg(CASE WHEN length(text) > 500 THEN 2 ELSE 1 END), 6) AS mean_focus FROM k GROUP BY 1")
def forum_statistics(spark, d):
    """Messages to statistics in one plan: gate, threads by month, focus, class."""
    from tessera.plans.pipelines import forum_statistics as composed

    docs = documents(spark, d, "thread_name", "text", "posted_at").where("thread_name is not null")
    verdict = gates.cascade([("empty", F.col("text").isNull() | (F.trim("text") == ""), False)])
    out = composed(docs, "thread_name", ["posted_at", "doc_id"], "text", verdict, F.when(F.length("text") > 500, 2).otherwise(1), [("pump", "pump"), ("clutch", "clutch")], F.date_trunc("month", "posted_at"))
    return out.withColumn("mean_focus", F.round("mean_focus", 6))


@query()
def consolidated_issues(spark, d):
    """Issues of a component merged by a cascade of bounded calls (checked against the cascade on one machine in the tests)."""
    return providers.consolidate(issues(spark, d, "label", "system_component"), "issue_id", "system_component", "label", providers.rule_merger(0.6))
