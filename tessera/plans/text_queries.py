"""Queries over texts and transcripts: gates, scores, tokens, vocabularies, threads, segments, tags, numbers read from text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import numbers as D
from tessera.functions import text as X
from tessera.operators import aggregates as A
from tessera.operators import gates, joins, ranking, topics
from tessera.operators import windows as W
from tessera.plans.registry import Registry
from tessera.plans.table_queries import ISSUES, LISTINGS, VIDEOS, issues, listings, videos
from tessera.session import cut, once, read

query = Registry()

COMPLAINTS = "cmp AS (SELECT DISTINCT ON (complaint_id) * FROM complaints)"
#: ASCII vocabulary of the test texts; the operators take any.
MECHANICAL = "(pump|clutch|gasket|injector|alternator|thermostat|caliper|regulator|bearing|chain)"
SIGNAL = "(leak|overheat|rattle|vibrate|seize|grind)"


def complaints(spark, d, *columns):
    return once(read(spark, d, "complaints", "complaint_id", *columns), "complaint_id")


def documents(spark, d, *columns):
    return once(read(spark, d, "documents", "doc_id", *columns), "doc_id")


# -- gates

_WORDS = "CASE WHEN trim(t, ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(t, ' '), '\\s+')) END"
_GATE = f"""
WITH {COMPLAINTS}, t AS (SELECT complaint_id, description, lower(trim(description, ' ')) AS t, {_WORDS.replace('trim(t', 'trim(description')} AS words FROM cmp),
v AS (SELECT complaint_id, CASE
 WHEN description IS NULL OR t = '' THEN 'empty'
 WHEN regexp_full_match(t, '[0-9]+') THEN 'only_number'
 WHEN len(regexp_extract_all(t, '(warranty|dealer)')) > 1 AND NOT regexp_matches(t, '{MECHANICAL}') THEN 'warranty'
 WHEN len(regexp_extract_all(t, 'never|nobody')) / greatest(words, 1)::DOUBLE > 0.3 AND NOT regexp_matches(t, '{SIGNAL}') THEN 'noise_dominated'
 WHEN words < 3 AND regexp_matches(t, '{MECHANICAL}') THEN 'very_short_mechanical'
 WHEN words < 3 THEN 'too_short'
 WHEN words < 5 AND regexp_matches(t, '{MECHANICAL}|{SIGNAL}') THEN 'short_with_signal'
 WHEN words < 5 THEN 'short_without_signal'
 WHEN regexp_matches(t, '{MECHANICAL}') THEN 'mechanical'
 WHEN regexp_matches(t, '[0-9]\\s*(km|miles|k\\b)') THEN 'mileage'
 WHEN regexp_matches(t, '{SIGNAL}') THEN 'signal'
 WHEN words >= 8 THEN 'long_enough' ELSE 'no_signal' END AS reason FROM t)
"""


def _gated(spark, d):
    text = F.col("description")
    rules = gates.message_rules(text, MECHANICAL, SIGNAL, "(?:thanks|ok|up)", {"warranty": ("(warranty|dealer)", 1)}, X.word_count(text), X.occurrences(F.lower(text), "never|nobody"))
    return gates.gate(complaints(spark, d, "description"), gates.cascade(rules, gates.NO_SIGNAL))


@query(_GATE + "SELECT complaint_id, reason FROM v")
def message_gate(spark, d):
    return _gated(spark, d).select("complaint_id", "reason")


@query(_GATE + "SELECT reason, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM v GROUP BY 1")
def gate_histogram(spark, d):
    return gates.reasons(_gated(spark, d)).select("reason", "n", "share")


@query(
    f"WITH {VIDEOS} SELECT video_id, CASE WHEN title IS NULL OR trim(title) = '' THEN NULL WHEN regexp_matches(title, '(Skeld|Lissek)') AND NOT regexp_matches(title, '(Ilmo|Vanter)') THEN 'foreign_brand:' || lower(regexp_extract(title, '(Skeld|Lissek)', 1)) WHEN regexp_matches(title, '(Ilmo|Vanter)') AND regexp_matches(title, 'known fault') AND NOT regexp_matches(title, '(problem|review)') THEN 'wrong_generation' WHEN NOT regexp_matches(title, '(Ilmo|Vanter)') AND regexp_matches(title, '(problem|review)') THEN 'wrong_model' WHEN NOT regexp_matches(title, '(Ilmo|Vanter)') THEN 'off_topic_title' END AS reason FROM vid"
)
def title_scope(spark, d):
    return videos(spark, d, "title").select("video_id", gates.title_scope(F.col("title"), "(Ilmo|Vanter)", "(problem|review)", {"foreign_brand": "Skeld|Lissek"}, "known fault").alias("reason"))


@query(f"WITH {COMPLAINTS} SELECT complaint_id, nullif(regexp_extract(lower(concat_ws(' ', make, model, description)), '\\b(besmir|quillan|nordaq)\\b', 1), '') AS brand FROM cmp")
def cross_brand(spark, d):
    blob = X.text_blob(F.col("make"), F.col("model"), F.col("description"))
    return complaints(spark, d, "make", "model", "description").select("complaint_id", gates.contaminated(blob, ["velmora"], ["velmora", "besmir", "quillan", "nordaq"]).alias("brand"))


@query(
    f"WITH {VIDEOS}, w AS (SELECT video_id, unnest(regexp_split_to_array(lower(trim(transcript_text)), '\\s+')) AS w FROM vid WHERE transcript_status = 'ok' AND transcript_text IS NOT NULL), s AS (SELECT video_id, count(DISTINCT w) AS words, count(DISTINCT CASE WHEN regexp_matches(w, '{SIGNAL}') THEN w END) AS hits FROM w GROUP BY 1) SELECT video_id, words, hits FROM s WHERE hits::DOUBLE / words >= 0.02 OR hits >= 3"
)
def video_triage(spark, d):
    v = videos(spark, d, "transcript_status", "transcript_text").where("transcript_status = 'ok' and transcript_text is not null")
    words = v.select("video_id", F.explode(F.split(F.lower(F.trim("transcript_text")), r"\s+")).alias("w"))
    s = words.groupBy("video_id").agg(F.count_distinct("w").alias("words"), F.count_distinct(F.when(F.col("w").rlike(SIGNAL), F.col("w"))).alias("hits"))
    return s.where("hits / words >= 0.02 or hits >= 3")


# -- scores and classes


@query(
    f"WITH {COMPLAINTS}, t AS (SELECT complaint_id, lower(description) AS t FROM cmp WHERE description IS NOT NULL) SELECT complaint_id, round((2 * (contains(t, 'leak')::INT + contains(t, 'overheat')::INT) + contains(t, 'warranty')::INT + contains(t, 'dealer')::INT)::DOUBLE / greatest({_WORDS}, 1), 6) AS density FROM t"
)
def keyword_density(spark, d):
    t = complaints(spark, d, "description").where("description is not null").select("complaint_id", F.lower("description").alias("t"))
    return t.select("complaint_id", F.round(X.keyword_density(F.col("t"), ["leak", "overheat"], ["warranty", "dealer"]), 6).alias("density"))


@query(f"WITH {COMPLAINTS} SELECT complaint_id, coalesce(regexp_matches(description, 'leak')::INT, 0) + coalesce(regexp_matches(description, 'heavy rain')::INT, 0) + coalesce(regexp_matches(description, '[0-9]+ km')::INT, 0) AS hits, coalesce(len(regexp_extract_all(description, 'the ')), 0) AS n_the FROM cmp")
def pattern_hits(spark, d):
    t = F.col("description")
    return complaints(spark, d, "description").select("complaint_id", X.pattern_hits(t, ["leak", "heavy rain", "[0-9]+ km"]).alias("hits"), X.occurrences(t, "the ").alias("n_the"))


@query(f"WITH {ISSUES} SELECT issue_id, CASE WHEN regexp_matches(symptom, 'pump|thermostat|coolant') THEN 'cooling' WHEN regexp_matches(symptom, 'clutch|gearbox') THEN 'transmission' WHEN regexp_matches(symptom, 'chain|belt') THEN 'timing' ELSE 'engine_general' END AS category FROM iss")
def system_category(spark, d):
    rules = [("cooling", "pump|thermostat|coolant"), ("transmission", "clutch|gearbox"), ("timing", "chain|belt")]
    return issues(spark, d, "symptom").select("issue_id", X.first_class(F.col("symptom"), rules, "engine_general").alias("category"))


@query(f"WITH {COMPLAINTS} SELECT complaint_id, concat_ws(',', CASE WHEN regexp_matches(lower(description), 'brake|caliper') THEN 'brakes' END, CASE WHEN regexp_matches(lower(description), 'lamp|alternator') THEN 'electrics' END, CASE WHEN regexp_matches(lower(description), 'clutch|gearbox') THEN 'transmission' END) AS items FROM cmp")
def inspection_items(spark, d):
    rules = [("brakes", "brake|caliper"), ("electrics", "lamp|alternator"), ("transmission", "clutch|gearbox")]
    return complaints(spark, d, "description").select("complaint_id", F.array_join(X.all_classes(F.lower("description"), rules), ",").alias("items"))


@query("SELECT DISTINCT ON (video_id) video_id, CASE WHEN regexp_matches(lower(title), 'what to check|known fault') THEN 'list_format' ELSE 'organic' END AS kind FROM videos")
def video_kind(spark, d):
    return videos(spark, d, "title").select("video_id", X.first_class(F.lower("title"), [("list_format", "what to check|known fault")], "organic").alias("kind"))


@query(
    f"WITH {COMPLAINTS}, s AS (SELECT complaint_id, lower(description) AS t FROM cmp WHERE description IS NOT NULL), h AS (SELECT complaint_id, contains(t, 'pump')::INT + contains(t, 'clutch')::INT AS technical, contains(t, 'again')::INT AS chronic, contains(t, 'km')::INT AS hint, contains(t, 'dealer')::INT + contains(t, 'warranty')::INT AS penalty FROM s), f AS (SELECT complaint_id, technical + CASE WHEN technical > 0 THEN 2 * chronic ELSE 0 END + hint - least(penalty, 3) AS focus FROM h) SELECT complaint_id, focus, CASE WHEN focus >= 4 THEN 'high' WHEN focus >= 2 THEN 'medium' ELSE 'low' END AS bucket FROM f"
)
def focus_score(spark, d):
    has = lambda *ws: sum((F.contains(F.col("t"), F.lit(w)).cast("int") for w in ws), F.lit(0))
    t = complaints(spark, d, "description").where("description is not null").select("complaint_id", F.lower("description").alias("t"))
    f = t.select("complaint_id", ranking.focus(has("pump", "clutch"), has("again"), has("km"), [has("dealer"), has("warranty")], 3).alias("focus"))
    return f.withColumn("bucket", ranking.level(F.col("focus")))


@query(f"WITH {COMPLAINTS} SELECT make2 AS grp, count(*) AS n FROM (SELECT CASE WHEN make IS NULL OR make = '' THEN 'unknown' WHEN make IN ('Velmora', 'Ostrick') THEN 'north' WHEN make = 'Quillan' THEN 'south' ELSE 'other' END AS make2 FROM cmp) GROUP BY 1")
def group_mapping(spark, d):
    g = X.mapped_group(F.col("make"), {"Velmora": "north", "Ostrick": "north", "Quillan": "south"})
    return complaints(spark, d, "make").groupBy(g.alias("grp")).agg(F.count("*").alias("n"))


# -- strings


@query(f"WITH {COMPLAINTS} SELECT complaint_id, trim(regexp_replace(description, '[ \\n\\t]+', ' ', 'g')) AS squeezed, CASE WHEN length(line) > 40 THEN line[1:40] || '...' ELSE line END AS snippet FROM (SELECT *, regexp_replace(description, '[\\r\\n]+', ' ', 'g') AS line FROM cmp)")
def squeezed_text(spark, d):
    return complaints(spark, d, "description").select("complaint_id", X.squeeze(F.col("description")).alias("squeezed"), X.snippet(F.col("description"), 40).alias("snippet"))


@query(f"WITH {LISTINGS} SELECT listing_id, lower(translate(raw_text, 'çğıöşüâîûÇĞİIÖŞÜ', 'cgiosuaiucgiiosu')) AS ascii FROM lst")
def transliterated(spark, d):
    return listings(spark, d, "raw_text").select("listing_id", X.transliterate(F.col("raw_text")).alias("ascii"))


@query(f"WITH {LISTINGS} SELECT listing_id, CASE WHEN len(coalesce(transmissions, [])) > 0 THEN '|' || coalesce(array_to_string(transmissions, '|'), '') || '|' ELSE '' END AS tags FROM lst")
def tag_codec(spark, d):
    return listings(spark, d, "transmissions").select("listing_id", X.join_tags(F.col("transmissions")).alias("tags"))


@query("SELECT engine_code, make || ' ' || replace(engine_code, '_', ' ') || ' problems after ' || year_lo AS probe FROM engines")
def probe_templates(spark, d):
    e = read(spark, d, "engines", "engine_code", "make", "year_lo")
    return e.select("engine_code", X.fill("{make} {engine} problems after {year}", make=F.col("make"), engine=F.replace("engine_code", F.lit("_"), F.lit(" ")), year=F.col("year_lo")).alias("probe"))


@query(f"WITH {COMPLAINTS} SELECT complaint_id, regexp_replace(regexp_replace(lower(description), 'thermostat\\s+housing', 'thermostat_housing', 'g'), 'timing\\s+chain', 'timing_chain', 'g') AS text FROM cmp")
def compounds(spark, d):
    return complaints(spark, d, "description").select("complaint_id", X.join_compounds(F.lower("description"), ["timing chain", "thermostat housing"]).alias("text"))


# -- numbers read from text


@query(
    f"WITH {LISTINGS} SELECT listing_id, list_sort(list_distinct([CAST(y AS INT) FOR y IN regexp_extract_all(raw_text, ' (20[0-2][0-9])[, ]', 1)])) AS years, TRY_CAST(regexp_replace(nullif(regexp_extract(lower(raw_text), '([0-9]{{1,3}}[.,][0-9]{{3}}|[0-9]{{4,6}})\\s*(km|kilomet)', 1), ''), '[^0-9]', '', 'g') AS BIGINT) AS km FROM lst"
)
def listing_numbers(spark, d):
    t = F.col("raw_text")
    return listings(spark, d, "raw_text").select("listing_id", D.years(t, 2000, 2029).alias("years"), D.listing_basics(t)["km"].alias("km"))


@query(f"WITH {COMPLAINTS}, t AS (SELECT complaint_id, date_filed, CASE WHEN regexp_full_match(date_filed, '[0-9]{{8}}') THEN CASE WHEN date_filed[5:6]::INT BETWEEN 1 AND 12 AND date_filed[7:8]::INT BETWEEN 1 AND 31 THEN date_filed[1:4]::INT END ELSE TRY_CAST(nullif(regexp_extract(date_filed, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:$|[^0-9])', 1), '') AS INT) END AS y FROM cmp) SELECT complaint_id, TRY_CAST(nullif(regexp_replace(date_filed, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits, CASE WHEN y BETWEEN 1996 AND 2026 THEN y END AS year FROM t")
def filed_dates(spark, d):
    t = F.col("date_filed")
    return complaints(spark, d, "date_filed").select("complaint_id", D.digits_only(t).alias("digits"), D.first_year(t).alias("year"))


# -- tokens, vocabularies, topics

_TOK = f"{COMPLAINTS}, tok AS (SELECT complaint_id, component, unnest(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(description), '[^a-z\\s-]', ' ', 'g'), '(^|\\s)-+(\\s|$)', ' ', 'g')), '\\s+')) AS w FROM cmp WHERE description IS NOT NULL)"


def _tokens(spark, d):
    return complaints(spark, d, "component", "description").where("description is not null").select("complaint_id", "component", F.explode(X.tokens(F.col("description"))).alias("w"))


@query(f"WITH {_TOK}, v AS (SELECT w, sum(c)::BIGINT AS tf, count(*) AS df FROM (SELECT complaint_id, w, count(*) AS c FROM tok WHERE w <> '' GROUP BY 1, 2) GROUP BY 1) SELECT w, tf, df FROM v WHERE tf >= 3 AND df >= 2 AND df <= 0.4 * (SELECT count(DISTINCT complaint_id) FROM tok WHERE w <> '')")
def vocabulary(spark, d):
    return A.vocabulary(_tokens(spark, d), "complaint_id", "w", 3, 2, 0.4)


@query(f"WITH {_TOK}, v AS (SELECT w FROM tok WHERE w <> '' GROUP BY 1 HAVING count(*) >= 5) SELECT complaint_id, w, count(*) AS n FROM tok WHERE w IN (SELECT w FROM v) GROUP BY 1, 2")
def doc_term_matrix(spark, d):
    t = _tokens(spark, d)
    return A.doc_term(t, A.vocabulary(t, "complaint_id", "w", 5), "complaint_id", "w")


@query(
    f"WITH {COMPLAINTS}, a AS (SELECT list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(description), '[^a-z\\s-]', ' ', 'g'), '(^|\\s)-+(\\s|$)', ' ', 'g')), '\\s+'), lambda x: x <> '') AS t FROM cmp WHERE description IS NOT NULL), s AS (SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM a) WHERE w NOT IN ('the', 'a', 'and') GROUP BY 1), p AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(list_zip(t[:-2], t[2:])) AS z FROM a WHERE len(t) > 1) q, LATERAL (SELECT q.z[1] AS a, q.z[2] AS b) WHERE a NOT IN ('the', 'a', 'and') AND b NOT IN ('the', 'a', 'and') GROUP BY 1, 2 HAVING count(*) >= 3), e AS (SELECT p.a, p.b, n, x.c * y.c / (SELECT sum(c) FROM s)::DOUBLE AS e FROM p JOIN s x ON x.w = a JOIN s y ON y.w = b) SELECT a, b, n, round((n - e) / sqrt(e), 4) AS z FROM e WHERE (n - e) / sqrt(e) > 3"
)
def collocations(spark, d):
    c = complaints(spark, d, "description").where("description is not null")
    return A.collocations(c, X.tokens(F.col("description")), ["the", "a", "and"]).withColumn("z", F.round("z", 4))


_BETA = f"WITH {_TOK}, n AS (SELECT component AS topic, w AS term, count(*) AS n FROM tok WHERE w <> '' AND component IS NOT NULL GROUP BY 1, 2), beta AS (SELECT topic, term, n::DOUBLE / sum(n) OVER (PARTITION BY topic) AS beta FROM n)"


def _beta(spark, d):
    n = _tokens(spark, d).where("component is not null").groupBy(F.col("component").alias("topic"), F.col("w").alias("term")).agg(F.count("*").alias("n"))
    return n.select("topic", "term", (F.col("n") / F.sum("n").over(Window.partitionBy("topic"))).alias("beta"))


@query(
    _BETA
    + ", x AS (SELECT *, beta / sum(beta) OVER (PARTITION BY term) AS e FROM beta), r AS (SELECT *, (row_number() OVER (PARTITION BY topic ORDER BY round(beta, 12), term))::DOUBLE / count(*) OVER (PARTITION BY topic) AS f, (row_number() OVER (PARTITION BY topic ORDER BY round(e, 12), term))::DOUBLE / count(*) OVER (PARTITION BY topic) AS k FROM x) SELECT topic, term, round(1 / (0.5 / k + 0.5 / f), 6) AS frex FROM r"
)
def frex_scores(spark, d):
    b = _beta(spark, d).withColumn("beta", F.col("beta"))
    e = b.withColumn("e", F.round(F.col("beta") / F.sum("beta").over(Window.partitionBy("term")), 12)).withColumn("b", F.round("beta", 12))
    both = W.ecdf(W.ecdf(e, ["topic"], "b", "f", "term"), ["topic"], "e", "k", "term")
    return both.select("topic", "term", F.round(1 / (0.5 / F.col("k") + 0.5 / F.col("f")), 6).alias("frex"))


@query(_BETA + ", o AS (SELECT term, sum(n) AS a FROM n GROUP BY 1), s AS (SELECT sum(n)::DOUBLE / count(DISTINCT topic) AS m FROM n) SELECT topic, term, round(beta * ln(1 + m / a), 6) AS score FROM beta JOIN o USING (term), s")
def class_tfidf(spark, d):
    return topics.class_tfidf(_tokens(spark, d).where("component is not null"), "component", "w").select(F.col("component").alias("topic"), F.col("w").alias("term"), F.round("score", 6).alias("score"))


@query(
    _BETA
    + ", top AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS r FROM n QUALIFY r <= 5), d AS (SELECT DISTINCT complaint_id, w FROM tok), df AS (SELECT topic, term, count(*) AS df FROM top JOIN d ON w = term GROUP BY 1, 2), p AS (SELECT a.topic, a.term AS a, b.term AS b FROM top a JOIN top b ON a.topic = b.topic AND a.r > b.r), co AS (SELECT p.topic, p.a, p.b, count(*) AS co FROM p JOIN d x ON x.w = p.a JOIN d y ON y.w = p.b AND x.complaint_id = y.complaint_id GROUP BY 1, 2, 3) SELECT p.topic, round(sum(ln((coalesce(co, 0) + 1) / (coalesce(df, 0) + 1)::DOUBLE)), 6) AS coherence FROM p LEFT JOIN co USING (topic, a, b) LEFT JOIN df ON df.topic = p.topic AND df.term = p.b GROUP BY 1"
)
def topic_coherence(spark, d):
    t = _tokens(spark, d)
    n = t.where("component is not null").groupBy(F.col("component").alias("topic"), F.col("w").alias("term")).agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "term"))).where("r <= 5")
    return A.coherence(t.select(F.col("complaint_id").alias("doc"), F.col("w").alias("term")), top, "topic", "doc", "term", "r").withColumn("coherence", F.round("coherence", 6))


@query()
def lda_dominant_topics(spark, d):
    """The dominant topic of each complaint under a latent Dirichlet model (an approximation of the structural model)."""
    t = _tokens(spark, d)
    terms = cut(A.doc_term(t, A.vocabulary(t, "complaint_id", "w", 5, 3, 0.5), "complaint_id", "w"))
    gamma, _ = topics.lda_topics(terms, "complaint_id", "w", "n", 5)
    return topics.dominant(gamma, "complaint_id")


@query(f"WITH {_TOK}, c AS (SELECT complaint_id, w, count(*) AS n FROM tok WHERE w <> '' GROUP BY 1, 2) SELECT complaint_id, w, n, round_even(n * 0.5, 0)::BIGINT AS held, n - round_even(n * 0.5, 0)::BIGINT AS train FROM c WHERE n > 1")
def held_out_cells(spark, d):
    c = _tokens(spark, d).groupBy("complaint_id", "w").agg(F.count("*").alias("n")).where("n > 1")
    return topics.held_out(c, "n", 0.5)


@query(
    f"WITH {COMPLAINTS}, h AS (SELECT complaint_id, 'cooling' AS issue, contains(t, 'pump')::INT + contains(t, 'thermostat')::INT + contains(t, 'radiator')::INT AS hits, 3 AS total FROM (SELECT complaint_id, lower(coalesce(description, '')) AS t FROM cmp) UNION ALL SELECT complaint_id, 'brakes', contains(t, 'caliper')::INT + contains(t, 'brake pedal')::INT, 2 FROM (SELECT complaint_id, lower(coalesce(description, '')) AS t FROM cmp) UNION ALL SELECT complaint_id, 'never', contains(t, 'zzzz')::INT, 1 FROM (SELECT complaint_id, lower(coalesce(description, '')) AS t FROM cmp)), b AS (SELECT issue, max(hits) AS best, max(total) AS total FROM h GROUP BY 1), r AS (SELECT complaint_id, max((hits >= 1)::INT) AS m FROM h GROUP BY 1) SELECT round(avg((best >= 1)::INT), 6) AS recall, round(avg(best::DOUBLE / total), 6) AS coverage, round(sum(best)::DOUBLE / sum(total), 6) AS pattern_recall, (SELECT round(avg(m), 6) FROM r) AS precision FROM b"
)
def ground_truth_recall(spark, d):
    t = complaints(spark, d, "description").select("complaint_id", F.lower(F.coalesce("description", F.lit(""))).alias("t"))
    hits = joins.pattern_matrix(t, "complaint_id", "t", [("cooling", ["pump", "thermostat", "radiator"]), ("brakes", ["caliper", "brake pedal"]), ("never", ["zzzz"])])
    g = A.ground_truth(hits, "complaint_id")
    return g.select(*[F.round(c, 6).alias(c) for c in g.columns])


@query(f"WITH {COMPLAINTS}, t AS (SELECT complaint_id, lower(description) AS t FROM cmp) SELECT complaint_id, 2000 AS topic, 'lamp' AS name FROM t WHERE contains(t, 'warning lamp') UNION ALL SELECT complaint_id, 2001, 'tow' FROM t WHERE contains(t, 'tow truck') OR contains(t, 'heavy rain')")
def watchlist_topics(spark, d):
    return topics.watchlist_topics(complaints(spark, d, "description"), "complaint_id", F.col("description"), [("lamp", ["warning lamp"]), ("tow", ["tow truck", "heavy rain"])])


# -- threads and transcripts


@query("SELECT thread_name, count(*) AS n_messages, sum(length(text))::BIGINT + count(*) - 1 AS n_chars, arg_min(lang, (posted_at, doc_id)) FILTER (lang IS NOT NULL) AS first_lang FROM documents WHERE thread_name IS NOT NULL GROUP BY 1")
def thread_assembly(spark, d):
    docs = documents(spark, d, "thread_name", "text", "lang", "posted_at").where("thread_name is not null")
    parts = A.threads(docs, ["thread_name"], ["posted_at", "doc_id"], "text", part=F.date_trunc("month", "posted_at"))
    texts = parts.groupBy("thread_name").agg(F.sum("n_messages").alias("n_messages"), (F.sum(F.length("text").cast("bigint")) + F.count("*") - 1).alias("n_chars"))
    first = A.first_known(docs, ["thread_name"], ["posted_at", "doc_id"], "lang")
    return texts.join(first, "thread_name").select("thread_name", "n_messages", "n_chars", F.col("lang").alias("first_lang"))


SEGMENTS = f"{VIDEOS}, seg AS (SELECT DISTINCT video_id, s.start AS start, s.duration AS duration, s.text AS text FROM (SELECT video_id, unnest(transcript_segments) AS s FROM vid)), seg1 AS (SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY video_id, start ORDER BY text) = 1)"


def segments(spark, d):
    s = videos(spark, d, "transcript_segments").select("video_id", F.inline("transcript_segments")).distinct()
    return W.first_wins(s, ["video_id", "start"], "text")


@query(f"WITH {SEGMENTS}, b AS (SELECT *, lag(start) OVER w AS s, lag(duration) OVER w AS du, lag(regexp_matches(text, '[.!?]$')) OVER w AS e FROM seg1 WINDOW w AS (PARTITION BY video_id ORDER BY start)), g AS (SELECT *, sum(CASE WHEN s IS NULL OR start - s > 5 OR coalesce(e, false) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start) AS session FROM b) SELECT video_id, session::BIGINT AS session, count(*) AS n, min(start) AS start FROM g GROUP BY 1, 2")
def sentence_sessions(spark, d):
    g = W.sessions(segments(spark, d), ["video_id"], "start", F.col("start") - F.col("__before") > 5, breaks=F.col("text").rlike(r"[.!?]$"))
    return g.groupBy("video_id", "session").agg(F.count("*").alias("n"), F.min("start").alias("start"))


@query(f"WITH {SEGMENTS}, y AS (SELECT video_id, start, [CAST(x AS INT) FOR x IN regexp_extract_all(text, '(?:^| )(20[0-2][0-9])(?: |$)', 1)] AS ys FROM seg1) SELECT video_id, start, list_sort(list_distinct(flatten(list(ys) OVER (PARTITION BY video_id ORDER BY start ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)))) AS years FROM y")
def neighbour_years(spark, d):
    s = segments(spark, d).withColumn("ys", F.transform(F.regexp_extract_all("text", F.lit(r"(?:^| )(20[0-2][0-9])(?: |$)"), F.lit(1)), lambda x: x.cast("int")))
    return W.neighbourhood(s, ["video_id"], "start", "ys", 2, 2, "years").select("video_id", "start", "years")


@query(
    f"WITH RECURSIVE {SEGMENTS}, n AS (SELECT video_id, start AS s, start + coalesce(duration, 0) AS e, row_number() OVER (PARTITION BY video_id ORDER BY start) AS i, count(*) OVER (PARTITION BY video_id) AS n FROM seg1 WHERE start IS NOT NULL), "
    "j AS (SELECT a.video_id, a.i, a.s, min(b.i) AS j FROM n a JOIN n b ON a.video_id = b.video_id AND b.i >= a.i LEFT JOIN n c ON c.video_id = b.video_id AND c.i = b.i + 1 WHERE NOT coalesce(b.e - a.s < 35 AND c.e - a.s <= 45, false) GROUP BY 1, 2, 3), "
    "k AS (SELECT j.video_id, j.i, j.s, b.e, j.j, b.n, greatest(j.i + 1, least(j.j + 1, (SELECT min(x.i) FROM n x WHERE x.video_id = j.video_id AND x.s >= b.e - 10 AND x.i > j.i))) AS k FROM j JOIN n b ON b.video_id = j.video_id AND b.i = j.j), "
    "w AS (SELECT video_id, 0 AS chunk_no, i, s, e, j, n, k FROM k WHERE i = 1 UNION ALL SELECT k.video_id, w.chunk_no + 1, k.i, k.s, k.e, k.j, k.n, k.k FROM w JOIN k ON k.video_id = w.video_id AND k.i = w.k WHERE w.j < w.n) "
    'SELECT video_id, chunk_no::INT AS chunk_no, s AS start, e AS "end" FROM w'
)
def overlap_chunks(spark, d):
    """Chunks of 35 to 45 seconds that overlap by 10 (each start depends on the chunk before)."""
    return W.duration_windows(segments(spark, d), "video_id").select("video_id", "chunk_no", "start", "end")


@query(
    f"WITH RECURSIVE {SEGMENTS}, q AS (SELECT video_id, start, (CASE WHEN text IS NULL THEN NULL WHEN trim(text, ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, ' '), '\\s+')) END)::INT AS words, len(regexp_extract_all(lower(text), '{SIGNAL}'))::DOUBLE AS score FROM seg1), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start) AS i FROM q WHERE score > 0), "
    "w AS (SELECT video_id, start, words, score, i, words <= 60 AS kept, CASE WHEN words <= 60 THEN 60 - words ELSE 60 END AS room FROM r WHERE i = 1 UNION ALL SELECT r.video_id, r.start, r.words, r.score, r.i, r.words <= w.room, CASE WHEN r.words <= w.room THEN w.room - r.words ELSE w.room END FROM w JOIN r ON r.video_id = w.video_id AND r.i = w.i + 1) "
    "SELECT video_id, start, words, score FROM w WHERE kept"
)
def budget_sentences(spark, d):
    """Segments of most signal within 60 words a video."""
    s = segments(spark, d).select("video_id", "start", X.word_count(F.col("text")).alias("words"), X.occurrences(F.lower("text"), SIGNAL).cast("double").alias("score"))
    return W.greedy_budget(s, "video_id", "score", "words", "start", 60)


@query(
    f"WITH RECURSIVE {SEGMENTS}, r AS (SELECT video_id, start, (CASE WHEN text IS NULL THEN NULL WHEN trim(text, ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, ' '), '\\s+')) END)::INT AS words, row_number() OVER (PARTITION BY video_id ORDER BY start) AS i FROM seg1), "
    "w AS (SELECT video_id, start, words, i, 0 AS batch, words AS total FROM r WHERE i = 1 UNION ALL SELECT r.video_id, r.start, r.words, r.i, CASE WHEN w.total > 0 AND w.total + r.words > 40 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.total > 0 AND w.total + r.words > 40 THEN r.words ELSE w.total + r.words END FROM w JOIN r ON r.video_id = w.video_id AND r.i = w.i + 1) "
    "SELECT video_id, start, words, batch FROM w"
)
def greedy_batches(spark, d):
    """Batches of consecutive segments of at most 40 words."""
    s = segments(spark, d).select("video_id", "start", X.word_count(F.col("text")).alias("words"))
    return W.greedy_batches(s, "video_id", "words", "start", 40)


@query(
    f"WITH RECURSIVE {SEGMENTS}, r AS (SELECT video_id, start, start + duration AS e, duration AS score, row_number() OVER (PARTITION BY video_id ORDER BY duration DESC, start) AS i FROM seg1 WHERE duration IS NOT NULL), "
    "w AS (SELECT video_id, start, e, score, i, true AS kept, [{'a': start, 'z': e}] AS done FROM r WHERE i = 1 UNION ALL SELECT video_id, start, e, score, i, kept, CASE WHEN kept THEN list_append(done, {'a': start, 'z': e}) ELSE done END FROM (SELECT r.*, w.done, len(list_filter(w.done, lambda d: r.start - 5 < d.z AND d.a < r.e + 5)) = 0 AS kept FROM w JOIN r ON r.video_id = w.video_id AND r.i = w.i + 1)) "
    'SELECT video_id, start, e AS "end", score FROM w WHERE kept'
)
def interval_dedupe(spark, d):
    """Longest segments first, those within five seconds of a kept one left out."""
    s = segments(spark, d).where("duration is not null").select("video_id", "start", (F.col("start") + F.col("duration")).alias("end"), F.col("duration").alias("score"))
    return W.interval_dedupe(s, "video_id", "start", "end", "score", 5.0)


@query(
    f"WITH RECURSIVE {ISSUES}, t AS (SELECT issue_id, coalesce(system_component, 'none') AS component, list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(label), '[^\\p{{L}}\\s-]', ' ', 'g'), '(^|\\s)-+(\\s|$)', ' ', 'g')), '\\s+'), lambda x: x <> '')) AS s FROM iss), r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY issue_id) AS i FROM t), "
    "w AS (SELECT component, issue_id, i, issue_id AS kept_id, [{'id': issue_id, 's': coalesce(s, [])}] AS kept FROM r WHERE i = 1 UNION ALL SELECT component, issue_id, i, coalesce(hit, issue_id), CASE WHEN hit IS NULL THEN list_append(kept, {'id': issue_id, 's': s}) ELSE list_transform(kept, lambda k: {'id': k.id, 's': CASE WHEN k.id = hit THEN list_distinct(list_concat(k.s, s)) ELSE k.s END}) END "
    "FROM (SELECT r.component, r.issue_id, r.i, coalesce(r.s, []) AS s, w.kept, list_filter(w.kept, lambda k: len(coalesce(r.s, [])) > 0 AND len(list_intersect(k.s, r.s)) >= 0.45 * (len(k.s) + len(r.s) - len(list_intersect(k.s, r.s))))[1].id AS hit FROM w JOIN r ON r.component = w.component AND r.i = w.i + 1)) "
    "SELECT component, issue_id, kept_id FROM w"
)
def signature_dedupe(spark, d):
    """Issues of one component whose label words are alike, first come first kept."""
    i = issues(spark, d, "label", "system_component").select("issue_id", F.coalesce("system_component", F.lit("none")).alias("component"), X.tokens(F.col("label")).alias("tokens"))
    return W.signature_dedupe(i, "component", "issue_id", "tokens", "issue_id")


# -- tags

LEXICON = ranking.Lexicon(
    {"parts": [("pump", "pump"), ("clutch", "clutch"), ("caliper", "caliper"), ("chain", "chain")], "systems": []},
    {("parts", "systems"): {"pump": "cooling", "clutch": "transmission", "caliper": "brakes"}},
)


@query(
    f"WITH {ISSUES}, t AS (SELECT issue_id, list_filter([CASE WHEN symptom LIKE '%pump%' THEN 'pump' END, CASE WHEN symptom LIKE '%clutch%' THEN 'clutch' END, CASE WHEN symptom LIKE '%caliper%' THEN 'caliper' END, CASE WHEN symptom LIKE '%chain%' THEN 'chain' END], lambda x: x IS NOT NULL) AS parts FROM iss) SELECT issue_id, parts, list_sort([CASE x WHEN 'pump' THEN 'cooling' WHEN 'clutch' THEN 'transmission' WHEN 'caliper' THEN 'brakes' END FOR x IN parts IF x <> 'chain']) AS systems FROM t"
)
def lexicon_tags(spark, d):
    t = ranking.tag(issues(spark, d, "symptom"), F.col("symptom"), LEXICON, ["parts", "systems"], [("parts", "systems")])
    return t.select("issue_id", "parts", F.array_sort("systems").alias("systems"))


@query(f"WITH {ISSUES} SELECT count_if(symptom LIKE '%pump%') AS pump, count_if(symptom LIKE '%clutch%') AS clutch, count(*) AS n FROM iss")
def tag_coverage(spark, d):
    t = ranking.tag(issues(spark, d, "symptom"), F.col("symptom"), LEXICON, ["parts"])
    return t.agg(F.count_if(F.array_contains("parts", "pump")).alias("pump"), F.count_if(F.array_contains("parts", "clutch")).alias("clutch"), F.count("*").alias("n"))


@query(f"WITH {COMPLAINTS} SELECT complaint_id, CASE WHEN regexp_matches(lower(description), 'timing chain') THEN 'chain' WHEN regexp_matches(lower(description), 'alternator belt') THEN 'belt' END AS code FROM cmp")
def first_lexicon_match(spark, d):
    c = complaints(spark, d, "description").withColumn("t", F.lower("description"))
    return joins.first_match(c, "complaint_id", "t", [("chain", "timing chain"), ("belt", "alternator belt")]).select("complaint_id", "code")


@query(f"WITH {COMPLAINTS}, y AS (SELECT complaint_id, regexp_extract_all(description, 'in (20[0-9][0-9]) with', 1) AS ys FROM cmp WHERE description IS NOT NULL), u AS (SELECT complaint_id, y, count(*) AS n, min(i) AS i FROM (SELECT complaint_id, unnest(ys) AS y, unnest(range(len(ys))) AS i FROM y) GROUP BY 1, 2) SELECT complaint_id, arg_max(y, (n, -i)) AS year FROM u GROUP BY 1")
def token_mode(spark, d):
    c = complaints(spark, d, "description").where("description is not null").withColumn("ys", F.regexp_extract_all("description", F.lit(r"in (20[0-9][0-9]) with"), F.lit(1))).where("size(ys) > 0")
    return c.select("complaint_id", A.token_mode(F.col("ys")).alias("year"))
