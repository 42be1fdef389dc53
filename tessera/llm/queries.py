"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import canonical, chunking, language, leakage, lookalikes, neardup, packing, sentences, turns
from tessera.session import cut, once, read, spread


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Documents with the columns asked for; doc_id is unique, so no key has to be looked for twice."""
    return spread(read(spark, d, "documents", "doc_id", *columns))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d, "text").select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("rec_id"), "text")
    complaints = once(read(spark, d, "complaints", "complaint_id", "description"), "complaint_id")
    complaints = complaints.select(F.lit("complaints").alias("src"), F.col("complaint_id").cast("string").alias("rec_id"), F.col("description").alias("text"))
    return chunking.split_oversized(docs.unionByName(complaints), "text", only_oversized=True)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Document texts and complaint descriptions over 1,200 characters, and whether a cut had to be forced."""
    return _pieces(spark, d).where("piece_no = 1 and pieces > 1").select("src", "rec_id", F.when(F.col("forced"), "forced").otherwise("boundary").alias("kind"))


def p1_cuts(spark: SparkSession, d: str) -> DataFrame:
    """What the cuts of all oversized texts fall on, and how even their pieces are: pieces, mean and deviation of their sizes."""
    size = F.col("end_char") - F.col("start_char")
    return _pieces(spark, d).groupBy("src", "cut").agg(F.count("*").alias("pieces"), F.avg(size).alias("mean_size"), F.stddev_pop(size).alias("sd_size"), F.max(size).alias("most"), F.avg("overlap").alias("mean_overlap"))


_FAULT = ("label", "symptom", "cause")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of issues whose label, symptom and cause overlap by 0.7 or more."""
    issues = read(spark, d, "issues", "issue_id", *_FAULT)  # repeated rows agree in these columns and are one record
    return neardup.similar_pairs(issues, "issue_id", *_FAULT, threshold=0.7).select(F.col("id_lo").alias("issue_lo"), F.col("id_hi").alias("issue_hi"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of issues that describe the same fault, for every issue."""
    issues = read(spark, d, "issues", "issue_id", *_FAULT)
    return neardup.groups(issues, "issue_id", *_FAULT, threshold=0.7).withColumnRenamed("id", "issue_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The engine that each entered value means, or UNMATCHED, and the engines that complaints mention."""
    reference = canonical.names(read(spark, d, "engines"))
    context = once(read(spark, d, "engine_year_context", "ctx_id", "engine"), "ctx_id").select(
        F.lit("engine_year_context").alias("src"), F.col("ctx_id").cast("string").alias("rec_id"), F.lit(0).alias("pos"), F.col("engine").alias("value")
    )
    listings = once(read(spark, d, "listings", "listing_id", "engines"), "listing_id").select(
        F.lit("listings").alias("src"), F.col("listing_id").cast("string").alias("rec_id"), F.posexplode("engines").alias("pos", "value")
    )
    complaints = once(read(spark, d, "complaints", "complaint_id", "description"), "complaint_id").select(
        F.lit("complaints").alias("src"), F.col("complaint_id").cast("string").alias("rec_id"), F.lit(0).alias("pos"), "description"
    )
    values = canonical.resolve_values(context.unionByName(listings), "value", reference)
    mentions = canonical.resolve_mentions(complaints, "description", reference)
    columns = ["src", "rec_id", "pos", "engine_code"]
    return values.select(*columns).unionByName(mentions.select(*columns))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The entered values that fit no engine, with how often each was entered."""
    reference = canonical.names(read(spark, d, "engines"))
    context = once(read(spark, d, "engine_year_context", "ctx_id", "engine"), "ctx_id").select(F.col("engine").alias("value"))
    listings = once(read(spark, d, "listings", "listing_id", "engines"), "listing_id").select(F.explode("engines").alias("value"))
    return canonical.unmatched(canonical.resolve_values(context.unionByName(listings), "value", reference), "value")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents, and of videos by title, that differ but look the same."""
    docs = lookalikes.look_alike_pairs(_documents(spark, d, "text"), id="doc_id", text="text")
    videos = lookalikes.look_alike_pairs(once(read(spark, d, "videos", "video_id", "title"), "video_id"), id="video_id", text="title")
    pairs = lambda df, src: df.select(F.lit(src).alias("src"), F.col("id_lo").cast("string").alias("id_lo"), F.col("id_hi").cast("string").alias("id_hi"))
    return pairs(docs, "documents").unionByName(pairs(videos, "videos"))


#: What stands between quotation marks.
_QUOTED = r'[“„«"「『‚‹]([^“”„«»"「」『』‚‹›]+)[”“»"」』›]'


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """The class of look-alikes and its canonical member for every document text, document title, quoted passage (pos from 1) and video title."""
    field = lambda name, value, pos=0: F.struct(F.lit(name).alias("field"), F.lit(pos).alias("pos") if isinstance(pos, int) else pos.alias("pos"), value.alias("value"))
    quotes = F.transform(F.coalesce(F.regexp_extract_all("text", F.lit(_QUOTED), F.lit(1)), F.array().cast("array<string>")), lambda q, i: field("quote", q, i + 1))
    docs = _documents(spark, d, "text", "title").select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("rec_id"), F.inline(F.concat(F.array(field("text", F.col("text")), field("title", F.col("title"))), quotes)))
    videos = once(read(spark, d, "videos", "video_id", "title"), "video_id").select(F.lit("videos").alias("src"), F.col("video_id").alias("rec_id"), F.lit("title").alias("field"), F.lit(0).alias("pos"), F.col("title").alias("value"))
    found = lookalikes.classes(docs.unionByName(videos), "value")
    return found.select("src", "rec_id", "field", "pos", F.lower(F.hex("text_class")).alias("text_class"), F.col("text_class_canonical").alias("canonical"))


def _video_texts(spark: SparkSession, d: str) -> DataFrame:
    """Title and spoken words of each video, as the paragraphs of one text."""
    videos = once(read(spark, d, "videos", "video_id", "title", "video_language", "transcript_text", "transcript_segments"), "video_id")
    spoken = F.array_join(F.transform("transcript_segments", lambda s: s["text"]), " ")
    spoken = F.regexp_replace(F.coalesce(F.nullif(spoken, F.lit("")), "transcript_text"), r"\[[^\]]*\]|\([^)]*\)|<[^>]*>|♪[^♪]*♪|\*[^*]*\*|[0-9:.,]{4,}", " ")
    return videos.select("video_id", "video_language", F.concat_ws("\n\n", "title", spoken).alias("text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of documents and videos whose label is missing or wrong, or that are in several languages."""
    classifier = language.train(read(spark, d, "lang_samples"))
    docs = language.wrongly_labelled(_documents(spark, d, "text", "lang"), "doc_id", "text", "lang", classifier)
    videos = language.wrongly_labelled(_video_texts(spark, d), "video_id", "text", "video_language", classifier, one=True)
    return docs.select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("rec_id"), "lang").unionByName(
        videos.select(F.lit("videos").alias("src"), F.col("video_id").alias("rec_id"), "lang")
    )


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    """The languages of every document and the language of every video, whatever their label, with a confidence; a text without a sentence that holds letters has none."""
    classifier = language.train(read(spark, d, "lang_samples"))
    docs = language.wrongly_labelled(_documents(spark, d, "text", "lang"), "doc_id", "text", "lang", classifier, every=True)
    videos = language.wrongly_labelled(_video_texts(spark, d), "video_id", "text", "video_language", classifier, one=True, every=True)
    return docs.select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("rec_id"), "lang", "confidence").unionByName(
        videos.select(F.lit("videos").alias("src"), F.col("video_id").alias("rec_id"), "lang", "confidence")
    )


def p5_video_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every video's stretches of one language in title and transcript, with a confidence."""
    classifier = language.train(read(spark, d, "lang_samples"))
    return language.segments(_video_texts(spark, d).select("video_id", "text"), "text", classifier)


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every document's stretches of one language, with a confidence."""
    classifier = language.train(read(spark, d, "lang_samples"))
    return language.segments(_documents(spark, d, "text"), "text", classifier)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every speaker turn of every transcript."""
    videos = once(read(spark, d, "videos", "video_id", "transcript_segments"), "video_id")
    return turns.turns(videos, read(spark, d, "speakers")).select("video_id", "turn_no", "speaker_id", "start_ms")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of 1,024 tokens of every document text, or of each piece of a larger one."""
    sized = packing.token_counts(_documents(spark, d, "text"), "text")
    return packing.pack(cut(sized.select("doc_id", "tokens")), "doc_id", capacity=1024)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation item."""
    found = leakage.leaks(_documents(spark, d, "text"), read(spark, d, "eval_items", "item_id", "text"))
    return found.select("doc_id", "item_id")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an edited passage of an item: windows of 24 words of shingle similarity 0.8 or more."""
    return leakage.leaks(_documents(spark, d, "text"), read(spark, d, "eval_items", "item_id", "text"), size=24, radius=7, similarity=0.8)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document."""
    return sentences.sentences(_documents(spark, d, "text"), "text").select("doc_id", "sent_no", "end_char")


QUERIES = {"p1_found": p1_found, "p1_cuts": p1_cuts, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_unmatched": p3_unmatched, "p4_found": p4_found, "p4_forms": p4_forms, "p5_found": p5_found, "p5_languages": p5_languages, "p5_segments": p5_segments, "p5_video_segments": p5_video_segments, "p7_found": p7_found, "p8_containers": p8_containers, "p9_found": p9_found, "p9_near": p9_near, "p10_found": p10_found}

def _mapped_sql(text: str) -> str:
    """The look-alike map in DuckDB, from the same tables."""
    one, drop, many = lookalikes.tables()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    keys = sorted(one)
    out = f"translate({text}, {quoted(''.join(keys) + drop)}, {quoted(''.join(one[k] for k in keys))})"
    for k, v in sorted(many.items()):
        out = f"replace({out}, {quoted(k)}, {quoted(v)})"
    return out


def _consistent_sql(text: str) -> str:
    """The consistent form in DuckDB: composition by NFC in place of a collation."""
    return f"nfc_normalize({_mapped_sql(text)})"


_WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RUN = rf"[^{_WHITE}.!?。！？।…]"

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_FIGURE = "(zero|one|two|three|four|five|six|seven|eight|nine|oh|nought)"
_AS_FIGURE = "(list_position(['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'], {0}) - 1)"

_BLANK = r"(value IS NULL OR regexp_full_match(value, '[\s\p{Z}\p{Cf}]*'))"
_LITRE = "(?:l|lt|ltr|liters?|litres?)"
_BETWEEN_SQL = rf"(?:[\s_-]|\b{_LITRE}\b|turbo)*"
_SIZE = rf"((?:\b[0-9]{{3,5}}\s*(?:ccm|cc|cm3|cm³|cubic cent[a-z]+))|(?:\b[0-9]\s*[.,]\s*[0-9](?:\s*{_LITRE}\b)?)|(?:\b{_FIGURE}\s+(?:point|dot|comma)\s+{_FIGURE})|(?:\b{_FIGURE}\s+and\s+a\s+half)|(?:\b(?:{_FIGURE}|[0-9])\s*-?\s*{_LITRE}\b))".replace("(zero|", "(?:zero|")
_SLIP = """abs(length(w) - length(name)) <= 1 AND damerau_levenshtein(w, name) <= 1
 AND (length(w) <= length(name) OR list_contains([name[1:i] || name[i:i] || name[i + 1:] FOR i IN range(1, length(name) + 1)], w))"""
_VALUES = rf"""t AS (SELECT value, lower(replace(translate(value, '{_WIDE[0]}', '{_WIDE[1]}'), '_', ' ')) AS t FROM v WHERE value IS NOT NULL),
z AS (SELECT *, [replace(replace(x, ' ', ''), ',', '.') FOR x IN regexp_extract_all(t, '(?:^|[^0-9.,])([0-9]\s*[.,]\s*[0-9])(?:[^0-9]|$)', 1)]
  || [x || 'cc' FOR x IN regexp_extract_all(t, '(?:^|[^0-9.,])([0-9]{{3,5}})\s*(?:ccm|cc|cm3|cm³|cubic cent)', 1)]
  || CASE WHEN regexp_matches(t, '{_FIGURE}\s+(point|dot|comma)\s+{_FIGURE}') THEN [{_AS_FIGURE.format(f"regexp_extract(t, '{_FIGURE}[ ]+(point|dot|comma)', 1)")} || '.' || coalesce({_AS_FIGURE.format(f"regexp_extract(t, '(point|dot|comma)[ ]+{_FIGURE}', 2)")}, 0)]
    WHEN regexp_matches(t, '{_FIGURE}\s+and\s+a\s+half') THEN [{_AS_FIGURE.format(f"regexp_extract(t, '{_FIGURE}[ ]+and', 1)")} || '.5']
    WHEN regexp_matches(t, '\b{_FIGURE}\s*-?\s*(l|lt|ltr|liters?|litres?)\b') THEN [{_AS_FIGURE.format(f"regexp_extract(t, '{_FIGURE}[ ]*-?[ ]*l', 1)")} || '.0']
    WHEN regexp_matches(t, '(^|[^0-9.,])[0-9]\s*-?\s*(l|lt|ltr|liters?|litres?)\b') THEN [regexp_extract(t, '([0-9])\s*-?\s*l', 1) || '.0'] ELSE [] END AS sizes FROM t),
w AS (SELECT value, sizes, unnest(regexp_extract_all(t, '\p{{L}}+')) AS w FROM z),
e AS (SELECT engine_code, [regexp_extract(engine_code, '^[0-9][.][0-9]'), displacement_cc || 'cc'] AS own, lower(regexp_extract(engine_code, '_(.*)$', 1)) AS name, false AS alone FROM engines
 UNION ALL SELECT engine_code, [regexp_extract(engine_code, '^[0-9][.][0-9]'), displacement_cc || 'cc'], lower(a), true FROM (SELECT engine_code, displacement_cc, unnest(search_alias) AS a FROM engines) WHERE NOT regexp_matches(a, '[0-9]')),
hit AS (SELECT DISTINCT value, engine_code FROM w JOIN e ON {_SLIP}
 WHERE CASE WHEN len(sizes) > 0 THEN list_has_any(sizes, own) ELSE alone END)"""

ORACLE = {
    "p1_found": rf"""
WITH t AS (SELECT DISTINCT 'documents' AS src, doc_id::VARCHAR AS rec_id, text FROM documents
 UNION ALL SELECT DISTINCT 'complaints', complaint_id::VARCHAR, description FROM complaints)
SELECT src, rec_id, CASE WHEN regexp_matches(text, '{_RUN}{{601}}{_RUN}{{600}}') THEN 'forced' ELSE 'boundary' END AS kind
FROM t WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) > 1200
""",
    "p2_found": r"""
WITH t AS (SELECT issue_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', label, symptom, cause)), '[\p{L}\p{N}]+')) AS w
 FROM (SELECT DISTINCT ON (issue_id) issue_id, label, symptom, cause FROM issues))
SELECT a.issue_id AS issue_lo, b.issue_id AS issue_hi FROM t a JOIN t b ON a.issue_id < b.issue_id AND len(a.w) >= 0.7 * len(b.w) AND len(b.w) >= 0.7 * len(a.w)
WHERE len(list_intersect(a.w, b.w)) >= 0.7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AND len(a.w) > 0
""",
    "p2_groups": r"""
WITH RECURSIVE t AS (SELECT issue_id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', label, symptom, cause)), '[\p{L}\p{N}]+'))) AS w
 FROM (SELECT DISTINCT ON (issue_id) issue_id, label, symptom, cause FROM issues)),
s AS (SELECT w, min(issue_id) AS first, count(*) AS copies FROM t WHERE len(w) > 0 GROUP BY w),
e AS (SELECT a.first AS a, b.first AS b FROM s a JOIN s b ON a.first <> b.first AND len(a.w) >= 0.7 * len(b.w) AND len(b.w) >= 0.7 * len(a.w)
 WHERE len(list_intersect(a.w, b.w)) >= 0.7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
r(a, b) AS (SELECT first, first FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a AS first, min(b) AS "group" FROM r GROUP BY a), l AS (SELECT a AS first, count(*) AS links FROM e GROUP BY a)
SELECT issue_id, "group", copies, coalesce(links, 0) AS links FROM t JOIN s USING (w) JOIN g USING (first) LEFT JOIN l USING (first)
UNION ALL SELECT issue_id, issue_id, 1, 0 FROM t WHERE len(w) = 0
""",
    # a value or a text names one engine at most, so no ranking is needed: a word within one slip of a name, beside the right displacement
    "p3_unmatched": rf"""
WITH v AS (SELECT value, count(*) AS n FROM (SELECT engine AS value FROM (SELECT DISTINCT ctx_id, engine FROM engine_year_context) UNION ALL SELECT unnest(engines) FROM (SELECT DISTINCT ON (listing_id) * FROM listings)) GROUP BY 1),
{_VALUES}
SELECT value, n FROM v WHERE NOT {_BLANK} AND value NOT IN (SELECT value FROM hit)
""",
    "p3_found": rf"""
WITH src AS (SELECT DISTINCT 'engine_year_context' AS src, ctx_id::VARCHAR AS rec_id, 0 AS pos, engine AS value FROM engine_year_context
 UNION ALL SELECT 'listings', listing_id::VARCHAR, unnest(range(len(engines)))::INT, unnest(engines) FROM (SELECT DISTINCT ON (listing_id) * FROM listings)),
v AS (SELECT DISTINCT value FROM src),
{_VALUES},
c AS (SELECT DISTINCT complaint_id::VARCHAR AS rec_id, lower(replace(translate(description, '{_WIDE[0]}', '{_WIDE[1]}'), '_', ' ')) AS t FROM complaints WHERE description IS NOT NULL),
beside AS (SELECT rec_id, unnest(regexp_extract_all(t, '{_SIZE}{_BETWEEN_SQL}(\p{{L}}+)', 1)) AS size, unnest(regexp_extract_all(t, '{_SIZE}{_BETWEEN_SQL}(\p{{L}}+)', 2)) AS w FROM c
 UNION ALL SELECT rec_id, unnest(regexp_extract_all(t, '(\p{{L}}+){_BETWEEN_SQL}{_SIZE}', 2)), unnest(regexp_extract_all(t, '(\p{{L}}+){_BETWEEN_SQL}{_SIZE}', 1)) FROM c),
told AS (SELECT rec_id, w, [CASE WHEN regexp_matches(size, '^[0-9]{{3}}') THEN regexp_extract(size, '^[0-9]+') || 'cc' WHEN regexp_matches(size, '^[0-9]\s*[.,]') THEN size[1] || '.' || regexp_extract(size, '[.,]\s*([0-9])', 1)
  WHEN regexp_matches(size, 'point|dot|comma') THEN {_AS_FIGURE.format(f"regexp_extract(size, '^{_FIGURE}', 1)")} || '.' || coalesce({_AS_FIGURE.format(f"regexp_extract(size, '{_FIGURE}$', 1)")}, 0)
  WHEN regexp_matches(size, 'half') THEN {_AS_FIGURE.format(f"regexp_extract(size, '^{_FIGURE}', 1)")} || '.5'
  WHEN regexp_matches(size, '^[0-9]') THEN size[1] || '.0' ELSE {_AS_FIGURE.format(f"regexp_extract(size, '^{_FIGURE}', 1)")} || '.0' END] AS sizes FROM beside
 UNION ALL SELECT rec_id, unnest(regexp_extract_all(t, '\p{{L}}+')), [] FROM c),
near AS (SELECT w, engine_code, own, alone FROM (SELECT DISTINCT w FROM told) JOIN e ON {_SLIP}),
mention AS (SELECT rec_id, min(engine_code) AS engine_code FROM told JOIN near USING (w) WHERE CASE WHEN len(sizes) > 0 THEN list_has_any(sizes, own) ELSE alone END GROUP BY 1)
SELECT src, rec_id, pos, coalesce(engine_code, 'UNMATCHED') AS engine_code FROM src LEFT JOIN (SELECT value, min(engine_code) AS engine_code FROM hit GROUP BY 1) USING (value) WHERE NOT {_BLANK}
UNION ALL SELECT 'complaints', rec_id, 0, engine_code FROM mention
""",
    "p4_forms": f"""
WITH f AS (SELECT 'documents' AS src, doc_id::VARCHAR AS rec_id, 'text' AS field, 0 AS pos, text AS value FROM documents UNION ALL SELECT 'documents', doc_id::VARCHAR, 'title', 0, title FROM documents
 UNION ALL SELECT 'documents', doc_id::VARCHAR, 'quote', unnest(range(1, len(q) + 1))::INT, unnest(q) FROM (SELECT doc_id, regexp_extract_all(text, '{_QUOTED}', 1) AS q FROM documents WHERE text IS NOT NULL)
 UNION ALL SELECT 'videos', video_id, 'title', 0, title FROM (SELECT DISTINCT video_id, title FROM videos)),
m AS (SELECT *, {_mapped_sql("value")} AS m FROM f), n AS (SELECT m, nfc_normalize(m) AS k, count(*) AS n FROM m WHERE m IS NOT NULL GROUP BY m),
c AS (SELECT m, first_value(m) OVER (PARTITION BY k ORDER BY n DESC, m) AS canonical FROM n)
SELECT src, rec_id, field, pos, sha256(canonical)[1:32] AS text_class, canonical FROM m LEFT JOIN c USING (m)
""",
    "p4_found": f"""
WITH d AS (SELECT DISTINCT doc_id, text, {_consistent_sql("text")} AS c FROM documents WHERE text IS NOT NULL),
v AS (SELECT DISTINCT video_id, title, {_consistent_sql("title")} AS c FROM videos WHERE title IS NOT NULL)
SELECT 'documents' AS src, a.doc_id::VARCHAR AS id_lo, b.doc_id::VARCHAR AS id_hi FROM d a JOIN d b ON a.c = b.c AND a.doc_id < b.doc_id AND a.text <> b.text
UNION ALL SELECT 'videos', a.video_id, b.video_id FROM v a JOIN v b ON a.c = b.c AND a.video_id < b.video_id AND a.title <> b.title
""",
    "p9_found": rf"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower({_consistent_sql("text")}), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT item_id, regexp_extract_all(lower({_consistent_sql("text")}), '[\p{{L}}\p{{N}}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
eg AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)
""",
    # windows of 24 words hold 20 shingles of 5 words; pairs of windows that share one are weighed shingle by shingle
    "p9_near": rf"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(replace({_consistent_sql("text")}, 'İ', 'i̇')), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT item_id, regexp_extract_all(lower(replace({_consistent_sql("text")}, 'İ', 'i̇')), '[\p{{L}}\p{{N}}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i, n, hash(array_to_string(w[i:i + 4], ' ')) AS g, length(array_to_string(w[i:i + 4], '')) AS c FROM (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 24)),
eg AS (SELECT item_id, i AS j, n AS m, hash(array_to_string(w[i:i + 4], ' ')) AS g, length(array_to_string(w[i:i + 4], '')) AS c FROM (SELECT item_id, w, len(w) AS n, unnest(range(1, len(w) - 3)) AS i FROM e WHERE len(w) >= 24)),
dt AS (SELECT doc_id, i AS p, sum(c) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS a FROM dg WHERE doc_id IN (SELECT doc_id FROM dg JOIN eg USING (g))),
et AS (SELECT item_id, j AS v, sum(c) OVER (PARTITION BY item_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS b FROM eg),
m AS (SELECT doc_id, i, n, item_id, j, m, dg.g, dg.c FROM dg JOIN eg ON dg.g = eg.g),
x AS (SELECT doc_id, item_id, i, j, g, c, n, m, unnest(range(greatest(1, i - 19), least(i, n - 23) + 1)) AS p FROM m),
y AS (SELECT doc_id, item_id, i, j, g, c, p, unnest(range(greatest(1, j - 19), least(j, m - 23) + 1)) AS v FROM x),
t AS (SELECT doc_id, item_id, p, v, sum(k * c) AS top FROM (SELECT doc_id, item_id, p, v, g, c, least(count(DISTINCT i), count(DISTINCT j)) AS k FROM y GROUP BY ALL) GROUP BY ALL),
s AS (SELECT doc_id, item_id, p, top::DOUBLE / (a + b - top)::DOUBLE AS s FROM t JOIN dt USING (doc_id, p) JOIN et USING (item_id, v))
SELECT doc_id, item_id, count(DISTINCT p) AS words, max(s) AS similarity FROM s WHERE s >= 0.8 GROUP BY ALL
""",
}
