"""Queries that write with a sink, read back with a source, and must give the table again; and the readers of pages and services."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.functions import nested as N
from tessera.functions import text as X
from tessera.operators import gates
from tessera.plans.registry import Registry
from tessera.plans.table_queries import ISSUES, LISTINGS, VIDEOS, issues, listings, mot, videos
from tessera.plans.text_queries import COMPLAINTS, complaints
from tessera.session import read, workspace
from tessera.sources import paged, readers, sinks

query = Registry()


# -- nested documents, JSON lines, CSV


@query(f"WITH {VIDEOS} SELECT video_id, title, channel, duration_seconds, transcript_status = 'ok' AS usable, coalesce(len(transcript_segments), 0) AS segments, list_sum([s.start FOR s IN coalesce(transcript_segments, [])]) AS starts FROM vid WHERE transcript_status IS NOT NULL")
def corpus_round_trip(spark, d):
    """Nested documents of some hundred videos each, written as text and read back in the two sides."""
    path = workspace(spark, "corpus")
    v = videos(spark, d, "title", "channel", "duration_seconds", "transcript_status", "transcript_segments").where("transcript_status is not null")
    docs = v.groupBy(F.pmod(F.xxhash64("video_id"), F.lit(max(1, v.count() // 300))).alias("part")).agg(F.to_json(F.struct(F.struct(F.lit(1).alias("version")).alias("meta"), F.collect_list(F.struct(*v.columns)).alias("videos"))).alias("value"))
    docs.write.partitionBy("part").text(path)
    ok, rest = readers.video_corpus(spark, f"{path}/*")
    both = ok.withColumn("usable", F.lit(True)).unionByName(rest.withColumn("usable", F.lit(False)))
    segments = F.coalesce("transcript_segments", F.array().cast(readers.SEGMENTS))
    return both.select("video_id", "title", "channel", "duration_seconds", "usable", F.size(segments).alias("segments"), F.when(F.size(segments) > 0, F.aggregate(segments, F.lit(0.0), lambda a, s: a + s["start"])).alias("starts"))


@query(f"WITH {ISSUES} SELECT issue_id, label, mention_count FROM iss")
def json_lines_round_trip(spark, d):
    """JSON lines in order, broken lines among them, the first path missing."""
    path = workspace(spark, "jsonl")
    sinks.ordered_json(issues(spark, d, "label", "mention_count"), f"{path}/good", "issue_id")
    issues(spark, d).select(F.concat(F.lit('{"issue_id": "'), "issue_id")).write.text(f"{path}/broken")
    lines = spark.read.text([f"{path}/good", f"{path}/broken"])
    lines.write.text(f"{path}/all")
    return readers.json_lines(spark, "issue_id string, label string, mention_count int", f"{path}/none", f"{path}/all").where("issue_id is not null")


@query(f"WITH {ISSUES} SELECT DISTINCT 'https://v.example/' || video_id AS link FROM (SELECT unnest(source_videos).video_id AS video_id FROM iss) WHERE video_id IS NOT NULL")
def link_list_round_trip(spark, d):
    path = workspace(spark, "links")
    issues(spark, d, "source_videos").select(F.explode("source_videos.video_id").alias("v")).where("v is not null").select(F.concat(F.lit("https://v.example/"), "v").alias("link")).write.json(path)
    return readers.link_list(spark, path).select("link")


@query(f"WITH {COMPLAINTS} SELECT 'complaints' AS source, complaint_id::VARCHAR AS id, make AS name, model_year::VARCHAR AS year, description AS text FROM cmp UNION ALL SELECT 'engines', engine_code, make, year_lo::VARCHAR, NULL FROM engines")
def csv_union_round_trip(spark, d):
    """All-text CSV with columns found by tolerant names, in one table with another source; a missing source and a missing column."""
    path = workspace(spark, "csv")
    c = complaints(spark, d, "make", "model_year", "description").select(F.col("complaint_id").alias("ODI Number"), F.col("make").alias("MakeText"), F.col("model_year").alias("ModelYear"), F.col("description").alias("CDescr"))
    sinks.text_csv(c, path)
    got = readers.text_csv(spark, path, {"id": ["odi*"], "name": ["make*"], "year": ["*year*"], "text": ["description", "cdescr"], "none": ["zzz"]}).drop("none")
    engines = read(spark, d, "engines", "engine_code", "make", F.col("year_lo").cast("string").alias("year"))
    return readers.aligned_union(("complaints", got, {}), ("gone", None, {}), ("engines", engines, {"engine_code": "id", "make": "name"})).select("source", "id", "name", "year", "text")


@query("SELECT test_id::VARCHAR AS test_id, max(make) AS make, max(test_mileage)::VARCHAR AS test_mileage FROM mot_tests GROUP BY 1 HAVING contains(coalesce(max(make), ''), 'a')")
def pipe_round_trip(spark, d):
    """Gzipped files separated by pipes, sniffed and filtered while read."""
    path = workspace(spark, "pipe")
    sinks.text_csv(mot(spark, d, "make", "test_mileage"), path, sep="|", compression="gzip")
    return readers.sniffed_csv(spark, path, F.contains("make", F.lit("a"))).select("test_id", "make", "test_mileage")


@query(f"WITH {ISSUES} SELECT issue_id, CASE WHEN warning_signs IS NULL THEN NULL ELSE to_json(warning_signs)::VARCHAR END AS warning_signs, mention_count::VARCHAR AS mention_count FROM iss")
def flat_csv_round_trip(spark, d):
    """Nested columns as JSON text in CSV."""
    path = workspace(spark, "flat")
    sinks.json_and_csv(issues(spark, d, "warning_signs", "mention_count"), f"{path}/json", f"{path}/csv")
    return spark.read.option("header", True).option("escape", '"').csv(f"{path}/csv")


@query("SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(search_alias) AS w FROM engines) WHERE trim(w) <> ''")
def lexicon_round_trip(spark, d):
    """A lexicon file with remarks and repeated words."""
    path = workspace(spark, "lexicon")
    words = read(spark, d, "engines", "search_alias").select(F.explode("search_alias").alias("value")).select(F.lower("value").alias("value"))
    words.unionAll(words).unionAll(spark.createDataFrame([("# remark",), ("",)], "value string")).write.text(path)
    return spark.createDataFrame([(w,) for w in readers.lexicon_file(spark, path)], "word string")


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey::VARCHAR, r_name FROM region")
def workbook_round_trip(spark, d):
    """Two sheets of a workbook, read back sheet by sheet."""
    path = workspace(spark, "book") + ".xlsx"
    sinks.workbook(spark, {"nations": read(spark, d, "nation", "n_nationkey", "n_name"), "regions": read(spark, d, "region", "r_regionkey", "r_name")}, path)
    regions = readers.workbook(spark, path, "regions").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return readers.workbook(spark, path, "nations").unionByName(regions)


# -- stores


_UPSERT = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders"


@query(_UPSERT)
def upsert_round_trip(spark, d):
    """A store partitioned by priority; later rows of two priorities replace those of equal key, the other partitions aren't rewritten."""
    path = workspace(spark, "upsert")
    o = read(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    sinks.upsert(o, path, "o_orderkey", "o_orderpriority")
    sinks.upsert(o.where("o_orderkey % 3 = 0 and o_orderpriority in ('1-URGENT', '2-HIGH')").withColumn("o_orderstatus", F.lit("X")), path, "o_orderkey", "o_orderpriority")
    return spark.read.parquet(path)


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 2)")
def collections_round_trip(spark, d):
    """Some partitions of a vector store that was rebuilt, a collection that doesn't exist among them."""
    path = workspace(spark, "vectors")
    v = read(spark, d, "embeddings", "vec_id", "embedding", "label")
    sinks.upsert(v.where("label = 9"), path, "vec_id", "label", rebuild=True)
    sinks.upsert(v, path, "vec_id", "label", rebuild=True)
    none = readers.table_or_empty(spark, "no_such_collection", "vec_id bigint, label int")
    return readers.partitions_of(spark, path, "label", [1, 2, 99]).select("vec_id", "label").unionByName(none)


@query(f"WITH {VIDEOS}, t AS (SELECT title, min(video_id) AS v FROM vid WHERE title IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (cached) AS cached, count(*) FILTER (NOT cached) AS embedded FROM (SELECT title, (title LIKE '%problem%') AS cached FROM t)")
def embedding_cache_round_trip(spark, d):
    """Titles whose vectors are cached are not embedded again; each other title once."""
    from tessera.operators.vectors import hashed_embedding

    titles = videos(spark, d, "title").where("title is not null").select("title").distinct()
    embed = lambda df: hashed_embedding(df, F.col("title"))
    path = workspace(spark, "cache")
    embed(titles.where(F.contains("title", F.lit("problem"))).withColumn("text_hash", F.sha2("title", 256))).drop("title").write.parquet(path)
    old, new = readers.embedding_cache(titles.unionAll(titles).distinct(), spark.read.parquet(path), "title", embed)
    return old.agg(F.count("*").alias("cached")).crossJoin(new.agg(F.count("*").alias("embedded")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 NOT IN (0, 1)")
def finished_keys_round_trip(spark, d):
    """Keys that two earlier runs marked as done are left out."""
    path = workspace(spark, "done")
    o = read(spark, d, "orders", "o_orderkey")
    sinks.mark_done(o.where("o_orderkey % 7 = 0"), path, "o_orderkey")
    sinks.mark_done(sinks.still_to_do(o, path, "o_orderkey").where("o_orderkey % 7 in (0, 1)"), path, "o_orderkey")
    return sinks.still_to_do(o, path, "o_orderkey")


@query("SELECT r.run_ts, o_orderstatus, count(*) AS n FROM orders, (VALUES ('run-1'), ('run-2')) r(run_ts) GROUP BY 1, 2")
def history_round_trip(spark, d):
    path = workspace(spark, "history")
    n = read(spark, d, "orders", "o_orderstatus").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    for run in ("run-1", "run-2"):
        sinks.append_run(n, path, run)
    return spark.read.parquet(path).select(F.col("run_ts").cast("string").alias("run_ts"), "o_orderstatus", "n")


@query(f"WITH {COMPLAINTS} SELECT complaint_id, CASE WHEN description IS NULL OR trim(description, ' ') = '' THEN 'empty' WHEN length(description) < 200 THEN 'short' ELSE 'kept' END AS reason FROM cmp")
def split_round_trip(spark, d):
    """Accepted and rejected rows in two tables, the rejected ones with their reason."""
    path = workspace(spark, "split")
    text = F.col("description")
    verdict = gates.cascade([("empty", text.isNull() | (F.trim(text) == ""), False), ("short", F.length(text) < 200, False)])
    sinks.split_sink(gates.gate(complaints(spark, d, "description"), verdict), f"{path}/kept", f"{path}/rejected", ["complaint_id"])
    return spark.read.parquet(f"{path}/kept").select("complaint_id", F.lit("kept").alias("reason")).unionByName(spark.read.parquet(f"{path}/rejected"))


@query(f"WITH {ISSUES}, n AS (SELECT coalesce(severity, 'none') AS severity, count(*) AS n FROM iss GROUP BY 1) SELECT '# Issues' AS line UNION ALL SELECT '- rows: ' || sum(n) FROM n UNION ALL SELECT '## severity' UNION ALL SELECT '| severity | n |' UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || severity || ' | ' || n || ' |' FROM n")
def report_lines(spark, d):
    """The lines of a Markdown report over counts."""
    n = issues(spark, d, "severity").groupBy(F.coalesce("severity", F.lit("none")).alias("severity")).agg(F.count("*").alias("n"))
    text = sinks.report("Issues", {"rows": n.agg(F.sum("n")).first()[0]}, {"severity": n.orderBy("severity")})
    return spark.createDataFrame([(line,) for line in text.split("\n") if line], "line string")


# -- services, crawls, pages, subtitles


@query("SELECT n_regionkey::VARCHAR AS value, n_nationkey, n_name FROM nation")
def paged_service(spark, d):
    """A service that gives a region's nations two a page, read with one task a region; regions that it doesn't know are skipped."""
    path = workspace(spark, "rest")
    rows = read(spark, d, "nation", "n_regionkey", "n_nationkey", "n_name").orderBy("n_nationkey").limit(1000).collect()  # the reference list of nations
    values = sorted({r.n_regionkey for r in rows})
    for v in values:
        own = [{"n_nationkey": r.n_nationkey, "n_name": r.n_name} for r in rows if r.n_regionkey == v]
        for k in range(0, len(own), 2):
            sinks.put_text(spark, f"{path}/{v}-{k}.json", json.dumps({"results": own[k : k + 2]}))
    paged.register(spark)
    url = path if "://" in path else f"file://{path}"
    options = {"url": url + "/{value}-{offset}.json", "values": ",".join(map(str, [*values, 77])), "pagesize": "2", "attempts": "1", "missing": "skip"}
    got = spark.read.format("rest").options(**options).load()
    return got.select("value", F.from_json("record", "n_nationkey int, n_name string").alias("r")).select("value", "r.n_nationkey", "r.n_name")


@query("SELECT 'region/' || r_regionkey AS url, 0 AS depth FROM region UNION ALL SELECT 'nation/' || n_nationkey, 1 FROM nation UNION ALL SELECT 'customer/' || c_custkey, 2 FROM customer")
def crawl_links(spark, d):
    """Pages reached from the regions, breadth first; pages also link back, so that a round without news ends it."""
    url = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c))
    n = read(spark, d, "nation", "n_regionkey", "n_nationkey").select(url("region", "n_regionkey").alias("a"), url("nation", "n_nationkey").alias("b"))
    c = read(spark, d, "customer", "c_nationkey", "c_custkey").select(url("nation", "c_nationkey").alias("a"), url("customer", "c_custkey").alias("b"))
    links = n.unionAll(c)
    links = links.unionAll(links.select("b", "a"))
    seeds = read(spark, d, "region", "r_regionkey").select(url("region", "r_regionkey").alias("url"))
    return paged.crawl(seeds, lambda frontier: frontier.join(links, frontier["url"] == links["a"]).select(F.col("b").alias("url")))


def _html(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query(f"WITH {COMPLAINTS} SELECT complaint_id, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS post FROM cmp WHERE length(trim(regexp_replace(description, '\\s+', ' ', 'g'))) >= 10")
def page_posts(spark, d):
    """Posts out of forum pages: the second selector finds them; quotations and repeats are dropped."""
    body = _html(F.col("description"))
    html = F.concat(F.lit("<html><div class='nav'>menu</div><div class='post a'><blockquote>said before</blockquote>"), body, F.lit("</div><div class='post'>"), body, F.lit("</div><script>x()</script></html>"))
    pages = complaints(spark, d, "description").where("description is not null").select("complaint_id", html.alias("html"))
    posts = readers.page_blocks(pages, "html", [("article", "message"), ("div", "post")])
    return posts.select("complaint_id", F.explode("posts").alias("post"))


@query(f"WITH {LISTINGS} SELECT listing_id, mileage_km::VARCHAR AS km, slug AS kind, 'https' AS scheme FROM lst")
def page_record(spark, d):
    """A listing's fields out of its page: list entries first, then table rows, then JSON-LD."""
    cell = lambda c: _html(F.coalesce(F.col(c).cast("string"), F.lit("")))
    html = F.concat(
        F.lit("<ul><li><strong>Km</strong><span>"), cell("mileage_km"), F.lit("</span></li></ul><table><tr><th>Kind</th><td>"), cell("slug"),
        F.lit('</td></tr></table><script type="application/ld+json">{"additionalProperty": [{"name": "Km", "value": "0"}, {"name": "Scheme", "value": "https"}]}</script>'),
    )
    rows = readers.page_fields(listings(spark, d, "mileage_km", "slug").select("listing_id", html.alias("html")), "html")
    field = lambda k: F.nullif(F.element_at("fields", k), F.lit(""))
    return rows.select("listing_id", field("Km").alias("km"), field("Kind").alias("kind"), field("Scheme").alias("scheme"))


@query(f"WITH {LISTINGS} SELECT listing_id, 2014 AS year, coalesce(mileage_km, 0)::BIGINT AS km, (100000 + listing_id)::VARCHAR AS id, 'car-2014-' || coalesce(mileage_km, 0) || '-km' AS slug, 'https://ex.com/Ad/car-2014-' || coalesce(mileage_km, 0) || '-km-' || (100000 + listing_id) AS url, listing_id % 2 = 0 AS blocked FROM lst WHERE coalesce(mileage_km, 0) BETWEEN 10 AND 999999")
def listing_links(spark, d):
    """Canonical links, ids, slugs and what a slug tells where the page can't be had; pages that ask for a login."""
    km = F.coalesce("mileage_km", F.lit(0))
    address = F.concat(F.lit("/Ad/car-2014-"), km, F.lit("-km-"), F.col("listing_id") + 100000)
    l = listings(spark, d, "mileage_km").where(km.between(10, 999_999)).withColumn("url", X.canonical_url(F.concat(F.lit("HTTPS://Ex.com"), address, F.lit("?sid=99&utm_source=x#top"))))
    s = readers.slug_fields(F.col("url"))
    blocked = readers.blocked_page(F.lit("t"), F.when(F.col("listing_id") % 2 == 0, F.concat(F.repeat(F.lit("x "), F.lit(40_000)), F.lit("Access denied"))).otherwise("fine"), F.col("url"), ["access denied"])
    return l.select("listing_id", s["year"].alias("year"), s["km"].alias("km"), X.url_id(F.col("url")).alias("id"), X.url_slug(F.col("url")).alias("slug"), "url", blocked.alias("blocked"))


@query(f"WITH {VIDEOS}, s AS (SELECT video_id, unnest(transcript_segments) AS s FROM vid) SELECT video_id, trim(regexp_replace(s.text, '\\s+', ' ', 'g')) AS text, floor(s.start * 1000) / 1000 AS start, floor(s.duration * 1000) / 1000 AS duration FROM s WHERE trim(regexp_replace(s.text, '\\s+', ' ', 'g')) <> ''")
def subtitle_segments(spark, d):
    """Segments out of json3 subtitles; events without text are left out."""
    event = lambda s: F.struct(F.floor(s["start"] * 1000).alias("tStartMs"), F.floor(s["duration"] * 1000).alias("dDurationMs"), F.array(F.struct(s["text"].alias("utf8"))).alias("segs"))
    v = videos(spark, d, "transcript_segments").where("transcript_segments is not null")
    doc = F.to_json(F.struct(F.concat(F.transform("transcript_segments", event), F.array(F.struct(F.lit(5).cast("bigint").alias("tStartMs"), F.lit(None).cast("bigint").alias("dDurationMs"), F.lit(None).cast("array<struct<utf8:string>>").alias("segs")))).alias("events")))
    return v.select("video_id", F.inline(readers.subtitles(doc)))


@query(f"WITH {LISTINGS} SELECT listing_id, raw_text AS page_text, 'a <b> ' || listing_id AS text FROM lst")
def visible_text(spark, d):
    """Text of pages: scripts, frames and tags dropped, entities read; JSON that may stand inside a script."""
    html = F.concat(F.lit("<html><script>var a='<p>';</script><nav>menu</nav><p>"), _html(F.col("raw_text")), F.lit("</p><footer>end</footer></html>"))
    safe = X.script_safe_json(F.struct(F.concat(F.lit("a <b> "), "listing_id").alias("t")))
    l = listings(spark, d, "raw_text")
    return l.select("listing_id", X.html_to_text(html).alias("page_text"), F.when(~F.contains(safe, F.lit("<")), N.json_object(safe, "t string")["t"]).alias("text"))


@query("SELECT n_nationkey, n_name FROM nation")
def explorer_page(spark, d):
    """The rows that an HTML page holds, read out of it again."""
    path = workspace(spark, "page") + ".html"
    sinks.explorer(spark, "Nations & <more>", {"nation": read(spark, d, "nation", "n_nationkey", "n_name")}, path)
    page = spark.read.text(path, wholetext=True)
    found = F.regexp_extract("value", r'(?s)data-name="nation">(.*?)</script>', 1)
    return page.select(F.inline(F.from_json(found, "array<struct<n_nationkey:int,n_name:string>>")))


@query("SELECT * FROM (VALUES ('names', 'Ilmo, Ilmo 2'), ('engines.1.code', '1.4_Vextor'), ('engines.1.km', '120000'), ('engines.2.code', '2.0_Vextor')) t(key, value)")
def scaffold_lines(spark, d):
    """A description found by the words of its name, as lines for a prompt."""
    path = workspace(spark, "scaffold")
    sinks.put_text(spark, f"{path}/ilmo_mk7.yaml", "names: [Ilmo, Ilmo 2]\nempty: ''\nengines:\n- {code: 1.4_Vextor, km: 120000}\n- {code: 2.0_Vextor}\n")
    text = readers.scaffold_summary(readers.scaffold(path, "my_ilmo_mk7_car"))
    return spark.createDataFrame([tuple(line.split(": ", 1)) for line in text.split("\n")], "key string, value string")


@query("SELECT run, stage, status, (SELECT count(*) FROM nation) AS n FROM (VALUES (1, 'copy', 'ok'), (1, 'count', 'ok'), (2, 'copy', 'up_to_date'), (2, 'count', 'up_to_date'), (3, 'copy', 'skipped_by_resume'), (3, 'count', 'ok'), (4, 'copy', 'failed'), (4, 'count', 'not_reached'), (5, 'copy', 'skipped_by_user'), (5, 'count', 'up_to_date')) t(run, stage, status)")
def staged_runs(spark, d):
    """A run of two stages: fresh, up to date, resumed by force, failing, with a stage skipped."""
    from tessera.plans.pipelines import Stage, run_stages

    path = workspace(spark, "stages")
    copy = Stage("copy", lambda s: read(s, d, "nation").write.mode("overwrite").parquet(f"{path}/copy"), f"{path}/copy", [f"{d}/nation.parquet"])
    count = Stage("count", lambda s: s.read.parquet(f"{path}/copy").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/count"), f"{path}/count", [f"{path}/copy"])

    def broken(s):
        raise OSError("no service")

    runs = [
        run_stages(spark, [copy, count], f"{path}/1.json"), run_stages(spark, [copy, count], f"{path}/2.json"), run_stages(spark, [copy, count], f"{path}/3.json", resume_from="count", force=True),
        run_stages(spark, [Stage("copy", broken, f"{path}/none"), count], f"{path}/4.json"), run_stages(spark, [copy, count], f"{path}/5.json", skip=["copy"]),
    ]
    rows = spark.createDataFrame([(k + 1, r["stage"], r["status"]) for k, run in enumerate(runs) for r in run], "run int, stage string, status string")
    return rows.crossJoin(F.broadcast(spark.read.parquet(f"{path}/count").limit(1)))
