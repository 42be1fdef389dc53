import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import providers
from tessera.sources import paged, readers, sinks
from tessera.streaming import ingest


def write(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_video_corpus(spark, tmp_path):
    doc = {"meta": {}, "videos": [{"video_id": "a", "transcript_status": "ok", "transcript_segments": [{"text": "x", "start": 1.5, "duration": 2}]}, {"video_id": "b", "transcript_status": "disabled"}, {"video_id": "c"}]}
    ok, rest = readers.video_corpus(spark, write(tmp_path / "v.json", json.dumps(doc, indent=1)))
    assert [r.video_id for r in ok.collect()] == ["a"] and {r.video_id for r in rest.collect()} == {"b", "c"} and ok.first().transcript_segments[0].start == 1.5


def test_json_lines_and_links(spark, tmp_path):
    p = write(tmp_path / "x.jsonl", '{"a": 1}\nnot json\n{"a": 2}\n')
    assert {r.a for r in readers.json_lines(spark, "a int", str(tmp_path / "no.jsonl"), p).where("a is not null").collect()} == {1, 2}
    assert readers.json_lines(spark, "a int", str(tmp_path / "no.jsonl")).count() == 0
    links = write(tmp_path / "l.jsonl", '{"link": "b"}\n{"link": "a"}\n{"link": "b"}\n')
    assert [r.link for r in readers.link_list(spark, links).collect()] == ["b", "a"]


def test_csv(spark, tmp_path):
    p = write(tmp_path / "c.csv", "ModelYear,CDescr,miles\n2014,\"a, b\",5\n")
    r = readers.text_csv(spark, p, {"year": ["*year*"], "text": ["description", "cdescr"], "gone": ["zzz"]}).first()
    assert (r.year, r.text, r.gone) == ("2014", "a, b", None)
    p = write(tmp_path / "m.txt", "Test_ID | Make\n1|VW GOLF\n2|FORD\n")
    got = readers.sniffed_csv(spark, p).where(F.contains("make", F.lit("GOLF"))).collect()
    assert [r.test_id.strip() for r in got] == ["1"]
    a, b = spark.createDataFrame([("x", 1)], "t string, n int"), spark.createDataFrame([("y",)], "txt string")
    u = readers.aligned_union(("a", a, {"t": "txt"}), ("none", None, {}), ("b", b, {}))
    assert {(r.source, r.txt, r.n) for r in u.collect()} == {("a", "x", 1), ("b", "y", None)}
    with pytest.raises(ValueError):
        readers.aligned_union(("a", None, {}))


def test_containers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_LZMA) as z:
        z.writestr("m.csv", "h\n1\n2\n")
    got = readers.container_lines(spark, str(tmp_path / "z.zip")).orderBy("line_no").collect()
    assert [(r.member, r.line) for r in got] == [("m.csv", "h"), ("m.csv", "1"), ("m.csv", "2")]
    with gzip.open(tmp_path / "g.csv.gz", "wt") as f:
        f.write("a\n1\n")
    assert readers.sniffed_csv(spark, str(tmp_path / "g.csv.gz")).count() == 1


def test_scaffold_and_lexicon(spark, tmp_path):
    write(tmp_path / "vw_golf_mk7.yaml", "meta: {name: golf}\n")
    assert readers.scaffold(str(tmp_path), "vw_golf_mk7")["meta"]["name"] == "golf" and readers.scaffold(str(tmp_path), "my_golf_mk7_car")["meta"]["name"] == "golf"
    with pytest.raises(FileNotFoundError):
        readers.scaffold(str(tmp_path), "polo")
    assert readers.lexicon_file(spark, write(tmp_path / "w.txt", "b\n# no\n\na\nb\n")) == ["a", "b"]
    assert readers.table_or_empty(spark, "no_such_table", "a int").count() == 0


def test_subtitles_and_pages(spark):
    doc = json.dumps({"events": [{"tStartMs": 1500, "dDurationMs": 500, "segs": [{"utf8": "a"}, {"utf8": " b\n"}]}, {"tStartMs": 9}, {"tStartMs": 2000, "segs": [{"utf8": " "}]}]})
    s = spark.range(1).select(readers.subtitles(F.lit(doc)).alias("s")).first().s
    assert [(x.text, x.start, x.duration) for x in s] == [("a b", 1.5, 0.5)]
    html = '<div class="post x">Hello there <blockquote>old words</blockquote>you<br>all</div><div class="post">short</div><div class="post">HELLO there you all</div>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>no posts here at all</p>")], "id int, html string")
    got = {r.id: r.posts for r in readers.page_blocks(pages, "html", [("div", "message"), ("div", "post"), ("p", "")]).collect()}
    assert got == {1: ["Hello there you all"], 2: [], 3: ["no posts here at all"]}
    page = '<ul><li><strong>Year</strong><span>2014</span></li></ul><table><tr><td>Km</td><td>5</td></tr></table><script type="application/ld+json">{"additionalProperty": [{"name": "Year", "value": "1"}, {"name": "Fuel", "value": "gas"}]}</script>'
    f = readers.page_fields(spark.createDataFrame([(page,)], "html string"), "html").first().fields
    assert f == {"Year": "2014", "Km": "5", "Fuel": "gas"}
    r = spark.range(1).select(readers.slug_fields(F.lit("https://x.com/ilan/golf-1-4-tsi-2014-79000-km-123456")).alias("s"), readers.blocked_page(F.lit("t"), F.lit("Access Denied"), F.lit("http://x"), ["access denied"]).alias("b")).first()
    assert (r.s.year, r.s.km, r.b) == (2014, 79000, True)


def test_rest_source_and_crawl(spark, tmp_path):
    for y in (2014, 2015):
        write(tmp_path / f"{y}.json", json.dumps({"results": [{"id": y * 10 + k} for k in range(2)]}))
    paged.register(spark)
    df = spark.read.format("rest").option("url", f"file://{tmp_path}/{{value}}.json").option("values", "2014,2015,2016").option("missing", "skip").option("attempts", "1").load()
    assert {(r.value, json.loads(r.record)["id"]) for r in df.collect()} == {("2014", 20140), ("2014", 20141), ("2015", 20150), ("2015", 20151)}
    graph = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "y")], "f string, t string")
    follow = lambda frontier: frontier.join(graph, frontier.url == graph.f).select(F.col("t").alias("url"))
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in paged.crawl(seeds, follow, 100).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    assert paged.crawl(seeds, follow, 3).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], "p"), (2, None, "q")], "id int, xs array<string>, part string")
    sinks.json_and_csv(df, str(tmp_path / "j"), str(tmp_path / "c"))
    assert {r.xs for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()} == {'["a"]', None}
    store = str(tmp_path / "store")
    sinks.upsert(df, store, "id", "part")
    sinks.upsert(spark.createDataFrame([(1, ["z"], "p"), (3, ["n"], "p")], df.schema), store, "id", "part")
    assert {r.id: r.xs for r in spark.read.parquet(store).collect()} == {1: ["z"], 2: None, 3: ["n"]}
    done = str(tmp_path / "done")
    sinks.mark_done(df.where("id = 1"), done, "id")
    assert {r.id for r in sinks.still_to_do(df, done, "id").collect()} == {2} and sinks.still_to_do(df, str(tmp_path / "none"), "id").count() == 2
    sinks.append_run(df.select("id"), str(tmp_path / "runs"), "r1")
    sinks.append_run(df.select("id"), str(tmp_path / "runs"), "r2")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 4
    sinks.sheets({"s": spark.createDataFrame([("a\x01",)], "t string")}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "s")).first().t == "a"
    sinks.ordered_json(df.select("id"), str(tmp_path / "o"), "id")
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    assert sinks.evidence_name("golf", "Why? no!").startswith("golf__Why_no__") and "| id |" in sinks.report("t", {"n": 1}, {"x": df.select("id")})


def test_provider(spark):
    extract = providers.rule_extractor(["leak", "rattle"], ["water pump", "chain"])
    df = spark.createDataFrame([(1, "The water pump leaks. All fine."), (2, None), (3, "nothing")], "id int, t string")
    got = {r.id: (r.status, r.answer) for r in providers.call(df, "id", "t", extract).collect()}
    assert got[1] == ("ok", '[{"label": "water pump: leak", "evidence": "The water pump leaks."}]') and got[2] == ("empty", None) and got[3] == ("ok", "[]")

    def broken(texts):
        raise OSError

    assert {r.status for r in providers.call(df.where("id = 1"), "id", "t", broken, pause=0.0).collect()} == {"error"}
    assert providers.word_window(df.where("id = 1"), F.col("t"), 2, "w").first().w == "The water"


def test_ingest_is_exactly_once(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string").coalesce(1).write.parquet(src)
    ingest.available_files(spark, src, "id int, t string", out, ck, lambda b: b.where("id > 1"))
    ingest.available_files(spark, src, "id int, t string", out, ck, lambda b: b.where("id > 1"))
    assert [r.id for r in spark.read.parquet(out).collect()] == [2]
    spark.createDataFrame([(3, "c")], "id int, t string").coalesce(1).write.mode("append").parquet(src)
    ingest.available_files(spark, src, "id int, t string", out, ck, lambda b: b.where("id > 1"))
    assert {r.id for r in spark.read.parquet(out).collect()} == {2, 3}


def test_event_windows(spark):
    e = spark.createDataFrame([("2024-01-01 00:00:10", "k"), ("2024-01-01 00:00:50", "k"), ("2024-01-01 00:01:10", "k")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in ingest.event_counts(e, "ts", "k", "1 minute", "1 minute").collect()) == [1, 2]
