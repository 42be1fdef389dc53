import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import nested, numbers, spans, text
from tessera.operators import aggregates, dedupe, gates, graph, joins, ranking, vectors, windows


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(400, 400 + i) for i in range(1, 80)] + [(5, 5)]
    df = spark.createDataFrame([*edges, *edges[:9], (None, 3), (3, None)], "a int, b int")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert got == union_find({x for e in edges for x in e}, edges)
    assert graph.connected_components(df.where("false")).count() == 0


def test_similar_bags_and_clusters(spark):
    rng = random.Random(2)
    rows = []
    for i in range(90):
        base = rng.sample("abcdefghijklmnop", rng.randrange(0, 6))
        rows += [(f"r{len(rows) + k:03}", rng.choice(["x", "y"]), [w for w in base if rng.random() > 0.15] + rng.sample("qrst", rng.randrange(0, 2))) for k in range(rng.choice([1, 2]))]
    rows.append(("nul", "x", None))
    df = spark.createDataFrame(rows, "id string, k string, bag array<string>")
    alike = lambda a, b: len(a & b) >= 2 and (a <= b or b <= a or len(a & b) >= 0.55 * len(a | b))
    links = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[2] is not None and y[2] is not None and x[1] == y[1] and (alike(set(x[2]), set(y[2])) or (set(x[2]) == set(y[2]) and x[2]))}
    got = {r.id: r.cluster for r in dedupe.clusters(df, "id", "k", "bag").collect()}
    assert got == union_find([r[0] for r in rows], links)


def test_clusters_of_short_and_long_bags(spark):
    rng = random.Random(12)
    rows = [(f"r{i:03}", rng.choice(["x", "y", None]), rng.sample("abcdefghijklmnopqrstuvwxyz0123456789", rng.randrange(0, 10))) for i in range(150)]
    rows += [(f"s{i:03}", r[1], [t for t in r[2] if rng.random() > 0.25] + rng.sample("+-*", rng.randrange(0, 2))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "id string, k string, bag array<string>")
    for threshold, least in ((0.55, 2), (0.8, 3)):
        alike = lambda a, b: len(a & b) >= least and (a <= b or b <= a or len(a & b) >= threshold * len(a | b) - 1e-9)  # noqa: E731, B023
        links = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[1] == y[1] and ((x[1] and alike(set(x[2]), set(y[2]))) or (set(x[2]) == set(y[2]) and x[2]))}
        got = {r.id: r.cluster for r in dedupe.clusters(df, "id", "k", "bag", threshold, least).collect()}
        assert got == union_find([r[0] for r in rows], links)


def test_clusters_list_no_pairs_of_common_tokens(spark, monkeypatch):
    """Bags that share all but one token are one cluster, and the links to find it grow with the bags, not with their pairs."""
    linked = []
    monkeypatch.setattr(dedupe, "connected_components", lambda edges, a, b: linked.append(edges.count()) or graph.connected_components(edges, a, b))
    df = spark.createDataFrame([(i, "x", [f"own{i}", "timing", "chain", "leak"]) for i in range(300)], "id int, k string, bag array<string>")
    assert {r.cluster for r in dedupe.clusters(df, "id", "k", "bag").collect()} == {0}
    assert sum(linked) <= 20 * 300


def test_spans(spark):
    rng = random.Random(3)
    sets = [[(a, a + rng.randrange(4)) for a in (rng.randrange(2000, 2020) for _ in range(rng.randrange(0, 5)))] for _ in range(40)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(sets, reversed(sets)))], "i int, a array<struct<lo:int,hi:int>>, b array<struct<lo:int,hi:int>>")
    years = lambda s: {y for lo, hi in s for y in range(lo, hi + 1)}
    out = df.select("a", "b", spans.union(F.col("a")).alias("u"), spans.intersect(F.col("a"), F.col("b")).alias("n"), spans.clamp(F.col("a"), F.lit(2005), F.lit(2010)).alias("c"), spans.label(F.col("a")).alias("l"))
    for r in out.collect():
        assert years(r.u) == years(r.a) and all(x.hi + 1 < y.lo for x, y in zip(r.u, r.u[1:]))
        assert years(r.n) == years(r.a) & years(r.b) and years(r.c) == years(r.a) & set(range(2005, 2011))
        assert r.l == (None if not r.a else str(min(years(r.a))) if len(years(r.a)) == 1 else f"{min(years(r.a))}-{max(years(r.a))}") or not r.a


def test_triangulation(spark):
    s = lambda *xs: F.array(*[spans.span(F.lit(a), F.lit(b)) for a, b in xs]) if xs else F.array().cast(spans.SPANS)
    cases = [(s((2013, 2016)), s(), s(), s((2015, 2020)), "medium"), (s((2013, 2016)), s(), s((2016, 2017)), s((2010, 2020)), "high"), (s((2013, 2016)), s(), s(), s((2018, 2020)), "conflict"), (s(), s(), s(), s(), "none"), (s(), s((2014, 2014)), s(), s(), "low"), (s(), s(), s((2001, 2002)), s(), "low")]
    for own, context, titles, window, want in cases:
        assert spark.range(1).select(ranking.triangulated(own, context, titles, window).alias("t")).first().t.confidence == want


def test_folds(spark):
    seg = spark.createDataFrame([("v", float(10 * i), 10.0, "ten letters") for i in range(10)] + [("w", 0.0, 60.0, "one long"), ("w", None, 1.0, "x")], "video_id string, start double, duration double, text string")
    got = sorted((r.video_id, r.start, r.end) for r in windows.duration_windows(seg, "video_id").collect())
    assert got == [("v", 0.0, 40.0), ("v", 30.0, 70.0), ("v", 60.0, 100.0), ("w", 0.0, 60.0)]
    hits = spark.createDataFrame([("v", 0.0, 5.0, 3.0), ("v", 4.0, 8.0, 2.0), ("v", 20.0, 22.0, 1.0), ("u", 4.0, 8.0, 2.0)], "v string, a double, b double, s double")
    assert sorted((r.v, r.a) for r in windows.interval_dedupe(hits, "v", "a", "b", "s", 5.0).collect()) == [("u", 4.0), ("v", 0.0), ("v", 20.0)]
    cost = spark.createDataFrame([("k", 1, 5.0, 40), ("k", 2, 4.0, 70), ("k", 3, 3.0, 50), ("k", 4, 0.0, 1)], "k string, i int, s double, c int")
    assert [r.i for r in windows.greedy_budget(cost, "k", "s", "c", "i", 100).orderBy("i").collect()] == [1, 3]
    assert [r.batch for r in windows.greedy_batches(cost, "k", "c", "i", 115).orderBy("i").collect()] == [0, 0, 1, 1]
    firsts = spark.createDataFrame([("s", "e1", "a", 1), ("s", "e1", "b", 2), ("s", "e1", "c", 3), ("s", "e2", "c", 4), ("s", "e2", "a", 5)], "s string, e string, x string, o int")
    assert [(r.e, r.x) for r in windows.entity_cap(firsts, "s", "e", "x", "o", 2).orderBy("o").collect()] == [("e1", "a"), ("e1", "b"), ("e2", "c")]
    bags = spark.createDataFrame([("c", "1", ["a", "b"]), ("c", "2", ["a", "b", "x"]), ("c", "3", ["x", "a", "z", "b"]), ("c", "4", ["q"])], "c string, i string, t array<string>")
    assert [r.kept_id for r in windows.signature_dedupe(bags, "c", "i", "t", "i").orderBy("i").collect()] == ["1", "1", "1", "4"]
    assert windows.duration_windows(seg.where("false"), "video_id").count() == 0


def test_band_and_range_joins(spark):
    rng = random.Random(4)
    a, b = [(i, rng.randrange(0, 500)) for i in range(80)], [(i, rng.randrange(0, 500)) for i in range(60)]
    left, right = spark.createDataFrame(a, "i int, x int"), spark.createDataFrame(b, "j int, y int")
    for width in (0, 1, 30):
        got = joins.band(left, right, "x", "y", width).collect()
        assert sorted((r.i, r.j) for r in got) == sorted((i, j) for i, x in a for j, y in b if abs(x - y) <= width)
    ranges = spark.createDataFrame([(j, y, y + j) for j, y in b], "j int, lo int, hi int")
    assert sorted((r.i, r.j) for r in joins.in_range(left, ranges, "x", "lo", "hi", 16).collect()) == sorted((i, j) for i, x in a for j, y in b if y <= x < y + j)


def test_index_recall(spark, small):
    v = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in vectors.top_k(v, q, 10, "vec_id", "embedding").collect()}
    c = vectors.fit_centroids(v, "vec_id", "embedding")
    near = {(r.query_id, r.vec_id) for r in vectors.indexed_top_k(v, q, 10, "vec_id", "embedding", c).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_top_k_in_blocks_with_nulls_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((60, 4)).round(1) + 0.01
    m[10] = m[11]
    rows = [(i, x.tolist()) for i, x in enumerate(m)] + [(90, None), (None, [1.0, 0.0, 0.0, 0.0]), (91, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    q = df.where("id < 7 or id >= 90").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(vectors, "BLOCK", 12)
    got = {}
    for r in vectors.top_k(df, q, 5, "id", "v").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    for i in range(7):
        d = np.round(1 - unit @ unit[i], 6)
        assert got[i] == sorted(range(60), key=lambda j: (d[j], j))[:5]
    assert set(got) == set(range(7)) and vectors.top_k(df, q.where("false"), 5, "id", "v").count() == 0


def test_six_chunk_ranking(spark):
    """Lower tiers first; exclusions by known conflicts only."""
    rows = [("c1", "belt", "petrol", "EA", [2016], [80000], "leaks"), ("c2", "chain", "petrol", "EA", [], [], ""), ("c3", "belt", "diesel", "EA", [], [], ""), ("c4", None, "unknown", "XX", [2001], [], "leak"), ("c5", "belt", "petrol", "EA", [], [], "no leak")]
    df = spark.createDataFrame(rows, "id string, drive string, fuel string, family string, years array<int>, km array<int>, t string")
    kept = df.where(~gates.differs(F.col("drive"), "belt") & ~gates.differs(F.col("fuel"), "petrol") & ~gates.far_years(F.col("years"), F.lit(2016)))
    tier = ranking.tiered(5, [(F.exists("km", lambda k: F.abs(k - 79000) <= 20000), 3), (F.col("family") == "EA", 2), ((F.col("family") == "EA") & F.array_contains("years", 2016), 1)])
    out = kept.select("id", tier.alias("tier"), ranking.signal(F.col("t"), [r"\bleak\b"], [], [r"\bno\b"]).alias("signal")).orderBy("id").collect()
    assert [tuple(r) for r in out] == [("c1", 1, 0), ("c5", 2, 0)]


def test_gates(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, None), (3, "b", 1)], "i int, t string, n int")
    assert {r.i for r in gates.relaxed(df, F.col("n") >= 5).collect()} == {1, 2}
    assert gates.relaxed(df.where("i <> 2"), F.col("n") > 99).count() == 2
    v = gates.gate(df, gates.cascade([("none", F.col("t").isNull(), False), ("small", F.col("n") < 2, False)]))
    assert {(r.i, r.keep, r.reason) for r in v.collect()} == {(1, True, "kept"), (2, False, "none"), (3, False, "small")}
    assert {r.i for r in df.where(gates.at_least(F.col("t"), ["a", "b"], "b")).collect()} == {3}
    assert spark.range(1).select(gates.marker_only(F.lit("[a] [b]")), gates.admissible(F.lit("x" * 40))).first() == (True, True)


def test_expressions(spark):
    cases = [
        (text.squeeze(F.lit("  a \n b ")), "a b"), (text.transliterate(F.lit("ŞANZIMAN İyi")), "sanziman iyi"), (text.html_to_text(F.lit("<p>a&nbsp;<b>b</b></p><script>x</script><p>c</p>")), "a b\nc"),
        (text.canonical_url(F.lit("HTTP://Ex.Com/T?sid=1&a=2#p")), "http://ex.com/T?a=2"), (text.url_id(F.lit("http://x/a-b-1234567/detail")), "1234567"), (text.url_slug(F.lit("http://x/a-b-1234567/detail")), "a-b"),
        (text.snippet(F.lit("ab\ncd"), 3), "ab ..."), (text.sanitise(F.lit("a\x01b")), "ab"), (text.token_bag(F.array(F.lit("a")), F.array(F.lit("b"))), ["a", "b"]), (text.split_tags(F.lit("|a|b|")), ["a", "b"]),
        (text.join_compounds(F.lit("the timing  chain cover"), ["timing chain", "timing chain cover"]), "the timing_chain_cover"), (text.semantic_tokens(F.lit("Water-pump the leaks"), {"leaks": "leak"}, {"pump": ["pump", "unit"]}, ["the"]), ["water", "pump", "unit", "leak"]),
        (text.fill("{a} x {b}", a=F.lit("p"), b=F.lit(3)), "p x 3"), (F.lit("1,4 tsi ok").rlike(text.displacement_pattern("1.4_TSI")), True), (F.lit("11.4 tsi").rlike(text.displacement_pattern("1.4_TSI")), False), (F.lit("a dq-200 b").rlike(text.alias_pattern("DQ 200")), True),
        (numbers.km(F.lit("200k"), F.lit("km")), 200_000), (numbers.km(F.lit("124.000"), F.lit("miles")), 199_558), (numbers.mileage_km(F.lit("at 120-140 bin km"))["confidence"], "range"), (numbers.mileage_km(F.lit("120 bin km"))["km"], 120_000), (numbers.mileage_miles(F.lit("85k miles")), 85_000),
        (numbers.mileage_miles(F.lit("136,794 km")), 85_018), (numbers.phrase_window(F.lit("pre-2013"))["lo"], 1990), (numbers.digits_only(F.lit("1.2 M 3")), 123), (numbers.to_int(F.lit(" 1,200.7 ")), 1200), (numbers.first_year(F.lit("12 1990 2004")), 2004), (numbers.mileage_band(F.lit(65_000)), "60-90k"),
        (numbers.listing_basics(F.lit("2014 model, 2016, 110 hp, 48000 km"))["power"], 110), (nested.json_array(F.lit('```json\n[{"a": 1}]\n```'), "array<struct<a:int>>")[0]["a"], 1), (nested.json_object(F.lit('sure: {"a": 2} ok'), "a int")["a"], 2),
        (nested.merge_first(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))), {"a": "1", "b": "3"}), (nested.vector_text(F.array(F.lit(0.1), F.lit(0.25)), 2), "[0.10, 0.25]"), (nested.cleaned(F.array(F.lit(" a"), F.lit(""), F.lit("a"), F.lit(None))), ["a"]),
        (nested.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))), 1.0), (text.script_safe_json(F.struct(F.lit("</x>").alias("a"))), '{"a":"\\u003c/x\\u003e"}'), (text.noise_dominated(F.lit("up up a"), "up", 0.3), True),
    ]
    got = spark.range(1).select(*[e.alias(f"x{i}") for i, (e, _) in enumerate(cases)]).first()
    assert [x for x in got] == [want for _, want in cases]


def test_generation_tokens_and_probes():
    assert {"mk7", "mkvii", "7th gen"} <= set(text.generation_tokens("MK7")) and "mkiv" in text.generation_tokens("mk4")
    assert ranking.probes(["A b", "c"], ["a  B"], ["D"]) == ["A b", "c", "D"]


def test_threads_and_top_values(spark):
    df = spark.createDataFrame([("t", 2, "b", True, None), ("t", 1, "a", False, None), ("t", 3, "c", False, "x"), ("u", 1, "z", True, "y")], "k string, o int, m string, keep boolean, v string")
    got = {r.k: (r.m, r.n_messages) for r in aggregates.threads(df, ["k"], ["o"], "m", F.col("keep")).collect()}
    assert got == {"t": ("a b", 3), "u": ("z", 1)}
    assert {r.k: r.m for r in aggregates.threads(df, ["k"], ["o"], "m", F.col("keep"), double_first=True).collect()}["t"] == "a a b"
    assert {r.k: r.v for r in aggregates.first_known(df, ["k"], ["o"], "v").collect()} == {"t": "x", "u": "y"}
    assert {r.k: r.messages for r in aggregates.distinct_messages(df.unionAll(df), "k", "o", "m").collect()}["t"] == ["a", "b", "c"]


def test_topic_helpers(spark):
    from tessera.operators import topics

    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(3)[i % 3] * 5 + rng.normal(0, 0.1, 3)).tolist(), 1.0) for i in range(60)] + [(99, [100.0, 100.0, 100.0], 1.0)]
    df = spark.createDataFrame(rows, "id int, v array<double>, s double")
    out = topics.cluster_vectors(df, "v", 4, 5)
    assert {r.topic for r in out.where("id = 99").collect()} == {-1} and out.where("topic >= 0").select("topic").distinct().count() == 3
    assert topics.rescued_outliers(out, "v", "topic", F.col("s"), 2).count() == 61
    terms = spark.createDataFrame([(d, w, 2) for d in range(12) for w in (("a", "b", "c") if d % 2 else ("x", "y", "z"))], "doc int, term string, n int")
    assert topics.search_k(terms, "doc", "term", "n", [2, 3], top=3).count() == 2
    assert topics.number_of_topics(10) == 5 and topics.number_of_topics(10**6) == 25 and topics.varying(terms, ["doc", "n"]) == ["doc"]


def test_small_helpers(spark):
    a, b = spark.createDataFrame([("e1", 2010), ("e2", 2010)], "e string, y int"), spark.createDataFrame([("g", ["e1", "e3"], 2005, 2012)], "c string, es array<string>, lo int, hi int")
    assert [r.e for r in joins.compatible(a, b, "e", "es", "y", "lo", "hi").collect()] == ["e1"]
    r = spark.range(1).select(ranking.scopes(F.lit("diesel auto"), [("diesel", "diesel"), ("petrol", "petrol")], "all").alias("s"), ranking.by_priority(F.lit(None), F.lit("x")).alias("p"), ranking.scoped(F.array(F.lit("e")), F.lit("body"), ["engine"]).alias("v")).first()
    assert (r.s, r.p.value, r.p.source, r.v) == (["diesel"], "x", 2, [])


def test_global_rank(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(40)) for i in range(500)]
    got = windows.global_rank(spark.createDataFrame(rows, "i int, x int").repartition(5), "rank", F.desc("x"), F.col("i")).collect()
    assert [(r.i, r.x) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows, key=lambda r: (-r[1], r[0])) and {r["rank"] for r in got} == set(range(1, 501))
    assert windows.global_rank(spark.createDataFrame([], "i int"), "rank", "i").count() == 0
