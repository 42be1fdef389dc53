import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators import aggregates, gates, providers, topics, vectors, windows
from tessera.plans import pipelines
from tessera.sources import readers, sinks


def test_rows_that_cuts_would_lose(spark):
    """A marker far down a page, a vocabulary of any size, generations with a half, repeated session parameters."""
    page = F.concat(F.repeat(F.lit("x "), F.lit(60_000)), F.lit("Access denied"))
    r = spark.range(1).select(
        readers.blocked_page(F.lit("t"), page, F.lit("http://x"), ["access denied"]).alias("blocked"),
        text.canonical_url(F.lit("https://e.com/a?sid=1&utm_source=x&q=2&s=3")).alias("url"),
        *[numbers.mileage_km(F.lit(t)).alias(f"m{i}") for i, t in enumerate(["kilometre: 94450", "mileage: 239890", "216k", "125 bin", "30-40 bin km", "none", "1,234,567 km"])],
    ).first()
    assert r.blocked and r.url == "https://e.com/a?q=2"
    assert [m and (m.km, m.confidence) for m in r[2:]] == [(94450, "high"), (239890, "high"), (216000, "medium"), (125000, "medium"), (30000, "range"), None, (1234567, "high")]
    assert text.generation_tokens("MK7.5")[0] == "mk7.5" and "mkvii" not in text.generation_tokens("MK7.5")


def test_messages_are_judged_in_order(spark):
    cases = {
        None: "empty", " ": "empty", "Quote from: A on 1 May\n": "quote_only", "Quote from: A on 1 May\nthe pump leaks badly here today": "mechanical", "12": "only_number", "1.2": "only_punctuation", "https://x.y": "only_link", "...": "only_punctuation",
        "paint paint": "cosmetic", "paint on the pump": "short_with_signal", "pump": "very_short_mechanical", "hello there": "too_short", "it does leak": "short_with_signal", "nothing to say here": "short_without_signal",
        "we have driven it 500 km now": "mileage", "it began to leak again this week": "signal", "a b c d e f g h": "long_enough", "a b c d e f": "no_signal", "ok": "pure_noise", "up up up now": "noise_dominated", "up up leak": "short_with_signal",
    }
    cases["1.2"] = "too_short"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, t string")
    t = F.col("t")
    rules = gates.message_rules(t, "pump", "leak", "(?:thanks|ok)", {"cosmetic": ("paint", 0)}, text.word_count(t), text.occurrences(F.lower(t), r"\bup\b"))
    got = {r.t: r.reason for r in gates.gate(df, gates.cascade(rules, gates.NO_SIGNAL)).collect()}
    assert got == cases


def test_workbook_holds_any_text(spark, tmp_path):
    rows = [(1, "a < b & \"c\"", None), (2, " blank ", "x\x01y"), (3, "", "zwei\nZeilen"), (4, "ﬁ ü 漢", "1")]
    df = spark.createDataFrame(rows, "n int, Text string, `odd name` string")
    path = str(tmp_path / "b.xlsx")
    sinks.workbook(spark, {"first": df.limit(0), "second & last": df}, path)
    got = sorted((tuple(r) for r in readers.workbook(spark, path, "second & last").collect()), key=lambda r: r[0])
    assert got == [("1", rows[0][1], None), ("2", " blank ", "xy"), ("3", None, "zwei\nZeilen"), ("4", rows[3][1], "1")]
    assert readers.workbook(spark, path, "first").count() == 0 and readers.workbook(spark, path, "first").columns == df.columns


def test_consolidation_is_the_cascade(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    rows = [(f"r{i:03}", rng.choice("ab") if i % 9 else None, " ".join(rng.sample(words, 3))) for i in range(140)] + [(None, "a", "x"), ("r000", None, "w0")]
    merge = providers.rule_merger(0.5)

    def cascade(block):
        alive, link = sorted(block, key=lambda r: (r[1], r[0])), {}
        for shift, size, least in ((0, 10, 0), (5, 10, 30), (0, 30, 0)):
            if len(alive) <= least:
                continue
            gone = {}
            batches = {}
            for i, r in enumerate(alive):
                batches.setdefault((i + shift) // size, []).append(r)
            for b in batches.values():
                for g in merge([t for _, t in b]):
                    gone |= {b[i][0]: b[g[0]][0] for i in g[1:]}
            for k in list(link):
                link[k] = gone.get(link[k], link[k])
            link |= gone
            alive = [r for r in alive if r[0] not in gone]
        return link

    seen, blocks = set(), {}
    for k, b, t in rows:
        if k is not None and k not in seen:
            seen.add(k)
            blocks.setdefault(b or "", []).append((k, t))
    want = {k: k for k in seen}
    for b in blocks.values():
        want |= cascade(b)
    df = spark.createDataFrame(rows[:-1], "id string, b string, t string")
    got = {r.id: r.kept for r in providers.consolidate(df, "id", "b", "t", merge).collect()}
    assert got == want and len(set(got.values())) < 100


def test_calls_hold_no_more_words(spark):
    sizes = []

    def provider(texts):
        sizes.append(sum(len(t.split()) for t in texts))
        return [str(max(sizes[-1], 0)) for _ in texts]

    df = spark.createDataFrame([(i, "w " * (i % 4 + 1)) for i in range(40)] + [(99, "w " * 50), (98, None)], "id int, t string").coalesce(1)
    got = {r.id: (int(r.answer) if r.answer else None, r.status) for r in providers.call(df, "id", "t", provider, words=12).collect()}
    assert got[98] == (None, "empty") and got[99] == (50, "ok") and max(n for k, (n, _) in got.items() if k < 90) <= 12


def test_descriptions_are_asked_for_until_whole():
    answers = iter(["```yaml\na: 1\n```", ": broken : [", "a: 1\nb: {c: 2}"])
    assert providers.synthesise(["page"], "write", ["a", "b.c"], lambda texts: [next(answers)]) == {"a": 1, "b": {"c": 2}}
    with pytest.raises(ValueError):
        providers.synthesise(["page"], "write", ["a"], lambda texts: ["b: 1"])


def test_threads_in_parts_add_up(spark):
    rows = [("t", i, "m" * (i % 5 + 1)) for i in range(50)] + [("u", None, "x")]
    df = spark.createDataFrame(rows, "k string, o int, m string")
    whole = {r.k: r.m for r in aggregates.threads(df, ["k"], ["o"], "m").collect()}
    parts = aggregates.threads(df, ["k"], ["o"], "m", part=F.floor(F.col("o") / 10)).orderBy("k", F.col("part").asc_nulls_first()).collect()
    assert len(parts) == 6 and " ".join(r.m for r in parts if r.k == "t") == whole["t"]


def test_runs_resume_where_they_failed(spark, tmp_path):
    state = {"broken": True}

    def second(s):
        if state["broken"]:
            raise OSError("away")
        s.range(2).write.mode("overwrite").parquet(str(tmp_path / "two"))

    stages = [pipelines.Stage("one", lambda s: s.range(1).write.mode("overwrite").parquet(str(tmp_path / "one")), str(tmp_path / "one")), pipelines.Stage("two", second, str(tmp_path / "two"), [str(tmp_path / "one")])]
    run = lambda **k: [r["status"] for r in pipelines.run_stages(spark, stages, str(tmp_path / "m.json"), **k)]
    assert run() == ["ok", "failed"] and "away" in (tmp_path / "m.json").read_text()
    state["broken"] = False
    assert run() == ["up_to_date", "ok"] and run() == ["up_to_date", "up_to_date"] and run(force=True, skip=["one"]) == ["skipped_by_user", "ok"] and run(resume_from="two") == ["skipped_by_resume", "up_to_date"]


def test_a_batch_goes_on_after_a_failure(spark, tmp_path):
    def stages(name):
        def run(s):
            if name == "b":
                raise OSError("no " + name)
            s.range(1).write.mode("overwrite").parquet(str(tmp_path / name))

        return [pipelines.Stage("build", run, str(tmp_path / name)), pipelines.Stage("check", lambda s: s.read.parquet(str(tmp_path / name)).count(), str(tmp_path / name))]

    got = pipelines.run_batch(spark, ["a", "b", "c", "a", "d"], stages, str(tmp_path / "m"), finished=["d"])
    assert [(r["name"], r["ok"]) for r in got] == [("a", True), ("b", False), ("c", True)] and got[1]["stages"][1]["status"] == "not_reached"
    assert [r["stages"][0]["status"] for r in pipelines.run_batch(spark, ["a", "b"], stages, str(tmp_path / "m"))] == ["up_to_date", "failed"]


def test_passes_share_a_scan_and_prune(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v array<double>, g int")
    q = df.where("id < 9").select(F.col("id").alias("query_id"), "v")
    for name, value in (("HELD", 1), ("TILE", 50), ("BLOCK", 12)):
        monkeypatch.setattr(vectors, name, value)
    got = vectors.nearest(df, q, [(4, F.col("g") == 1), (2, None), (3, F.col("g") == 9)], "id", "v", keep=["g"]).collect()
    for i, (k, part) in enumerate([(4, df.where("g = 1")), (2, df)]):
        want = {tuple(r) for r in vectors.top_k(part, q, k, "id", "v", keep=["g"]).collect()}
        assert {(r.query_id, r.rank, r.id, r.g, r.distance) for r in got if r["pass"] == i} == want and len(want) == 9 * k
    assert not [r for r in got if r["pass"] == 2]


def test_every_term_reaches_the_topic_model(spark):
    rows = [(d, f"w{d % 2}_{i}", 2) for d in range(12) for i in range(15)]
    df = spark.createDataFrame(rows, "d int, w string, n int")
    gamma, beta = topics.lda_topics(df, "d", "w", "n", 2)
    assert beta.select("term").distinct().count() == 30 and gamma.count() == 24
    best = {r.d: r.topic for r in topics.dominant(gamma, "d").collect()}
    assert len(best) == 12


def test_interval_dedupe_against_a_plain_fold(spark):
    rng = random.Random(6)
    rows = [(f"k{i % 3}", float(a := rng.randrange(0, 300)), float(a + rng.randrange(1, 20)), float(rng.randrange(0, 8))) for i in range(120)]
    rows = list({(k, a): (k, a, z, s) for k, a, z, s in rows}.values())
    got = {(r.k, r.a) for r in windows.interval_dedupe(spark.createDataFrame(rows, "k string, a double, z double, s double"), "k", "a", "z", "s", 5.0).collect()}
    kept = []
    for k, a, z, s in sorted(rows, key=lambda r: (-r[3], r[1])):
        if all(not (a - 5 < y and x < z + 5) for j, x, y in kept if j == k):
            kept.append((k, a, z))
    assert got == {(k, a) for k, a, _ in kept}
