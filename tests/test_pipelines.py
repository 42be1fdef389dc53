from pyspark.sql import functions as F

from tessera.operators.ranking import Lexicon, signal, tiered
from tessera.operators.vectors import hashed_embedding
from tessera.plans import pipelines


def test_transcripts_to_ranked_evidence(spark):
    segments = spark.createDataFrame([("v1", float(i * 10), 10.0, t) for i, t in enumerate(["the water pump began to leak again"] * 4 + ["nothing to report on this one here"] * 4)] + [("v2", 0.0, 5.0, "[music]")], "video_id string, start double, duration double, text string")
    lexicon = Lexicon({"parts": [("pump", "pump"), ("clutch", "clutch")], "systems": []}, {("parts", "systems"): {"pump": "cooling"}})
    chunks = pipelines.tagged_chunks(segments, lexicon, ["parts", "systems"], [("parts", "systems")])
    rows = {(r.video_id, r.chunk_no): r for r in chunks.collect()}
    assert set(v for v, _ in rows) == {"v1"} and rows[("v1", 0)].parts == ["pump"] and rows[("v1", 0)].systems == ["cooling"] and rows[("v1", len(rows) - 1)].parts == []
    indexed = chunks.withColumns({"id": F.concat_ws("-", "video_id", "chunk_no"), "is_flagged": F.lit(False), "fuel": F.lit("petrol")})
    probes = hashed_embedding(spark.createDataFrame([(1, "water pump leak"), (2, "nothing to report")], "probe int, t string"), F.col("t"))
    tier = tiered(5, [(F.array_contains("parts", "pump"), 1)])
    out = pipelines.ranked_evidence(indexed, probes, "id", "embedding", "text", {"fuel": "petrol"}, tier, signal(F.col("text"), ["leak"], [], []), F.when(F.array_contains("parts", "pump"), "cooling").otherwise("general")).orderBy("position").collect()
    assert out[0].id == "v1-0" and out[0].tier == 1 and [r.position for r in out] == list(range(1, len(out) + 1)) and len(out) == len(rows)


def test_no_hit_is_lost_behind_the_head(spark):
    rows = [(f"c{i:03}", f"part{i} seal{i} leak", "petrol", i % 3, False) for i in range(90)]
    chunks = hashed_embedding(spark.createDataFrame(rows, "id string, text string, fuel string, kind int, is_flagged boolean"), F.col("text"))
    probes = hashed_embedding(spark.createDataFrame([(i, f"part{i} seal{i}") for i in range(0, 90, 3)], "probe int, t string"), F.col("t"))
    run = lambda head: pipelines.ranked_evidence(chunks, probes, "id", "embedding", "text", {"fuel": "petrol"}, F.col("kind") + 1, F.lit(0), F.concat(F.lit("k"), "kind"), head=head).orderBy("position").collect()
    whole, few = run(90), run(5)
    assert len(few) > 50 and {r.id for r in few} == {r.id for r in whole} and [r.position for r in few] == list(range(1, len(whole) + 1))
    key = lambda r: (r.tier, -r.signal, r.distance, r.id)
    assert [r.id for r in few[5:]] == [r.id for r in sorted(whole, key=key)[5:]]


def test_knowledge_base(spark):
    rows = [("a", "cooling", ["water", "pump", "thermostat", "leak"], "x"), ("b", "cooling", ["thermostat", "housing", "water", "pump", "leak"], "longer"), ("c", "body", ["water", "pump", "thermostat", "leak"], "y")]
    kb = pipelines.knowledge_base(spark.createDataFrame(rows, "id string, component string, bag array<string>, cause string"), "id", "component", "bag", weight=[F.length("cause")], longest=["cause"])
    assert sorted((r.id, r.cause, r.merged) for r in kb.collect()) == [("b", "longer", 2), ("c", "y", 1)]


def test_embedding_of_nothing(spark):
    df = hashed_embedding(spark.createDataFrame([(None,), ("",), ("a b",)], "t string"), F.col("t"))
    assert sorted(round(sum(x * x for x in r.embedding), 3) for r in df.collect()) == [0.0, 0.0, 1.0]
