"""Compositions: listing to ranked evidence, transcripts to a tagged index, records to an issue knowledge base. Lazy; one action an output."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates, dedupe, ranking, vectors, windows
from tessera.operators.gates import admissible


def ranked_evidence(chunks: DataFrame, probes: DataFrame, id: str, vector: str, text: str, spec: Mapping[str, object], tier: Column, signal: Column, category: Column, k_strict: int = 14, k_broad: int = 8, head: int = 30) -> DataFrame:
    """Probes -> filtered multi-probe hits -> tier and signal -> ranked, the head diversified and every other hit after it. Adds tier, signal, category, position."""
    from tessera.operators.gates import metadata_filter

    broad, strict = metadata_filter(spec)
    hits = vectors.multi_probe(chunks, probes, id, vector, broad, strict, k_strict, k_broad)
    rows = hits.join(chunks.drop(vector), id).withColumns({"tier": tier, "signal": signal, "category": category})
    numbered = windows.global_rank(rows, "rank", "tier", F.desc("signal"), "distance", id)
    return windows.diversified(numbered, "rank", "category", head)


def tagged_chunks(segments: DataFrame, lexicon: ranking.Lexicon, kinds: Sequence[str], derived: Sequence[tuple[str, str]] = (), least_letters: int = 40) -> DataFrame:
    """Transcript segments -> overlapping chunks -> admissible ones with their tags and an embedding."""
    chunks = windows.duration_windows(segments, "video_id").where(admissible(F.col("text"), least_letters))
    return vectors.hashed_embedding(ranking.tag(chunks, F.col("text"), lexicon, kinds, derived), F.col("text"))


def knowledge_base(records: DataFrame, id: str, block: str, bag: str, **merge) -> DataFrame:
    """Issue records -> duplicate clusters -> one merged record a cluster."""
    labelled = records.join(dedupe.clusters(records, id, block, bag).withColumnRenamed("id", id), id)
    return aggregates.merge_clusters(labelled, "cluster", id, **merge)


@dataclass
class Stage:
    """A step of a run: reads `inputs`, writes `output`."""

    name: str
    run: Callable[[SparkSession], None]
    output: str
    inputs: Sequence[str] = ()


def run_stages(spark: SparkSession, stages: Sequence[Stage], manifest: str, skip: Sequence[str] = (), resume_from: str | None = None, force: bool = False) -> list[dict]:
    """What became of every stage: ok, failed, up_to_date, skipped_by_user, skipped_by_resume or not_reached; also written to `manifest`.

    A stage is up to date if its output is there and no input is newer; force runs it all the same. The first failure ends
    the run, so that a later one resumes there.
    """
    from tessera.session import changed_at
    from tessera.sources.sinks import put_text

    first = [s.name for s in stages].index(resume_from) if resume_from else 0
    record: list[dict] = []
    failed = False
    for i, s in enumerate(stages):
        made = changed_at(spark, s.output)
        if failed:
            status = "not_reached"
        elif i < first:
            status = "skipped_by_resume"
        elif s.name in skip:
            status = "skipped_by_user"
        elif not force and made and all(0 < changed_at(spark, p) <= made for p in s.inputs):
            status = "up_to_date"
        else:
            began = time.time()
            try:
                s.run(spark)
                status = "ok"
            except Exception as e:  # noqa: BLE001 - whatever a stage raises ends the run and is recorded
                status, failed = "failed", True
                record.append({"stage": s.name, "status": status, "error": str(e)[:500]})
                continue
            record.append({"stage": s.name, "status": status, "seconds": round(time.time() - began, 3)})
            continue
        record.append({"stage": s.name, "status": status})
    put_text(spark, manifest, json.dumps({"stages": record, "ok": not failed}, indent=2))
    return record


def run_batch(spark: SparkSession, names: Sequence[str], stages: Callable[[str], Sequence[Stage]], manifests: str, workers: int = 3, finished: Sequence[str] = (), **how) -> list[dict]:
    """(name, ok, stages) of every name in the given order: run_stages of each, `workers` at a time, names already finished left out.

    A name that fails stops its own stages only. Stages of different names run as jobs of one session side by side.
    """
    from concurrent.futures import ThreadPoolExecutor

    todo = [n for n in dict.fromkeys(names) if n not in set(finished)]
    with ThreadPoolExecutor(workers) as pool:
        records = list(pool.map(lambda n: run_stages(spark, stages(n), f"{manifests}/{n}.json", **how), todo))
    return [{"name": n, "ok": all(r["status"] not in ("failed", "not_reached") for r in record), "stages": record} for n, record in zip(todo, records)]


def forum_statistics(messages: DataFrame, thread: str, order: Sequence[str], text: str, verdict: Column, focus: Column, classes: Sequence[tuple[str, str]], part: Column) -> DataFrame:
    """Messages -> gate -> threads (in parts) -> focus and class of each part -> statistics: (class, parts, messages, mean_focus)."""
    from tessera.functions.text import first_class
    from tessera.operators.gates import gate

    kept = gate(messages, verdict).where("keep")
    threads = aggregates.threads(kept, [thread], order, text, part=part)
    scored = threads.withColumn("focus", focus).withColumn("class", first_class(F.lower(text), list(classes), "other"))
    return scored.groupBy("class").agg(F.count("*").alias("parts"), F.sum("n_messages").alias("messages"), F.avg("focus").alias("mean_focus"))
