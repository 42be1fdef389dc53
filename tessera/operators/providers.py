"""Interfaces to services that answer texts (extraction, labelling, grounded answers, embeddings) and their offline defaults.

A provider is a callable on a batch of texts. It runs in mapInPandas with retries and back-off inside the task, so a lost
task repeats only its own calls; finished keys are skipped by an anti join before. The offline default extracts by rule.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str]]


def call(df: DataFrame, key: str, text: str, provider: Provider, into: str = "answer", batch: int = 32, attempts: int = 3, pause: float = 1.0, words: int | None = None) -> DataFrame:
    """(key, answer, status): the provider's answer to every text; status ok, empty (null text), or error after all attempts.

    One call holds up to `batch` texts and, where `words` is given, no more words than that (but for a single longer text).
    """
    kind = dict(df.dtypes)[key]

    def ask(texts: list[str]) -> tuple[list[str | None], str]:
        for k in range(attempts):
            try:
                return provider(texts), "ok"
            except Exception:  # noqa: BLE001 - whatever a service raises
                if k + 1 < attempts:
                    time.sleep(pause * 2**k)
        return [None] * len(texts), "error"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            edges, size = [0], 0
            for i, t in enumerate(b[text]):
                n = len(t.split()) if t and words else 0
                if i > edges[-1] and (i - edges[-1] == batch or words and size + n > words):
                    edges.append(i)
                    size = 0
                size += n
            for a, z in zip(edges, [*edges[1:], len(b)]):
                part = b.iloc[a:z]
                full = [t for t in part[text] if t]
                answers, status = ask(full) if full else ([], "ok")
                it = iter(answers)
                rows = [(k, next(it), status) if t else (k, None, "empty") for k, t in zip(part[key], part[text])]
                yield pd.DataFrame(rows, columns=[key, into, "status"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, {into} string, status string")


def rule_extractor(problems: Sequence[str], parts: Sequence[str]) -> Provider:
    """Offline extraction: `part: problem` for every sentence that names both, as a JSON array."""
    import json

    problem, part = (re.compile(r"\b(" + "|".join(map(re.escape, sorted(ws, key=len, reverse=True))) + r")\w*", re.I) for ws in (problems, parts))

    def extract(texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            found = []
            for s in re.split(r"(?<=[.!?])\s+", t):
                p, q = part.search(s), problem.search(s)
                if p and q:
                    found.append({"label": f"{p[1].lower()}: {q[1].lower()}", "evidence": s.strip()[:300]})
            out.append(json.dumps(found, ensure_ascii=False))
        return out

    return extract


def word_window(df: DataFrame, text: str, words: int, into: str) -> DataFrame:
    """df with the first `words` words of a text: the window that a call may hold."""
    return df.withColumn(into, F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, words), " "))


#: Given texts in order, the groups of those (by position) that say the same.
Merger = Callable[[list[str]], list[list[int]]]


def rule_merger(threshold: float = 0.5) -> Merger:
    """Offline merging: a text joins the first group whose first text shares so much of its words."""

    def merge(texts: list[str]) -> list[list[int]]:
        bags = [set(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
        groups: list[list[int]] = []
        for i, bag in enumerate(bags):
            hit = next((g for g in groups if bag and len(bags[g[0]] & bag) >= threshold * len(bags[g[0]] | bag)), None)
            if hit:
                hit.append(i)
            else:
                groups.append([i])
        return groups

    return merge


def consolidate(records: DataFrame, key: str, block: str, text: str, merger: Merger, size: int = 10, stride: int = 5, most: int = 30) -> DataFrame:
    """(key, kept): for every record the one that stands for it, after a cascade of calls.

    First batches of `size` records of a block, in order of the text; what stays goes, where a block still has more than
    `most`, through batches shifted by `stride`, so that neighbours which the first batches parted meet; last a block that
    fits one call of `most` records goes through it whole, and a larger one in batches of `most`. A call never holds more
    than that, so no task holds a whole block. Rows without a key are left out.
    """
    from tessera.operators.windows import global_rank
    from tessera.session import cut

    kind = {c: t for c, t in records.dtypes}

    def merged(rows: DataFrame, batch) -> DataFrame:
        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("i").reset_index(drop=True)
            kept = {i: g[0] for g in merger(p["t"].tolist()) for i in g}
            return pd.DataFrame({"k": p["k"], "kept": [p["k"][kept.get(i, i)] for i in range(len(p))]})

        return rows.withColumn("batch", batch).groupBy("b", "batch").applyInPandas(run, f"k {kind[key]}, kept {kind[key]}")

    alive = records.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(F.col(block).cast("string"), F.lit("")).alias("b"), F.coalesce(F.col(text), F.lit("")).alias("t")).dropDuplicates(["k"])
    all_rows = alive = cut(alive)
    links = alive.select("k", F.col("k").alias("kept"))
    steps = [(lambda i, n: F.floor(i / size), None), (lambda i, n: F.floor((i + stride) / size), most), (lambda i, n: F.floor(i / most), None)]
    for batch, least in steps:
        # all rows are numbered in ranges, so that no block is sorted in one task; a position in the block is counted from its first row
        ranked = global_rank(alive, "r", "b", "t", "k")
        numbered = ranked.join(ranked.groupBy("b").agg(F.min("r").alias("first"), F.count("*").alias("n")), "b").withColumn("i", F.col("r") - F.col("first"))
        if least is not None:
            numbered = numbered.where(F.col("n") > least)
        found = cut(merged(numbered.select("b", "i", "n", "k", "t"), batch(F.col("i"), F.col("n"))).where("k <> kept"))
        links = links.join(found.select(F.col("k").alias("kept"), F.col("kept").alias("next")), "kept", "left").select("k", F.coalesce("next", "kept").alias("kept"))
        alive = cut(alive.join(found.select("k"), "k", "left_anti"))
    return all_rows.select("k").join(links, "k").select(F.col("k").alias(key), "kept")


def synthesise(pages: Sequence[str], task: str, required: Sequence[str], provider: Provider, letters: int = 60_000, attempts: int = 3) -> dict:
    """A description (YAML) that a provider writes from pages, asked again with what is missing until it holds the required keys (dotted)."""
    import yaml

    prompt = task + "\n\n" + "\n\n---\n\n".join(pages)[:letters]
    missing = list(required)
    for _ in range(attempts):
        answer = re.sub(r"(?s)^\s*```(?:ya?ml)?\s*|\s*```\s*$", "", provider([prompt])[0])
        try:
            spec = yaml.safe_load(answer)
        except yaml.YAMLError:
            spec = None

        def there(name: str) -> bool:
            at = spec
            for part in name.split("."):
                at = at.get(part) if isinstance(at, dict) else None
            return at not in (None, "", [], {})

        missing = [r for r in required if not there(r)]
        if not missing:
            return spec
        prompt += "\n\nStill missing: " + ", ".join(missing)
    raise ValueError("missing: " + ", ".join(missing))
