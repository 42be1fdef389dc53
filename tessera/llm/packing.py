"""Filling containers of fixed token capacity with documents, balanced by attention cost.

Documents go in descending order of size, each into the sequence of least estimated cost (linear plus quadratic in its
documents' tokens) among all that still have room; a document larger than a container is cut at token boundaries into full pieces
and a rest. Packing runs in shards of bounded size, so no task and no driver ever holds more than SHARD documents;
every shard leaves at most a few containers partly empty.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents (pieces) that one task packs at once, on average.
SHARD = 20_000
#: Default public tokenizer file; a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(path: str):
    """encode(texts) -> list of id lists, and decode(ids) -> text, for the public vocabulary file at path."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(t) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: processor.encode(list(texts), num_threads=1)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


def token_counts(df: DataFrame, text: str, tokenizer: str = TOKENIZER, into: str = "tokens") -> DataFrame:
    """df with the number of tokens of each text; null for a null text. The vocabulary file is shipped to the executors."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load_tokenizer(SparkFiles.get(name))
        for b in batches:
            sizes = iter([len(x) for x in encode([t for t in b if t is not None])])
            out = pd.Series([None if t is None else next(sizes) for t in b], index=b.index, dtype="Int32")
            yield out

    return df.withColumn(into, count(F.col(f"`{text}`")))


def cost(tokens: int, capacity: int) -> float:
    """Attention cost of a document in a sequence: linear plus quadratic in its tokens, in units of a full sequence."""
    x = tokens / capacity
    return x + x * x


class Open:
    """Open sequences by free room: a heap of (cost, sequence) for each room, and the least cost of each room for searching."""

    def __init__(self, capacity: int):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.least = np.full(capacity + 1, np.inf)

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self.least[room] = self.heaps[room][0][0]

    def take(self, tokens: int) -> tuple[int, float, int] | None:
        """The (room, cost, sequence) of least cost among all that have room; the tightest, then the first one, on a tie."""
        room = tokens + int(np.argmin(self.least[tokens:]))
        if not self.heaps[room]:
            return None
        cost, sequence = heapq.heappop(self.heaps[room])
        self.least[room] = self.heaps[room][0][0] if self.heaps[room] else np.inf
        return room, cost, sequence


def pack_shard(sizes: list[int], capacity: int) -> list[int]:
    """The container (0, 1, ...) of each size. Sizes must not exceed the capacity.

    As many sequences are opened as the total size asks for. Documents go in descending order, each to the sequence of
    least cost among all that have room; a further one is opened only where none has.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    place, opened = [0] * len(sizes), -(-sum(sizes) // capacity)
    ready = Open(capacity)
    for c in range(opened):
        ready.put(capacity, 0.0, c)
    for i in order:
        s = sizes[i]
        found = ready.take(s)
        if found is None:
            found = (capacity, 0.0, opened)
            opened += 1
        room, spent, c = found
        place[i] = c
        ready.put(room - s, spent + cost(s, capacity), c)
    # sequences planned for but never needed leave no hole in the numbering
    number = {c: k for k, c in enumerate(sorted(set(place)))}
    return [number[c] for c in place]


def pack(df: DataFrame, id: str, tokens: str = "tokens", capacity: int = 1024, shard: int = SHARD) -> DataFrame:
    """(id, piece_no, tokens, container string, position): the container of every document, or of each of its pieces.

    A document of at most `capacity` tokens is whole in one container (piece_no 1); a larger one comes in pieces of
    `capacity` tokens and a rest. Documents of zero or null tokens and null ids get no container; repeated ids are
    packed as often as they come. Extra columns are ignored. The result depends on the data and the shard size only.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{tokens}`").cast("long").alias("t")).where("id is not null and t > 0")
    pieces = rows.select(
        "id",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("t") - 1) / capacity).cast("int")), lambda k: F.least(F.lit(capacity), F.col("t") - k * capacity).cast("int"))).alias("k", "tokens"),
    )
    shards = pieces.agg(F.ceil(F.count("*") / shard)).first()[0] or 1
    pieces = pieces.select((F.pmod(F.xxhash64(F.col("id").cast("string"), "k"), F.lit(int(shards)))).cast("int").alias("shard"), "id", (F.col("k") + 1).alias("piece_no"), "tokens")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["tokens", "id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        c = pd.Series(pack_shard(batch["tokens"].tolist(), capacity))
        return pd.DataFrame({"id": batch["id"], "piece_no": batch["piece_no"], "tokens": batch["tokens"], "container": batch["shard"].astype(str) + "-" + c.astype(str), "position": batch.groupby(c).cumcount().astype("int32") + 1})

    kind = dict(rows.dtypes)["id"]
    return pieces.groupBy("shard").applyInPandas(run, f"id {kind}, piece_no int, tokens int, container string, position int").withColumnRenamed("id", id)
