"""Evaluation texts leaking into training text.

For the strict search every run of `size` consecutive words of an item and of a document gets a 64-bit SimHash (the sum
of its words' signed hash bits). A multi-index over the items' fingerprints - the 64 bits in radius + 1 blocks - finds
every item window within the radius of a document window, since two fingerprints that differ in at most `radius` bits
agree in one block; equal windows have equal fingerprints, so none is lost.

Below similarity 1 no radius is safe, so candidates come from the shingles themselves: windows of a similarity t share
shingles of at least t / (1 + t) of the weight of both. Document windows whose shingles known to any item weigh less
than t of the whole are left at once, item windows that share too little after that; both bounds lose no pair.
Candidates are verified exactly by the weighted similarity of their word shingles, and for the strict search by the words.

The item side is a stated query set of bounded size: it is split into parts of at most PART windows, each sent to the
documents whole; the documents are never shuffled, and nothing of them goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.lookalikes import consistent
from tessera.session import cut

BITS = 64
#: Item windows sent to the documents at once (about 100 bytes each).
PART = 500_000
#: Words of documents that are searched together.
STRETCH = 50_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_SHIFT = np.arange(BITS, dtype=np.uint64)


def words(text: str) -> list[str]:
    """Runs of letters and digits of the lower-cased consistent form."""
    return _WORD.findall(text.lower() if text.isascii() else consistent(consistent(text).lower()))


def word_hashes(ws: list[str], memo: dict[str, int]) -> np.ndarray:
    out = np.empty(len(ws), dtype=np.uint64)
    for i, w in enumerate(ws):
        h = memo.get(w)
        if h is None:
            if len(memo) > 1_000_000:
                memo.clear()
            h = memo[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of every window of `size` consecutive words; empty if there are fewer words."""
    if len(hashes) < size:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(len(hashes) - size + 1, dtype=np.uint64)
    for a in range(0, len(out), 65_536):  # long texts in stretches, so that memory stays flat
        h = hashes[a : a + 65_536 + size - 1]
        signed = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
        total = np.zeros((len(h) + 1, BITS), dtype=np.int32)
        np.cumsum(signed, axis=0, out=total[1:])
        ones = total[size:] - total[:-size]
        out[a : a + len(ones)] = np.packbits(2 * ones > size, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return out


class Index:
    """Item windows by blocks of their fingerprint."""

    def __init__(self, items: list[tuple[int, list[str]]], size: int, radius: int):
        memo: dict[str, int] = {}
        self.size, self.radius = size, radius
        prints, owner, exact = [], [], []
        self.words: list[list[str]] = [w for _, w in items]
        self.ids = [i for i, _ in items]
        for k, (_, ws) in enumerate(items):
            h = word_hashes(ws, memo)
            f = simhashes(h, size)
            prints.append(f)
            owner.append(np.full(len(f), k))
            exact.append(np.arange(len(f)))
        self.prints = np.concatenate(prints) if prints else np.empty(0, dtype=np.uint64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, dtype=np.int64)
        self.at = np.concatenate(exact) if exact else np.empty(0, dtype=np.int64)
        edges = np.linspace(0, BITS, radius + 2).astype(int)
        self.blocks = []
        for a, z in zip(edges, edges[1:]):
            key = self._block(self.prints, a, z)
            order = np.argsort(key, kind="stable")
            self.blocks.append((a, z, key[order], order))

    @staticmethod
    def _block(prints: np.ndarray, a: int, z: int) -> np.ndarray:
        return (prints >> np.uint64(a)) & np.uint64((1 << int(z - a)) - 1)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in prints, item window) of every pair within the radius, each once."""
        mine, theirs = [], []
        for a, z, keys, order in self.blocks:
            key = self._block(prints, a, z)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            n = hi - lo
            p = np.repeat(np.arange(len(prints)), n)
            if not len(p):
                continue
            offset = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
            w = order[np.repeat(lo, n) + offset]
            near = np.bitwise_count(prints[p] ^ self.prints[w]) <= self.radius
            mine.append(p[near])
            theirs.append(w[near])
        if not mine:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        both = np.unique(np.stack([np.concatenate(mine), np.concatenate(theirs)], axis=1), axis=0)
        return both[:, 0], both[:, 1]


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One number for every run of `width` consecutive words; equal runs have equal numbers."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return out


def sums(values: np.ndarray, width: int) -> np.ndarray:
    """The sum of every run of `width` consecutive values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[width:] - total[:-width]


def lengths(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(len, ws), dtype=np.int64, count=len(ws))


class Shingles:
    """Item windows by their shingles, for similarities below 1."""

    def __init__(self, items: list[tuple[int, list[str]]], size: int, similarity: float, shingle: int):
        memo: dict[str, int] = {}
        self.similarity, self.width = similarity, min(shingle, size)
        self.held = size - self.width + 1  # shingles of a window
        self.words: list[list[str]] = [w for _, w in items]
        self.ids = [i for i, _ in items]
        parts = [[np.empty(0, dtype=np.int64)] * 6]
        windows = 0
        for k, (_, ws) in enumerate(items):
            n = len(ws) - size + 1
            if n < 1:
                continue
            weight = sums(lengths(ws), self.width)
            j = np.arange(len(weight))
            first, last = windows + np.maximum(j - self.held + 1, 0), windows + np.minimum(j, n - 1)
            parts.append([weight, first, last, sums(weight, self.held), np.full(n, k), np.arange(n)])
            windows += n
        # of each shingle: its weight, the first and the last window that holds it; of each window: its weight, item and place
        self.weight, self.first, self.last, self.total, self.owner, self.at = (np.concatenate(x) for x in zip(*parts))
        keys = np.concatenate([np.empty(0, dtype=np.uint64), *[shingle_hashes(word_hashes(ws, memo), self.width) for ws in self.words if len(ws) >= size]])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def candidates(self, hashes: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position in hashes, item window) of every pair that may reach the similarity, each once; hashes and lengths of the words, and where windows begin."""
        t = self.similarity
        keys = shingle_hashes(hashes, self.width)
        weight = sums(sizes, self.width)
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        total = sums(weight, self.held)
        known = sums(np.where(hi > lo, weight, 0), self.held)
        for p in whole[(known[whole] > 0) & (known[whole] >= t * total[whole] - 1e-6)].tolist():
            own = p + np.unique(keys[p : p + self.held], return_index=True)[1]
            at = np.concatenate([self.order[lo[i] : hi[i]] for i in own.tolist()])
            n = self.last[at] - self.first[at] + 1
            w = np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w, which = np.unique(w, return_inverse=True)
            shared = np.bincount(which, np.repeat(self.weight[at], n))
            for x in w[shared * (1 + t) >= t * (total[p] + self.total[w]) - 1e-6].tolist():
                yield p, x


def shingle_similarity(a: list[str], b: list[str], k: int = 5) -> float:
    """Weighted Jaccard similarity of the word shingles of two windows; a shingle weighs its number of characters."""
    def shingles(ws: list[str]) -> dict[tuple[str, ...], int]:
        out: dict[tuple[str, ...], int] = {}
        for i in range(max(1, len(ws) - k + 1)):
            s = tuple(ws[i : i + k])
            out[s] = out.get(s, 0) + sum(map(len, s))
        return out

    x, y = shingles(a), shingles(b)
    top = sum(min(v, y[s]) for s, v in x.items() if s in y)
    bottom = sum(x.values()) + sum(y.values()) - top
    return top / bottom if bottom else 0.0


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 12, radius: int = 3, similarity: float = 1.0, shingle: int = 5) -> DataFrame:
    """(doc_id, item_id, words, similarity): items of which a window of `size` words occurs in a document.

    One row a document and item: `words` counts the document's windows that match one of the item, similarity is the
    best one. With similarity 1.0 a window has to occur word by word; below (and above 0), every window of the document
    counts whose weighted similarity of shingles to one of the item's reaches the threshold, however far apart their
    fingerprints are: `radius` is for the strict search alone.

    Null texts and ids, and texts of fewer than `size` words, leak nothing; repeated rows count as they are and repeated
    items once; empty tables give no row; only the named columns are read. The items may be many: they are searched part
    by part, each part against all documents, and no more than one part of PART windows is held at a time.
    """
    rows = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(item_id, item_text).distinct()
    spark = documents.sparkSession
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_types = dict(docs.dtypes)["doc_id"], dict(items.dtypes)[item_id]
    schema = f"doc_id {id_types[0]}, item_id {id_types[1]}, words long, similarity double"

    def matches(index, memo, ids, split):
        flat = [w for ws in split for w in ws]
        owner = np.repeat(np.arange(len(split)), [len(ws) for ws in split])
        hashes, n = word_hashes(flat, memo), len(flat) - size + 1
        whole = np.flatnonzero(owner[:n] == owner[size - 1 :]) if n > 0 else np.empty(0, dtype=np.int64)  # windows within one text
        if not len(whole):
            return []
        best: dict[tuple[int, int], list] = {}
        counted = set()
        if similarity < 1:
            pairs = index.candidates(hashes, lengths(flat), whole)
        else:
            near, theirs = index.candidates(simhashes(hashes, size)[whole])
            pairs = zip(whole[near].tolist(), theirs.tolist())
        for p, w in pairs:
            k, a = int(index.owner[w]), int(index.at[w])
            theirs, ours = index.words[k][a : a + size], flat[p : p + size]
            s = shingle_similarity(ours, theirs, shingle)
            if s >= similarity and (similarity < 1 or theirs == ours):  # the strict search asks for the words themselves, too
                e = best.setdefault((int(owner[p]), k), [0, 0.0])
                e[0] += (k, p) not in counted
                e[1] = max(e[1], s)
                counted.add((k, p))
        return [(ids[i], index.ids[k], n, s) for (i, k), (n, s) in best.items()]

    def search(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index, memo = shared.value, {}
            for b in batches:
                ids, texts = b["doc_id"].tolist(), b["text"].tolist()
                at = 0
                while at < len(ids):  # texts are searched together, STRETCH words at a time
                    split, n, first = [], 0, at
                    while at < len(ids) and n < STRETCH:
                        split.append(words(texts[at]))
                        n += len(split[-1])
                        at += 1
                    yield pd.DataFrame(matches(index, memo, ids[first:at], split), columns=["doc_id", "item_id", "words", "similarity"])

        return run

    result, part, count, sent = None, [], 0, None

    def add(part):
        nonlocal result, sent
        if sent is not None:  # an earlier part is searched for and its windows given up before the next ones are sent out
            result = cut(result)
            sent.destroy()
        sent = spark.sparkContext.broadcast(Shingles(part, size, similarity, shingle) if similarity < 1 else Index(part, size, radius))
        found = docs.mapInPandas(search(sent), schema)
        result = found if result is None else result.unionByName(found)

    for r in rows.orderBy(item_id).toLocalIterator():
        ws = words(r[1])
        part.append((r[0], ws))
        count += max(0, len(ws) - size + 1)
        if count >= PART:
            add(part)
            part, count = [], 0
    if part:
        add(part)
    if result is None:
        return spark.createDataFrame([], schema)
    return result
