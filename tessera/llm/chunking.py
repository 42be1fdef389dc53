"""Splitting oversized texts at natural boundaries, by dynamic programming over the boundary positions.

A text longer than the limit is cut into pieces of at most `limit` characters; each piece after the first repeats up to
`overlap` characters of the one before, from a boundary on. Among all ways to cut, the one of least cost is taken: the
sum of the penalties of its cuts (paragraph < sentence < line < word) and of the squared distance of each piece from an
even share. Only where more than `limit` characters in a row hold no boundary at all is a cut forced between two others.

Lengths are code points of the text without the blanks, tabs, line breaks and no-break spaces at its ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENDS = " \t\r\n\v\f\u0085   "
STOPS = ".!?。！？।…"
PARAGRAPH, SENTENCE, LINE, WORD, MARK, FORCED = 0.0, 0.4, 0.8, 2.0, 4.0, 50.0
KINDS = {PARAGRAPH: "paragraph", SENTENCE: "sentence", LINE: "line", WORD: "word", MARK: "mark", FORCED: "forced"}
EVENNESS = 12.0

_BREAKS = re.compile(rf"(\s+)|([{STOPS}]+)")
_CLOSERS = "\"'”’»」』)]）"

SCHEMA = [("piece_no", "int"), ("pieces", "int"), ("start_char", "int"), ("end_char", "int"), ("overlap", "int"), ("cut", "string"), ("forced", "boolean"), ("piece", "string")]


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which text may be cut (0 and its end among them), and the penalty of each."""
    cost: dict[int, float] = {}
    marks: list[int] = []  # before a blank or a stop: needed only where what lies between boundaries is too long
    for m in _BREAKS.finditer(text):
        a, z = m.span()
        marks.append(a)
        if m[1]:
            before = text[a - 1] if a else ""
            if before in _CLOSERS and a > 1:
                before = next((c for c in reversed(text[max(0, a - 4) : a]) if c not in _CLOSERS), "")
            lines = m[1].count("\n")
            cost[z] = PARAGRAPH if lines > 1 else SENTENCE if before and before in STOPS else LINE if lines else WORD
        else:
            cost[z] = min(cost.get(z, MARK), SENTENCE if m[2][-1] in "。！？।" else MARK)
        if z - a > 64:  # a run of blanks or stops may be longer than a piece
            marks += range(a + 1, z)
    at = [0, *cost, len(text)]
    if any(b - a > limit for a, b in zip(at, at[1:])):
        for p in marks:
            cost.setdefault(p, MARK)
    cost |= {0: 0.0, len(text): 0.0}
    at = sorted(cost)
    for a, b in zip(at, at[1:]):
        if b - a > limit:  # evenly, so that no sliver is left over
            n = -(-(b - a) // limit)
            cost |= {a + (b - a) * k // n: FORCED for k in range(1, n)}
    at = np.array(sorted(cost), dtype=np.int64)
    return at, np.array([cost[p] for p in at.tolist()])


def cheapest(at: np.ndarray, pen: np.ndarray, limit: int, share: float) -> tuple[float, list[int]]:
    """(cost, boundaries from 0 to the end) of the least costly way to cut at some of the boundaries; infinite if there is none."""
    best, back = np.full(len(at), np.inf), np.zeros(len(at), dtype=np.int64)
    best[0] = 0.0
    first = np.searchsorted(at, at - limit)
    for j in range(1, len(at)):
        i = first[j]
        if i < j:
            total = best[i:j] + EVENNESS * ((at[j] - at[i:j] - share) / limit) ** 2
            k = int(np.argmin(total))
            best[j], back[j] = total[k] + pen[j], i + k
    points, j = [len(at) - 1], len(at) - 1
    while j and np.isfinite(best[-1]):
        j = int(back[j])
        points.append(j)
    return float(best[-1]), points[::-1]


def least_with_a_weak_cut(at: np.ndarray, pen: np.ndarray, weak: np.ndarray, limit: int) -> float:
    """No way to cut that uses a weak boundary costs less: that cut, and the cheapest ones for all further pieces needed."""
    inner = pen[1:-1]
    if not weak.any():
        return np.inf
    more = max(0, -(-int(at[-1]) // limit) - 2)
    return float(pen[weak].min()) + (float(np.partition(inner, more - 1)[:more].sum()) if 0 < more <= len(inner) else 0.0)


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, float]]:
    """(start with overlap, start without, end, penalty of the cut at its start) of each piece of text."""
    if len(text) <= limit:
        return [(0, 0, len(text), 0.0)]
    at, pen = boundaries(text, limit)
    # pieces should leave room for the overlap, so the even share is counted on what remains of the limit
    share = len(text) / -(-len(text) // max(1, limit - overlap))
    # without words first: most texts have a way to cut that no way with a cut between words can beat
    weak = (pen >= WORD) & (pen < FORCED)
    strong = np.flatnonzero(~weak)
    total, points = cheapest(at[strong], pen[strong], limit, share)
    if total > least_with_a_weak_cut(at, pen, weak, limit):
        _, points = cheapest(at, pen, limit, share)
    else:
        points = strong[points].tolist()
    out = []
    for i, j in zip(points, points[1:]):
        room = min(overlap, limit - int(at[j] - at[i]), int(at[i])) if i else 0
        k = int(np.searchsorted(at, at[i] - room))  # the repeated part begins at a boundary where there is one
        while k < i and pen[k] == MARK and k + 1 < i:
            k += 1  # behind a blank rather than before it
        start = int(at[k]) if k < i or pen[i] != FORCED else int(at[i]) - room
        out.append((start, int(at[i]), int(at[j]), float(pen[i])))
    return out


def oversized(text: Column, limit: int) -> Column:
    return F.char_length(F.btrim(text, F.lit(ENDS))) > limit


def split_oversized(df: DataFrame, text: str, limit: int = 1200, overlap: int = 120, only_oversized: bool = False) -> DataFrame:
    """One row per piece: df's columns but the text, and piece_no (from 1), pieces, start_char, end_char, overlap, cut, forced, piece.

    start_char and end_char are code points of the stored text, `overlap` of them repeated from the piece before; cut is
    the kind of boundary the piece begins at, forced tells whether any cut of the text had to be forced. A text within
    the limit is one piece; a null, empty or blank text none; repeated rows are split each; columns of df with an added
    name are replaced. Nothing is shuffled: a text is split where it lies. only_oversized leaves the others out in the JVM.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    names = [n for n, _ in SCHEMA]
    kept = [c for c in df.columns if c != text and c not in names]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    rows = rows.where(oversized(F.col("__text"), limit) if only_oversized else F.char_length(F.btrim("__text", F.lit(ENDS))) > 0)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("__text")
            row, out = [], []
            for i, t in enumerate(texts):
                body = t.strip(ENDS)
                lead = len(t) - len(t.lstrip(ENDS))
                found = cuts(body, limit, overlap)
                forced = any(p == FORCED for *_, p in found)
                row += [i] * len(found)
                out += [(k + 1, len(found), lead + a, lead + z, b - a, KINDS[p] if k else "start", forced, body[a:z]) for k, (a, b, z, p) in enumerate(found)]
            yield pd.concat([batch.iloc[row].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    schema = T.StructType([*rows.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in SCHEMA)).fields])
    return rows.mapInPandas(pieces, schema)
