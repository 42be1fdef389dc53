"""Mapping free-entered engine names to the reference list.

A symmetric-delete dictionary (every name and alias, and each with one letter taken out) is broadcast; a word within one
slip of a name shares an entry with it. Candidates are verified and ranked by a weighted Damerau-Levenshtein distance,
then by how many entries of the reference carry the name; the displacement, given in litres or cubic centimetres, in
figures or in words, decides among the engines of a name. Values that fit none are reported as UNMATCHED.

The dictionary grows with the reference list, never with the data; its size is checked before it is sent out.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNMATCHED = "UNMATCHED"
#: Names and aliases that the broadcast dictionary may hold, and bytes of its entries (each name with each letter left out).
MOST_NAMES, MOST_BYTES = 200_000, 256 << 20
# Cost of a slip. A doubled or swapped letter is likelier than a lost or a changed one.
DOUBLED, SWAPPED, LOST, CHANGED = 0.5, 0.6, 0.7, 1.0
_DIGITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": 0, "nought": 0}
_NUMBER = "|".join(_DIGITS)
_LITRE = r"(?:l|lt|ltr|liters?|litres?)"
#: What may stand between a displacement and a name.
_BETWEEN = rf"(?:[\s_\-]|\b{_LITRE}\b|turbo)*"
_SIZES = [
    (re.compile(r"(?<![\d.,])(\d{3,5})\s*(?:ccm|cc|cm3|cm³|cubic cent\w+)(?![a-z])"), lambda m: int(m[1])),
    (re.compile(rf"(?<![\d.,])(\d)\s*[.,]\s*(\d)(?!\d)(?:\s*{_LITRE}(?![^\W\d_]))?"), lambda m: f"{m[1]}.{m[2]}"),
    (re.compile(rf"\b({_NUMBER})\s+(?:point|dot|comma)\s+({_NUMBER})\b(?:\s*{_LITRE}\b)?"), lambda m: f"{_DIGITS[m[1]]}.{_DIGITS[m[2]]}"),
    (re.compile(rf"\b({_NUMBER})\s+and\s+a\s+half\s*-?{_LITRE}?\b"), lambda m: f"{_DIGITS[m[1]]}.5"),
    (re.compile(rf"\b({_NUMBER}|\d)\s*-?\s*{_LITRE}\b"), lambda m: f"{_DIGITS.get(m[1], m[1])}.0"),
]
_WORD = re.compile(r"[^\W\d_]+")
#: Letters and figures together, as in the names of some engines.
_CODE = re.compile(r"(?=[^\W_]*\d)(?=\d*[^\W\d_])[^\W_]+")


def distance(word: str, name: str, slips: int = 1) -> float | None:
    """Weighted Damerau-Levenshtein distance of word from name, by at most so many slips; None beyond them.

    Letters may be lost, doubled, changed or swapped with their neighbour; a letter that is in name neither there nor
    beside it can't have slipped in. Only the cells within `slips` of the diagonal are looked at.
    """
    n, m = len(word), len(name)
    if abs(n - m) > slips:
        return None
    if word == name:
        return 0.0
    far = (float("inf"), slips + 1)
    step = lambda x, cost: (x[0] + cost, x[1] + 1) if x[1] < slips else far
    rows = [{j: (j * LOST, j) for j in range(min(m, slips) + 1)}]
    for i in range(1, n + 1):
        row: dict[int, tuple[float, int]] = {}
        for j in range(max(0, i - slips), min(m, i + slips) + 1):
            options = []
            if j and word[i - 1] == name[j - 1]:
                options.append(rows[i - 1].get(j - 1, far))
            elif j:
                options.append(step(rows[i - 1].get(j - 1, far), CHANGED))
            if j:
                options.append(step(row.get(j - 1, far), LOST))
            if i > 1 and word[i - 1] == word[i - 2]:
                options.append(step(rows[i - 1].get(j, far), DOUBLED))
            if i > 1 and j > 1 and word[i - 1] == name[j - 2] and word[i - 2] == name[j - 1]:
                options.append(step(rows[i - 2].get(j - 2, far), SWAPPED))
            row[j] = min(options, default=far)
        if all(k > slips for _, k in row.values()):
            return None
        rows.append(row)
    cost, used = rows[n].get(m, far)
    return cost if used <= slips else None


def normal(value: str) -> str:
    return unicodedata.normalize("NFKC", value).lower()


def sizes(text: str) -> list[tuple[int, int, str | int]]:
    """(start, end, displacement) of each displacement in text: litres as 'd.d', cubic centimetres as an int."""
    found: list[tuple[int, int, str | int]] = []  # in order, none overlapping another
    for pattern, read in _SIZES:
        for m in pattern.finditer(text):
            k = bisect_left(found, (m.start(),))
            if not (k and found[k - 1][1] > m.start() or k < len(found) and found[k][0] < m.end()):
                found.insert(k, (m.start(), m.end(), read(m)))
    return found


def squeezed(text: str) -> str:
    """Letters and figures alone, with the point of a displacement."""
    return re.sub(r"(?<=\d)[.,](?=\d)|[\W_]+", lambda m: "." if m[0] in ".," and m.start() and text[m.start() - 1].isdigit() and m.end() < len(text) and text[m.end()].isdigit() else "", text)


class Names:
    """The reference list as a symmetric-delete dictionary."""

    def __init__(self, engines: list[tuple[str, int | None, list[str]]]):
        self.by_name: dict[str, dict[str | int, set[str]]] = {}
        self.alone: dict[str, set[str]] = {}
        self.sizes: dict[str, set[str | int]] = {}
        self.exact: dict[str, set[str]] = {}
        self.words = 1  # of the longest name
        for code, cc, aliases in engines:
            own: set[str | int] = set() if cc is None else {cc}
            for entry in [code, *aliases]:
                t = normal(entry).replace("_", " ")
                if key := squeezed(t):
                    self.exact.setdefault(key, set()).add(code)
                found = sizes(t)
                rest = t if not found else t[: found[0][0]] + " " + t[found[0][1] :]
                words = re.findall(r"[^\W_]+", rest)
                name = "".join(words)
                if not _WORD.search(name):
                    continue
                self.words = max(self.words, len(words))
                if found:
                    own |= {s for *_, s in found}
                    for s in {s for *_, s in found} | ({cc} if cc is not None else set()):
                        self.by_name.setdefault(name, {}).setdefault(s, set()).add(code)
                else:
                    self.alone.setdefault(name, set()).add(code)
            self.sizes[code] = own
        names = {*self.by_name, *self.alone}
        if len(names) > MOST_NAMES:
            raise ValueError(f"{len(names)} names: more than may be broadcast; resolve against parts of the list")
        if (size := sum((len(n) + 1) * (len(n) + 60) for n in names)) > MOST_BYTES:
            raise ValueError(f"names of {size} bytes: more than may be broadcast; resolve against parts of the list")
        self.figures = any(_CODE.fullmatch(n) for n in names)
        self.frequency = Counter({n: sum(map(len, self.by_name.get(n, {}).values())) + len(self.alone.get(n, ())) for n in names})
        self.deletes: dict[str, set[str]] = {}
        for n in names:
            for d in {n, *(n[:i] + n[i + 1 :] for i in range(len(n)))}:
                self.deletes.setdefault(d, set()).add(n)
        self.longest = max(map(len, names), default=0) + 1
        self.seen: dict[str, list[tuple[float, str]]] = {}

    def near(self, word: str) -> list[tuple[float, str]]:
        """(distance, name) of every name within one slip of word, best first; words under three letters allow for none."""
        if len(word) > self.longest:
            return []
        if len(word) < 3:
            return [(0.0, word)] if word in self.frequency else []
        if (hit := self.seen.get(word)) is None:
            candidates = set().union(*(self.deletes.get(d, ()) for d in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}))
            hit = sorted(((s, n) for n in candidates if (s := distance(word, n)) is not None), key=lambda x: (x[0], -self.frequency[x[1]], x[1]))
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = hit
        return hit

    def _of(self, near: list[tuple[float, str]], size: str | int | None) -> tuple[float, str] | None:
        """Best (distance, code) of the names near a word, given the displacement beside it."""
        best = None
        for distance, name in near:
            codes = self.by_name.get(name, {}).get(size, set()) if size is not None else set()
            codes = codes | {c for c in self.alone.get(name, ()) if size is None or size in self.sizes[c]}
            for code in codes:
                if best is None or (distance, -self.frequency[name], code) < best[0]:
                    best = ((distance, -self.frequency[name], code), code)
        return best and (best[0][0], best[1])

    def value(self, value: str) -> str:
        """The code that a free-entered value means, or UNMATCHED. An entry of the list as it stands comes before all slips."""
        t = normal(value).replace("_", " ")
        if len(same := self.exact.get(squeezed(t), ())) == 1:
            return next(iter(same))
        found = sizes(t)
        rest = t
        for a, b, _ in reversed(found):
            rest = rest[:a] + " " + rest[b:]
        words = _WORD.findall(rest)
        tried = [*words, *(_CODE.findall(rest) if self.figures else ())]
        if self.words > 1:  # names of several words are one in the dictionary
            parts = re.findall(r"[^\W_]+", rest)
            tried += ["".join(parts[i : i + k]) for k in range(2, self.words + 1) for i in range(len(parts) - k + 1)]
        best = None
        for word in tried:
            near = self.near(word)
            for size in [s for *_, s in found] or [None]:
                if near and (hit := self._of(near, size)) and (best is None or hit < best):
                    best = hit
        return best[1] if best else UNMATCHED

    def mention(self, text: str) -> str | None:
        """The code of the engine that a running text mentions: an alias, or a name right beside a displacement."""
        t = normal(text).replace("_", " ")
        best, found = None, None
        places = [m.span() for m in _WORD.finditer(t)]
        if self.figures:
            places += [m.span() for m in _CODE.finditer(t)]
        if self.words > 1:  # names of several words are one in the dictionary
            parts = [m.span() for m in re.finditer(r"[^\W_]+", t)]
            places += [(parts[i][0], parts[i + k - 1][1]) for k in range(2, self.words + 1) for i in range(len(parts) - k + 1)]
        for start, end in places:
            near = self.near(t[start:end] if t[start:end].isalnum() else re.sub(r"[\W_]+", "", t[start:end]))
            if not near:
                continue
            if found is None:
                found = sizes(t)
            i = bisect_left(found, (start,))
            options: list[str | int | None] = [size for a, b, size in found[max(0, i - 1) : i] if b <= start and re.fullmatch(_BETWEEN, t[b:start])]
            i = bisect_left(found, (end,))
            options += [size for a, b, size in found[i : i + 1] if re.fullmatch(_BETWEEN, t[end:a])]
            if any(name in self.alone for _, name in near):
                options.append(None)
            for size in options:
                if (hit := self._of(near, size)) and (best is None or hit < best):
                    best = hit
        return best[1] if best else None


def names(engines: DataFrame) -> Names:
    """The dictionary of a reference table (engine_code, displacement_cc, search_alias); rows without a code count for nothing."""
    rows = engines.select("engine_code", "displacement_cc", "search_alias").where("engine_code is not null").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError("the reference list is larger than may be broadcast")
    return Names(sorted((r[0], r[1], sorted(a for a in (r[2] or []) if a)) for r in rows))


def _udf(spark: SparkSession, reference: Names, method: str):
    shared = spark.sparkContext.broadcast(reference)

    @F.pandas_udf("string")
    def resolve(values: pd.Series) -> pd.Series:
        f = getattr(shared.value, method)
        if method == "value":  # entered values repeat: each distinct one of a batch is resolved once
            return values.map({v: f(v) for v in values.dropna().unique()})
        return values.map(f, na_action="ignore")

    return resolve


def blank(value: Column) -> Column:
    return value.isNull() | F.rlike(value, F.lit(r"^[\s\p{Z}\p{Cf}]*$"))


def resolve_values(df: DataFrame, value: str, reference: Names, into: str = "engine_code") -> DataFrame:
    """df with the code that each entered value means, or UNMATCHED; rows whose value is null or blank are left out.

    No shuffle, and none is needed however skewed the values: the dictionary goes to the rows. Repeated rows are kept;
    a column of df named like `into` is replaced.
    """
    f = _udf(df.sparkSession, reference, "value")
    return df.where(~blank(F.col(f"`{value}`"))).withColumn(into, f(F.col(f"`{value}`")))


def resolve_mentions(df: DataFrame, text: str, reference: Names, into: str = "engine_code") -> DataFrame:
    """df with the code of the engine that each text mentions; rows that mention none (or have no text) are left out."""
    f = _udf(df.sparkSession, reference, "mention")
    return df.where(f"`{text}` is not null").withColumn(into, f(F.col(f"`{text}`"))).where(F.col(into).isNotNull())


def unmatched(df: DataFrame, value: str, code: str = "engine_code") -> DataFrame:
    """(value, n): the entered values that fit no entry of the reference, most frequent first."""
    return df.where(F.col(code) == UNMATCHED).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value)
