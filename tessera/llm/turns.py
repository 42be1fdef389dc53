"""Speech transcripts into clean speaker turns.

Templates are mined with a token tree of fixed depth: every mark (any sign that is neither letter, digit nor blank) that
follows up to three words is a site, and its path in the tree is how the mark stands - around the words or behind them -,
the mark, what opens before the words, and how many they are. Counting the sites of each path over all transcripts, and
those whose words name somebody of the roster, shows which layouts hold speakers: no mark is known beforehand. Figures
are treated alike: each shape of figures and marks is counted, and how often it tells the start of its segment; shapes
that do are clock times. Only layouts inferred in this way are used to extract; then turns are merged.

The tree's leaves are bounded by its depth and the number of marks, so the few inferred layouts fit the driver whatever
the size of the data. A transcript is one row, so extraction needs no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a label at most.
LABEL_WORDS = 3
#: A layout holds speakers if at least this share of its sites names one of the roster.
SPEAKER_SHARE = 0.1
#: A shape of figures is a clock time if at least this share tells the start of its segment, within so many seconds.
CLOCK_SHARE, CLOCK_SECONDS = 0.5, 2
#: Marks of speech itself; after them names are spoken too, so that a few sites tell nothing yet.
SPEECH_MARKS = ",;!?…\"“”„«»‘"
#: Sites without a name that are added to those of a layout with a mark of speech.
PRIOR = 20
#: Names that the roster may have to be sent to every task.
MOST_SPEAKERS = 100_000

#: Figures with marks between them, perhaps in brackets.
FIGURES = re.compile(r"[\[(<{]?(?<![\w.,:])\d+(?:[:.,]\d+)+(?![\w:])[\])>}]?")
NOTE = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|<[^<>]*>|\*[^*]+\*|♪[^♪]*♪|[♪♫]+")
HESITATION = re.compile(r"(?:u+h+m*|u+m+|e+r+m*|h+m+|m+h*m+|a+h+m*|e+h+m*|o+h+|e{3,}|ı{2,}|ı+[hm]+|ä+h*m*|ö+h*m+|ö+h+|a{3,})", re.I)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: A word of a name, with the stop of an initial.
PART = r"[^\W\d_]+(?:-[^\W\d_]+)*\.?"
_PART = re.compile(PART)
#: A mark: a stop, an apostrophe and a hyphen inside a word are none.
MARK = re.compile(r"(?![.'’_])[^\w\s-]|-(?!(?<=[^\W\d_]-)[^\W\d_])")
NOTE_MARKS = re.compile(r"[\[(<*♪♫]")


@lru_cache(maxsize=200_000)
def hesitation(word: str) -> bool:
    return HESITATION.fullmatch(word) is not None


def shape(figures: str) -> str:
    return re.sub(r"\d+", "0", figures)


def tells(figures: str, start: float | None) -> bool:
    """Whether figures, read as hours, minutes and seconds or with a fraction, are the start of their segment."""
    if start is None or start != start:
        return False
    parts = [int(x) for x in re.findall(r"\d+", figures)]
    base = lambda xs: sum(x * 60**i for i, x in enumerate(reversed(xs)))
    return any(abs(base(xs) - start) <= CLOCK_SECONDS for xs in (parts, parts[:-1]) if len(xs) > 1)


def no_clock(text: str, shapes: frozenset[str]) -> str:
    return FIGURES.sub(lambda m: " " if shape(m[0]) in shapes else m[0], text) if shapes else text


def one_slip(word: str, name: str) -> bool:
    """Whether word is name with at most one letter lost, doubled, changed or two neighbours swapped."""
    if word == name:
        return True
    n, m, i = len(word), len(name), 0
    while i < min(n, m) and word[i] == name[i]:
        i += 1
    if n == m:
        return word[i + 1 :] == name[i + 1 :] or (word[i + 2 :] == name[i + 2 :] and word[i : i + 2] == name[i : i + 2][::-1])
    if n + 1 == m:
        return word[i:] == name[i + 1 :]
    return n == m + 1 and i > 0 and word[i + 1 :] == name[i:] and word[i] == word[i - 1]


class Roster:
    """Speakers by full or partial name, initials, any case, one slip."""

    def __init__(self, speakers: list[tuple[int, str]]):
        if len(speakers) > MOST_SPEAKERS:
            raise ValueError("more speakers than may be sent to every task")
        self.names = [(i, [w.casefold() for w in re.findall(r"[^\W\d_]+", n)]) for i, n in sorted(speakers)]
        self.parts: dict[str, set[int]] = {}
        for k, (_, words) in enumerate(self.names):
            for w in words:
                for d in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                    self.parts.setdefault(d, set()).add(k)
        self.seen: dict[str, int | None] = {}

    def _matches(self, word: str, exact: bool) -> dict[int, set[int]]:
        """Entry -> positions of the name parts that word means."""
        out: dict[int, set[int]] = {}
        if len(word) == 1:
            for k, (_, words) in enumerate(self.names):
                if at := {p for p, w in enumerate(words) if w[0] == word}:
                    out[k] = at
            return out
        near = {word} if exact else {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}
        for k in set().union(*(self.parts.get(d, ()) for d in near)):
            if at := {p for p, w in enumerate(self.names[k][1]) if (w == word if exact else len(word) > 2 and one_slip(word, w))}:
                out[k] = at
        return out

    def resolve(self, label: str) -> int | None:
        """The speaker a label names, or None if it names none, or no single one."""
        if label not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            words = [w.casefold() for w in re.findall(r"[^\W\d_]+", label)]
            found = None
            if len(words) == 1 and 2 <= len(words[0]) <= 3 and label.isupper():  # initials written together
                hits = [i for i, n in self.names if "".join(w[0] for w in n) == words[0]]
                found = hits[0] if len(hits) == 1 else None
            if found is None and words and any(len(w) > 1 for w in words) or len(words) > 1:
                for exact in (True, False):
                    hits = None
                    for p, w in enumerate(words):
                        m = {k for k, at in self._matches(w, exact or len(w) == 1).items() if len(words) == 1 or p in at}
                        hits = m if hits is None else hits & m
                    if hits:
                        found = self.names[min(hits)][0] if len(hits) == 1 else None
                        break
            self.seen[label] = found
        return self.seen[label]


def closes(opening: str, mark: str) -> bool:
    """Whether mark is the other side of opening: the same sign, or the mirrored one that follows it in Unicode."""
    if not opening:
        return False
    return opening == mark or bool(unicodedata.mirrored(opening)) and ord(mark) - ord(opening) in (1, 2) and bool(unicodedata.mirrored(mark))


def sites(text: str, marks: re.Pattern = MARK) -> Iterator[tuple[tuple[str, str, str, int], str, int, int]]:
    """(path in the tree, words, start, end) of each site of a line, left to right.

    Path: `around` or `behind`, the mark with the blanks beside it, the opening mark, number of words. Words with a mark
    around them are a site as a whole; of words with a mark behind them at most the last LABEL_WORDS are.
    """
    for found in marks.finditer(text):
        mark, end = found[0], found.start()
        chunks = text[:end].rsplit(None, LABEL_WORDS)  # no more words than chunks are looked at
        start = stop = None
        n = 0
        for m in reversed(list(_PART.finditer(text, len(chunks[0]) if len(chunks) > LABEL_WORDS else 0, end))):
            if n == LABEL_WORDS or (gap := text[m.end() : end if start is None else start]) and (not gap.isspace() or start is not None and len(gap) > 1):
                break
            start, n = m.start(), n + 1
            stop = stop or m.end()
        if start and (text[start - 1].isalnum() or text[start - 1] in "_'’-"):  # the rest of a longer word
            cut = _PART.match(text, start)
            n -= 1
            start = next((m.start() for m in _PART.finditer(text, cut.end(), end)), None) if n else None
        if start is None:
            continue
        before = start
        while before and text[before - 1].isspace():
            before -= 1
        opening = text[before - 1] if before and not text[before - 1].isalnum() and text[before - 1] not in ".'’_" else ""
        if closes(opening, mark):
            yield ("around", mark, opening, n), text[start:stop], before - 1, end + 1
        else:
            after = text[end + 1 : end + 2]
            yield ("behind", (" " if stop < end else "") + mark + (" " if not after or after.isspace() else "0" if after.isdigit() else ""), opening, n), text[start:stop], start, end + 1


@lru_cache(maxsize=200_000)
def beginnings(words: str) -> tuple[int, ...]:
    return tuple(m.start() for m in _PART.finditer(words))


def named(words: str, roster: Roster, whole: bool) -> tuple[int, int] | None:
    """(speaker, where in words the label begins) of the words of a site; unless whole, the last few of them may be the label."""
    starts = beginnings(words)
    for k in starts[:1] if whole else starts:
        if (found := roster.resolve(words[k:])) is not None:
            return found, k
    return None


def mine(videos: DataFrame, roster: Roster) -> DataFrame:
    """(kind, mark, opening, words, n, hits): how often each leaf of the token tree occurs, and how often it holds what it should.

    Kinds `around` and `behind` count names of the roster; of kind `clock` mark is a shape of figures, and those are
    counted that tell the start of their segment.
    """
    lines = videos.select(F.explode("transcript_segments").alias("s")).where("s.text is not null").select("s.text", "s.start")
    shared = videos.sparkSession.sparkContext.broadcast(roster)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, hits = Counter(), Counter()
            for text, start in zip(b["text"], b["start"]):
                clock = []
                for m in FIGURES.finditer(text):
                    n["clock", shape(m[0]), "", 0] += 1
                    if tells(m[0], start):
                        hits["clock", shape(m[0]), "", 0] += 1
                        clock.append(shape(m[0]))
                for path, words, _, _ in sites(no_clock(text, frozenset(clock))):
                    n[path] += 1
                    hits[path] += named(words, shared.value, path[0] == "around") is not None
            yield pd.DataFrame([(*path, k, hits[path]) for path, k in n.items()], columns=["kind", "mark", "opening", "words", "n", "hits"])

    found = lines.mapInPandas(leaves, "kind string, mark string, opening string, words int, n long, hits long")
    return found.groupBy("kind", "mark", "opening", "words").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


class Layouts:
    """What was inferred from the tree: marks around and behind labels, shapes of clock times."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.clock = frozenset(mark for kind, mark, _ in rows if kind == "clock")
        self.labels = {(kind, mark, opening) for kind, mark, opening in rows if kind != "clock"}
        #: The marks that may end a label; no other has to be looked at.
        signs = {c for _, mark, _ in self.labels for c in mark if not c.isspace() and c != "0"}
        self.marks = re.compile(rf"(?=[{re.escape(''.join(sorted(signs)))}])(?:{MARK.pattern})" if signs else "(?!)")

    def holds(self, path: tuple[str, str, str, int]) -> bool:
        return (path[0], path[1], path[2] if path[0] == "around" else "") in self.labels


def infer(leaves: DataFrame) -> Layouts:
    """The layouts whose slots hold what they should; a mark behind a label is judged whatever opens before it."""
    opening = F.when(F.col("kind") == "around", F.col("opening")).otherwise("")
    per = leaves.groupBy("kind", "mark", opening.alias("opening")).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    spoken = F.lit(SPEECH_MARKS).contains(F.trim(F.regexp_replace("mark", "0$", "")))
    n = F.col("n") + F.when(spoken & (F.col("kind") != "clock"), F.lit(PRIOR)).otherwise(F.lit(0))
    share = F.when(F.col("kind") == "clock", CLOCK_SHARE).otherwise(SPEAKER_SHARE)
    return Layouts([tuple(r) for r in per.where((F.col("hits") > 0) & (F.col("hits") >= share * n)).select("kind", "mark", "opening").collect()])


def parts(text: str, roster: Roster, layouts: Layouts):
    """The line as a sequence of ('label', speaker) and ('word', None)."""
    text = no_clock(text, layouts.clock)
    at = 0
    labels = []
    for path, words, start, end in sites(text, layouts.marks):
        if layouts.holds(path) and (found := named(words, roster, path[0] == "around")):
            labels.append((start if path[0] == "around" else start + found[1], end, found[0]))
    for a, z, who in [*labels, (len(text), len(text), None)]:
        clean = NOTE.sub(" ", text[at:a]) if NOTE_MARKS.search(text, at, a) else text[at:a]
        if any(not hesitation(w) for w in WORD.findall(clean)):
            yield "word", " ".join(clean.replace(">>", " ").split())
        if who is not None:
            yield "label", who
        at = z


def strip_hesitation(text: str) -> str:
    """The words of a stretch without hesitation sounds (and the comma that goes with one)."""
    kept = [w for w in text.split() if not hesitation(w.strip(".,…!?;:—–-"))]
    return " ".join(kept)


def turns(videos: DataFrame, speakers: DataFrame) -> DataFrame:
    """(video_id, turn_no, speaker_id, start_ms, words): the turns of each video's transcript_segments, in order.

    Segments are taken by start, equal ones (start and text) once, ties in their stored order; segments without a text
    or a start are left out; a video whose segments are null, empty or without words has no turn. A label holds until
    the next one, also across segments; speech before the first label has a null speaker. Rows repeated under one
    video_id give their turns each, so a caller reads a key once. Extra columns are ignored.
    """
    spark = videos.sparkSession
    rows = speakers.where("speaker_id is not null and full_name is not null").select("speaker_id", "full_name").distinct().limit(MOST_SPEAKERS + 1).collect()
    roster = Roster([(r[0], r[1]) for r in rows])
    videos = videos.select("video_id", "transcript_segments").where("size(transcript_segments) > 0")
    layouts = infer(mine(videos, roster))
    shared = spark.sparkContext.broadcast((roster, layouts))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roster, layouts = shared.value
        for b in batches:
            out = []
            for video, segments in zip(b["video_id"], b["transcript_segments"]):
                seen, ordered = set(), []
                for s in segments:
                    if s is None or s["text"] is None or s["start"] is None or s["start"] != s["start"] or (s["start"], s["text"]) in seen:
                        continue
                    seen.add((s["start"], s["text"]))
                    ordered.append(s)
                ordered.sort(key=lambda s: s["start"])
                stretches, who = [], None
                for s in ordered:
                    for kind, x in parts(s["text"], roster, layouts):
                        if kind == "label":
                            who = x
                        else:
                            stretches.append((who, s["start"], x))
                for k, (speaker, group) in enumerate(groupby(stretches, key=lambda x: x[0])):
                    group = list(group)
                    out.append((video, k + 1, speaker, round(group[0][1] * 1000), strip_hesitation(" ".join(x for *_, x in group))))
            frame = pd.DataFrame(out, columns=["video_id", "turn_no", "speaker_id", "start_ms", "words"])
            frame["speaker_id"] = frame["speaker_id"].astype("Int32")
            yield frame

    return videos.mapInPandas(extract, "video_id string, turn_no int, speaker_id int, start_ms long, words string")
