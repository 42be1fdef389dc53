"""Languages of documents and of the segments of mixed ones, with a confidence.

Hierarchical discrimination over character n-grams: first the language family is predicted (one linear classifier a
family), then one-versus-one linear support vector machines separate the closely related languages within it. Training
takes a bounded sample of labelled sentences to the driver (MOST_SAMPLES); the models are vectors of DIMENSIONS weights.

A document's sentences (found by the operator of this subpackage, in SQL) are classified one by one. A sentence whose
own evidence is weak - a code, a name, a scrap of a few letters - takes the language of its neighbourhood.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.lookalikes import consistent
from tessera.llm.sentences import sentence_spans

#: Labelled sentences that training takes at most, smallest sample ids first.
MOST_SAMPLES = 20_000
#: Length of the n-gram vectors.
DIMENSIONS = 1 << 17
#: Orders of the character n-grams.
ORDERS = (1, 2, 3, 4, 5)
#: A sentence with fewer letters than this, or less confidence, is judged with its neighbours.
FEW_LETTERS, WEAK = 6, 0.5
#: A sentence of less confidence than this takes the language of a sentence next to it if that is of the same family.
CLOSE_CALL = 0.58

#: Label of text in none of the known languages.
OTHER = "und"
#: A sentence with more than this share of letters of scripts that its language isn't written in is in none of the known ones,
FOREIGN = 0.5
#: and so is one of at least MANY letters with more than this share of letters, and more than two, that no sample of its language holds.
UNSEEN, MANY = 0.04, 25

# Families of the languages.
FAMILIES = {"en": "germanic", "de": "germanic", "fr": "romance", "es": "romance", "pt": "romance", "tr": "turkic", "ru": "slavic", "ja": "east_asian", "zh": "east_asian", "th": "tai", "hi": "indic"}
#: Script that a text must hold some of to be in a family at all; families not listed may be in any.
SCRIPTS = {"east_asian": r"[\u3040-\u30ff\u3400-\u9fff]", "tai": r"[\u0e00-\u0e7f]", "indic": r"[\u0900-\u097f]", "slavic": r"[\u0400-\u04ff]", "germanic": r"[a-z]", "romance": r"[a-z]", "turkic": r"[a-zıİ]"}
#: Scripts with few letters, of which samples hold all that are in use.
CASED = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
# Names and three-letter codes of the languages.
NAMES = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "portuguese": "pt", "turkish": "tr", "russian": "ru", "japanese": "ja", "chinese": "zh", "thai": "th", "hindi": "hi",
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "tur": "tr", "rus": "ru", "jpn": "ja", "zho": "zh", "chi": "zh", "tha": "th", "hin": "hi",
}
MISSING = ("", "und", "unknown", "null", "none", "n/a")

_CODE = re.compile(r"^\s*(?:#\s?[A-Z0-9]+|(?:re|ref)[.:]?\s*[A-Z0-9]{4,}|\S*\d\S{19,}|\S{40,})[.!?…]*\s*$", re.I)
_FIGURES, _SIGNS = re.compile(r"[a-z0-9.,:/-]*\d[a-z0-9.,:/-]*"), re.compile(r"[#<>\[\](){}*♪|=/\\@_]+")
_ASCII_CODE = re.compile(r"^[\x21-\x7e]*$")


def named_language(label: Column) -> Column:
    """Two-letter code that a label names (any case, with a region, three letters, or the English name); null if missing or odd."""
    t = F.lower(F.btrim(F.coalesce(label, F.lit(""))))
    head = F.regexp_extract(t, r"^([a-z]+)(?:[-_][a-z0-9_-]+)?$", 1)
    known = F.create_map(*[F.lit(x) for k, v in ({c: c for c in FAMILIES} | NAMES).items() for x in (k, v)])
    return F.when(t.isin(*MISSING), F.lit(None).cast("string")).otherwise(F.element_at(known, head))


def without_noise(text: str) -> str:
    """What tells the language: letters, one kind of digit, one kind of blank; codes and figures are left out."""
    return " " + " ".join(_SIGNS.sub(" ", _FIGURES.sub(" 0 ", text)).split()) + " "


def is_code(sentence: str) -> bool:
    s = sentence.strip()
    return bool(_CODE.match(s)) and bool(_ASCII_CODE.match(re.sub(r"\s", "", s)))


def letters(text: str) -> int:
    return sum(map(str.isalpha, text))


class Ngrams:
    """Hashed n-grams of many texts at once, without a loop over characters."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        #: Of each order, the row and the slot of every n-gram, row by row.
        self.orders: list[tuple[np.ndarray, np.ndarray]] = []
        h = np.zeros(len(chars), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(chars) < n:
                break
            h = (h[: len(chars) - n + 1] * np.uint64(0x100000001B3)) ^ (chars[n - 1 :] + np.uint64(n))
            if n in ORDERS:
                same = row[: len(h)] == row[n - 1 :]
                mixed = h[same] * np.uint64(0x9E3779B97F4A7C15)
                self.orders.append((row[: len(h)][same], (mixed >> np.uint64(40)).astype(np.int64) % DIMENSIONS))
        self.count = len(texts)

    @property
    def row(self) -> np.ndarray:
        return np.concatenate([r for r, _ in self.orders]) if self.orders else np.empty(0, dtype=np.int64)

    @property
    def slot(self) -> np.ndarray:
        return np.concatenate([s for _, s in self.orders]) if self.orders else np.empty(0, dtype=np.int64)

    def scores(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Rows x classifiers: mean weight of a text's n-grams (so that length doesn't matter) and bias; weights: classifiers x slots."""
        n, out = np.zeros(self.count), np.zeros((self.count, len(weights)))
        for row, slot in self.orders:
            for a in range(0, len(row), 400_000):  # so that memory stays flat; a text may be parted
                r, s = row[a : a + 400_000], slot[a : a + 400_000]
                first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                n[r[first]] += np.diff(np.append(first, len(r)))
                for k, w in enumerate(weights):
                    out[r[first], k] += np.add.reduceat(w[s], first)
        return out / np.sqrt(np.maximum(1, n))[:, None] + bias


def train_linear(grams: Ngrams, y: np.ndarray, epochs: int = 40, c: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear SVM (hinge loss) by dual coordinate descent on root-normalised n-gram counts; y in {-1, 1}."""
    order = np.argsort(grams.row, kind="stable")
    slot, edges = grams.slot[order], np.searchsorted(grams.row[order], np.arange(grams.count + 1))
    w, b = np.zeros(DIMENSIONS), 0.0
    rows = []
    for i in range(grams.count):
        s, k = np.unique(slot[edges[i] : edges[i + 1]], return_counts=True)
        x = k / np.sqrt(max(1, k.sum()))
        rows.append((s, x, float(x @ x) + 1.0))
    alpha = np.zeros(grams.count)
    balance = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * c
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(grams.count):
            s, x, norm = rows[i]
            g = y[i] * (w[s] @ x + b) - 1
            new = min(max(alpha[i] - g / norm, 0.0), balance[i])
            if (d := new - alpha[i]) != 0.0:
                w[s] += d * y[i] * x
                b += d * y[i]
                alpha[i] = new
    return w, b


@lru_cache(maxsize=200_000)
def script(c: str) -> str:
    """The script of a letter as its Unicode name begins; empty for what is no letter."""
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "").split()
    return name[0] if name else ""


class Alphabets:
    """Scripts and letters that the samples of each language hold."""

    def __init__(self, samples: list[tuple[str, str]]):
        count: dict[str, Counter] = {}
        self.letters: dict[str, set[str]] = {}
        for lang, text in samples:
            low = unicodedata.normalize("NFKC", text).lower()
            self.letters.setdefault(lang, set()).update(low)
            count.setdefault(lang, Counter()).update(filter(None, map(script, low)))
        self.scripts = {lang: {x for x, n in c.items() if n >= 0.01 * c.total()} for lang, c in count.items()}
        self.main = {lang: c.most_common(1)[0][0] for lang, c in count.items() if c}

    def strange(self, lang: str, text: str) -> float:
        """The share of letters that tells that text is not in lang after all; 0 if it may be."""
        if text.isascii() and "LATIN" in self.scripts.get(lang, ()):
            return 0.0
        # most texts hold nothing but letters of the samples, or others of the same scripts
        odd = set(text.lower()) - self.letters[lang]
        if not any(c.isalpha() and (script(c) not in self.scripts.get(lang, ()) or self.main.get(lang) in CASED) for c in odd):
            return 0.0
        n = Counter(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalpha())
        if n.total() < FEW_LETTERS:
            return 0.0
        foreign = sum(k for c, k in n.items() if script(c) not in self.scripts.get(lang, ()) and script(c) != "LATIN")
        if foreign > FOREIGN * n.total():
            return foreign / n.total()
        main = self.main.get(lang)
        own = sum(k for c, k in n.items() if script(c) == main)
        unseen = [k for c, k in n.items() if script(c) == main and c not in self.letters[lang]]
        return 0.5 + sum(unseen) / own / 2 if main in CASED and own >= MANY and sum(unseen) > max(2, UNSEEN * own) else 0.0


class Classifier:
    """Family first, then one-versus-one machines within the family; what is in none of the languages is OTHER."""

    def __init__(self, samples: list[tuple[str, str]], epochs: int = 40):
        langs = sorted({lang for lang, _ in samples})
        if not langs:
            raise ValueError("no labelled sentence to learn from")
        family = {lang: FAMILIES.get(lang, lang) for lang in langs}
        self.families = sorted(set(family.values()))
        self.alphabets = Alphabets(samples)
        self.members = {f: [x for x in langs if family[x] == f] for f in self.families}
        texts = [without_noise(consistent(t).lower()) for _, t in samples]
        label = [lang for lang, _ in samples]
        grams = Ngrams(texts)
        y = np.array([self.families.index(family[x]) for x in label])
        fitted = [train_linear(grams, np.where(y == k, 1.0, -1.0), epochs) for k in range(len(self.families))]
        self.duels: dict[str, list[tuple[str, str]]] = {f: list(combinations(members, 2)) for f, members in self.members.items()}
        #: The machines of a family's duels, as columns behind those of the families.
        self.column: dict[str, int] = {}
        for f, duels in self.duels.items():
            self.column[f] = len(fitted)
            for a, b in duels:
                own = [i for i, x in enumerate(label) if x in (a, b)]
                fitted.append(train_linear(Ngrams([texts[i] for i in own]), np.array([1.0 if label[i] == a else -1.0 for i in own]), epochs))
        self.weights = np.stack([w for w, _ in fitted]).astype(np.float32)
        self.bias = np.array([b for _, b in fitted])

    def predict(self, texts: list[str], forms: list[str] | None = None) -> list[tuple[str, float]]:
        """(language, confidence in 0..1) of each text; ('', 0) for one without letters, OTHER for one in another script or alphabet. forms: their consistent forms, where known."""
        clean = [without_noise(t.lower()) for t in (forms if forms is not None else map(consistent, texts))]
        grams = Ngrams(clean)
        sure = lambda x: 1 / (1 + np.exp(-3 * np.clip(x, -10, 10)))
        every = grams.scores(self.weights, self.bias)  # families and duels in one pass
        scores = every[:, : len(self.families)].copy()
        ascii = np.array([t.isascii() for t in texts], dtype=bool)
        for k, f in enumerate(self.families):
            if f in SCRIPTS and not re.search(SCRIPTS[f], "x"):
                scores[ascii, k] = -10.0
                held = re.compile(SCRIPTS[f], re.I)
                at = np.flatnonzero(~ascii)
                scores[[i for i in at.tolist() if not (held.search(clean[i]) or held.search(texts[i]))], k] = -10.0
            elif f in SCRIPTS:
                held = re.compile(SCRIPTS[f], re.I)
                # look-alikes and full-width letters count as what they look like, but Cyrillic as itself
                scores[[not (held.search(c) or held.search(t)) for c, t in zip(clean, texts)], k] = -10.0
        first = scores.argmax(axis=1)
        ranked = np.sort(scores, axis=1)
        gap = sure(ranked[:, -1] - ranked[:, -2]) if scores.shape[1] > 1 else np.ones(len(texts))
        lang = np.array([self.members[f][0] for f in self.families])[first] if len(texts) else np.empty(0)
        lang, confidence = lang.astype(object), np.array(gap)
        for k, f in enumerate(self.families):
            own = np.flatnonzero(first == k)
            if not self.duels[f] or not len(own):
                continue
            margins = every[own, self.column[f] : self.column[f] + len(self.duels[f])]
            members = self.members[f]
            votes = np.zeros((len(own), len(members)))
            for d, (a, b) in enumerate(self.duels[f]):
                p = sure(margins[:, d])
                votes[:, members.index(a)] += p
                votes[:, members.index(b)] += 1 - p
            lang[own] = np.array(members, dtype=object)[votes.argmax(axis=1)]
            confidence[own] *= votes.max(axis=1) / max(1, len(members) - 1)
        strange = [self.alphabets.strange(str(x), t) for x, t in zip(lang, texts)]
        blank = [not any(map(str.isalpha, t)) for t in clean]
        return [("", 0.0) if b else (OTHER, s) if s else (str(x), float(c)) for x, c, b, s in zip(lang, confidence, blank, strange)]


def train(samples: DataFrame, most: int = MOST_SAMPLES) -> Classifier:
    """A classifier from lang_samples(sample_id, lang, text), of the `most` smallest sample ids."""
    rows = samples.where("lang is not null and text is not null").select("sample_id", "lang", "text").orderBy("sample_id").limit(most).collect()
    return Classifier([(r["lang"], r["text"]) for r in rows])


def decide(guesses: list[tuple[str, float, int]], least: float = WEAK) -> list[tuple[str, float]]:
    """Languages of a text's sentences in order, from (language, confidence, letters) of each.

    A sentence of few letters or weak evidence takes the language of the surest sentence next to it (before or after),
    unless it is all there is; so does one that is a close call between that language and a related one. Sentences
    without letters have none.
    """
    family = lambda lang: FAMILIES.get(lang, lang)
    sure = [i for i, (lang, c, n) in enumerate(guesses) if lang and c >= CLOSE_CALL and n >= FEW_LETTERS]
    if sure:
        settled, s = [], 0
        for i, (lang, c, n) in enumerate(guesses):
            while s + 1 < len(sure) and sure[s + 1] < i:
                s += 1
            j = min((sure[s], sure[min(s + 1, len(sure) - 1)]), key=lambda j: (abs(i - j), -guesses[j][1]))
            other = guesses[j][0]
            settled.append((other, c, n) if lang and c < CLOSE_CALL and other != lang and family(other) == family(lang) else (lang, c, n))
        guesses = settled
    strong = [i for i, (lang, c, n) in enumerate(guesses) if lang and c >= least and n >= FEW_LETTERS]
    if not strong:
        total: dict[str, float] = {}
        for lang, c, n in guesses:
            if lang:
                total[lang] = total.get(lang, 0.0) + c * n
        top = max(sorted(total), key=total.get, default="")
        return [(top if lang else "", c) for lang, c, _ in guesses]
    out: list[tuple[str, float]] = []
    s = 0
    keep = set(strong)
    for i, (lang, c, _) in enumerate(guesses):
        if i in keep or not lang:
            out.append((lang, c))
            continue
        while s + 1 < len(strong) and strong[s + 1] < i:
            s += 1
        near = [j for j in (strong[s], strong[min(s + 1, len(strong) - 1)])]
        j = min(near, key=lambda j: (abs(i - j), -guesses[j][1]))
        out.append((guesses[j][0], min(c, guesses[j][1])))
    return out


SEGMENT = "seg_no int, start_char int, end_char int, lang string, confidence double"


def segments(df: DataFrame, text: str, classifier: Classifier) -> DataFrame:
    """One row per stretch of sentences in one language: df's columns but the text, and seg_no, start_char, end_char, lang, confidence.

    confidence is the mean of the stretch's sentences, weighted by letters. Texts that are null or hold no letter in a
    sentence (codes, logs, figures) give no row. Repeated rows are kept; columns of df with an added name are replaced.
    """
    added = [x.split()[0] for x in SEGMENT.split(", ")]
    kept = [c for c in df.columns if c not in added and c != text]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text")).where("__text is not null")
    spans = sentence_spans(F.col("__text"))
    # one flat array, so that the rules run once and no struct is turned into Python objects
    rows = rows.select("*", F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end_char"]))).alias("__spots"))
    shared = df.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for whole in batches:
            for at in range(0, len(whole), 500):  # a few hundred documents at a time, so that memory stays flat
                batch = whole.iloc[at : at + 500].reset_index(drop=True)
                owner, spots, texts, forms = [], [], [], []
                for i, (t, spot) in enumerate(zip(batch["__text"], batch["__spots"])):
                    for x, y in zip(spot[::2], spot[1::2]):
                        s = t[x:y]
                        form = consistent(s)
                        if not is_code(form):
                            owner.append(i)
                            spots.append((int(x), int(y)))
                            texts.append(s)
                            forms.append(form)
                guesses = model.predict(texts, forms)
                sizes = [letters(t) for t in texts]
                row, out, k = [], [], 0
                for i in range(len(batch)):
                    first = k
                    while k < len(owner) and owner[k] == i:
                        k += 1
                    told = decide([(*guesses[j], sizes[j]) for j in range(first, k)])
                    runs: list[list] = []
                    for (lang, c), j in zip(told, range(first, k)):
                        n = sizes[j]
                        if not lang or not n:
                            continue
                        if runs and runs[-1][2] == lang:
                            runs[-1][1] = spots[j][1]
                            runs[-1][3] += c * n
                            runs[-1][4] += n
                        else:
                            runs.append([*spots[j], lang, c * n, n])
                    row += [i] * len(runs)
                    out += [(no + 1, a, z, lang, c / n) for no, (a, z, lang, c, n) in enumerate(runs)]
                yield pd.concat([batch[kept].iloc[row].reset_index(drop=True), pd.DataFrame(out, columns=added)], axis=1)

    types = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), SEGMENT]))


def wrongly_labelled(df: DataFrame, id: str, text: str, label: str, classifier: Classifier, one: bool = False, every: bool = False) -> DataFrame:
    """(id, lang, confidence): the languages of every text whose label is missing or names another, or that holds several.

    With `one`, a text counts as being in the one language that most of its letters are in; with `every`, rightly
    labelled texts come out too, and what is in none of the known languages as OTHER.
    """
    found = segments(df.select(F.col(id).alias("__id"), F.col(text).alias("__t"), named_language(F.col(label)).alias("__named")), "__t", classifier)
    found = found if every else found.where(F.col("lang") != OTHER)
    weighed = found.select("__id", "__named", "lang", "confidence", (F.col("end_char") - F.col("start_char")).alias("n"))
    per = weighed.groupBy("__id", "lang").agg(F.first("__named").alias("named"), F.sum("n").alias("n"), (F.sum(F.col("confidence") * F.col("n")) / F.sum("n")).alias("confidence"))
    # a text has few languages, so its list is short whatever its length
    texts = per.groupBy("__id").agg(F.first("named").alias("named"), F.collect_list(F.struct("n", "lang", "confidence")).alias("all"))
    texts = texts.select("__id", "named", (F.slice(F.sort_array("all", asc=False), 1, 1) if one else F.col("all")).alias("all"))
    if every:
        return texts.select(F.col("__id").alias(id), F.inline("all")).select(id, "lang", "confidence")
    odd = texts.where((F.size("all") > 1) | F.col("named").isNull() | (F.col("named") != F.col("all")[0]["lang"]))
    return odd.select(F.col("__id").alias(id), F.inline("all")).select(id, "lang", "confidence")
