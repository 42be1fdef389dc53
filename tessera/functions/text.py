"""String and regex expressions: cleaning, tokens, pattern scores, classifiers. Columns in, columns out; no Python per row."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TURKISH = ("çğıöşüâîûÇĞİIÖŞÜ", "cgiosuaiucgiiosu")
URL = r"(?:https?://|www\.)[^\s]+"


def squeeze(c: Column) -> Column:
    """No-break spaces are blanks, runs of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(c, "   ", "   "), r"\s+", " "))


def transliterate(c: Column) -> Column:
    """Turkish letters to ASCII before lower-casing, so that dotted and dotless i meet."""
    return F.lower(F.translate(c, *TURKISH))


def strip_urls(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, URL, " "))


def strip_quotes(c: Column) -> Column:
    """Forum quotations: [quote]...[/quote] blocks and lines that begin with >."""
    return F.regexp_replace(F.regexp_replace(c, r"(?is)\[quote[^\]]*\].*?\[/quote\]", " "), r"(?m)^\s*>.*$", " ")


def sanitise(c: Column) -> Column:
    """Control characters that spreadsheets and JSON readers reject are dropped."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def html_to_text(c: Column) -> Column:
    """Visible text of an HTML page: script, style, navigation and frame dropped, tags stripped, entities of the five marks read."""
    t = F.regexp_replace(c, r"(?is)<(script|style|nav|footer|header)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(mark))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def canonical_url(c: Column) -> Column:
    """Without fragment, session parameters and page suffix; scheme and host in small letters."""
    t = F.regexp_replace(c, r"#.*$", "")
    t = F.regexp_replace(t, r"(?i)([?&])(?:(?:PHPSESSID|sid|s|session|utm_[a-z]+)=[^&]*(?:&|$))+", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"[?&]+$", ""), r"/(?:page-?\d+|p\d+)/?$", "/")
    return F.concat(F.lower(F.regexp_extract(t, r"^([a-zA-Z]+://[^/?]*)?", 1)), F.regexp_replace(t, r"^[a-zA-Z]+://[^/?]*", ""))


def url_id(c: Column) -> Column:
    """Last run of at least five digits of a URL, the usual place of a listing id."""
    return F.nullif(F.regexp_extract(c, r"(\d{5,})(?!.*\d{5,})", 1), F.lit(""))


def url_slug(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"/([^/?#]+?)(?:-\d{5,})?(?:/detail)?/?(?:[?#].*)?$", 1), F.lit(""))


def snippet(c: Column, n: int) -> Column:
    t = F.regexp_replace(c, r"[\r\n]+", " ")
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def script_safe_json(c: Column) -> Column:
    """JSON that may stand inside a script element."""
    t = F.to_json(c)
    for mark, escape in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        t = F.replace(t, F.lit(mark), F.lit(escape))
    return t


# -- patterns built from a lexicon (driver side, once)


def displacement_pattern(code: str) -> str:
    """1.4_TSI -> a pattern that allows comma or dot, an optional litre mark, blanks, dashes or nothing between."""
    size, _, name = code.partition("_")
    size = re.escape(size).replace(r"\.", "[.,]")
    return rf"(?iu)(?<![\p{{L}}\p{{N}}]){size}\s*(?:l|lt|litre)?[\s_-]*{re.escape(name)}(?![\p{{L}}\p{{N}}])" if name else rf"(?iu)(?<![\p{{L}}\p{{N}}.,]){size}(?![\p{{L}}\p{{N}}])"


def alias_pattern(alias: str) -> str:
    """An alias as a whole word; a blank may be a dash or missing, a dot a comma."""
    body = "".join(r"[\s-]*" if c.isspace() else "[.,]" if c == "." else re.escape(c) for c in alias.strip())
    return rf"(?iu)(?<![\p{{L}}\p{{N}}]){body}(?![\p{{L}}\p{{N}}])"


def flexible_pattern(phrase: str) -> str:
    """The words of a phrase with any white space between."""
    return r"(?iu)\b" + r"\s+".join(re.escape(w) for w in phrase.split()) + r"\b"


def one_of(words: Sequence[str], whole: bool = True) -> str:
    """An alternation of literal words, longest first."""
    body = "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return rf"(?iu)\b(?:{body})\b" if whole else f"(?iu)(?:{body})"


# -- scores and classes


def pattern_hits(c: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns occur (not how often); 0 for null."""
    return reduce(lambda a, b: a + b, [F.coalesce(c.rlike(p), F.lit(False)).cast("int") for p in patterns], F.lit(0))


def occurrences(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs as a substring."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def word_count(c: Column) -> Column:
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))


def keyword_density(c: Column, high: Sequence[str], low: Sequence[str], body: Sequence[str] = ()) -> Column:
    """(2 x high-value words + low-value words + body words found) / words."""
    found = lambda words: reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("int") for w in words], F.lit(0))
    return (F.lit(2) * found(high) + found(low) + found(body)) / F.greatest(word_count(c), F.lit(1))


def noise_dominated(c: Column, pattern: str, share: float) -> Column:
    return occurrences(c, pattern) / F.greatest(word_count(c), F.lit(1)) > share


def first_class(c: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first (name, pattern) rule whose pattern occurs."""
    out = F
    for name, pattern in rules:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise(otherwise)


def all_classes(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Names of all rules whose pattern occurs, in rule order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in rules]))


def mapped_group(c: Column, groups: Mapping[str, str], otherwise: str = "other", missing: str = "unknown") -> Column:
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return F.when(c.isNull() | (c == ""), missing).otherwise(F.coalesce(F.element_at(table, c), F.lit(otherwise)))


# -- tokens


def tokens(c: Column, keep_numbers: bool = False) -> Column:
    """Lower-cased words without URLs, punctuation and lone hyphens."""
    t = F.regexp_replace(F.lower(c), URL, " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\s-]" if keep_numbers else r"[^\p{L}\s-]", " ")
    t = F.trim(F.regexp_replace(t, r"(^|\s)-+(?=\s|$)", " "))
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def semantic_tokens(c: Column, synonyms: Mapping[str, str], composites: Mapping[str, Sequence[str]], stop: Sequence[str]) -> Column:
    """Words split at non-alphanumerics; composites taken apart, synonyms brought to one, stop words and short ones dropped."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    if composites:
        table = F.create_map(*[x for k, v in composites.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        words = F.flatten(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), F.array(w))))
    if synonyms:
        table2 = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
        words = F.transform(words, lambda w: F.coalesce(F.element_at(table2, w), w))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*(stop or [""])))


def token_bag(main: Column, more: Column, least: int = 3) -> Column:
    """Distinct tokens of main, those of more added where main has fewer than `least`."""
    return F.when(F.size(F.array_distinct(main)) >= least, F.array_distinct(main)).otherwise(F.array_distinct(F.concat(main, more)))


def join_compounds(c: Column, phrases: Sequence[str]) -> Column:
    """Phrases become one token each (words joined by _), the longest first."""
    for p in sorted(set(phrases), key=lambda p: (-len(p.split()), p)):
        c = F.regexp_replace(c, r"(?<![\p{L}\p{N}_])" + r"\s+".join(map(re.escape, p.split())) + r"(?![\p{L}\p{N}_])", "_".join(p.split()))
    return c


def join_tags(c: Column) -> Column:
    """array -> |a|b|; empty for an empty or null array."""
    return F.when(F.size(c) > 0, F.concat(F.lit("|"), F.array_join(c, "|"), F.lit("|"))).otherwise("")


def split_tags(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")


def text_blob(*columns: Column) -> Column:
    """Non-null texts joined and lower-cased, the haystack of a search over several fields."""
    return F.lower(F.concat_ws(" ", *columns))


def fill(template: str, **values: Column) -> Column:
    """A template with {name} slots filled from columns; null if any slot's column is null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else values[p].cast("string") for i, p in enumerate(parts) if i % 2 or p])


def generation_tokens(label: str) -> list[str]:
    """Spellings of a model generation: MK7 -> mk7, mk 7, mk-7, mark 7, vii, 7th gen; a half generation (MK7.5) has no numeral and no ordinal."""
    m = re.search(r"(\d+(?:\.\d+)?)", label)
    if not m:
        return [label.lower()]
    if "." in m[1]:
        return [f"mk{m[1]}", f"mk {m[1]}", f"mk-{m[1]}", f"mark {m[1]}", f"gen {m[1]}"]
    n = int(m[1])
    roman, rest = "", n
    for value, mark in ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while rest >= value:
            roman, rest = roman + mark, rest - value
    ordinal = f"{n}{'th' if 10 <= n % 100 <= 20 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"
    return [f"mk{n}", f"mk {n}", f"mk-{n}", f"mark {n}", f"mk{roman}", f"mk {roman}", f"gen {n}", f"{ordinal} gen", f"{ordinal} generation"]


def scope_tokens(names: Sequence[str], generation: str, years: tuple[int, int], facelift: int | None = None, others: Sequence[str] = ()) -> dict[str, list[str]]:
    """What tells that a text speaks of an entity: its names, the spellings of its generation and its model years; the years
    before and from a facelift on; and the spellings of the other generations, which tell that it speaks of something else."""
    span = list(map(str, range(years[0], years[1] + 1)))
    own = generation_tokens(generation)
    return {
        "names": [n.lower() for n in names], "generation": own, "years": span,
        "before_facelift": [y for y in span if facelift and int(y) < facelift], "after_facelift": [y for y in span if facelift and int(y) >= facelift],
        "others": [t for o in others for t in generation_tokens(o) if t not in own],
    }
