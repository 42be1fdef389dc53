"""One consistent form for texts that look alike: full-width forms, look-alike letters, odd blanks, invisible characters.

Two parts. The character tables below (built by rule from the Unicode data where a rule exists) map a text in SQL; what
a table can't express - composed against combining accents, ignorable characters - is left to the accent-sensitive
Unicode collation under which the mapped values are grouped. Each class gets a deterministic canonical member.

Visible differences stay: case, accents, dotless i, digits, punctuation, number of blanks, line breaks.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

# Letters of other scripts that look like Latin ones.
LETTERS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
    "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v", "ό": "ó",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "γ": "y", "ρ": "p", "υ": "u", "ι": "ı", "ί": "í", "ύ": "ú", "κ": "к", "µ": "μ",
    "ɑ": "a", "ɡ": "g", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
# Small capitals that have the shape of the small letter.
SMALL_CAPITALS = "COSVWZ"
# Hyphens that look like the ASCII one; dashes are longer and stay.
HYPHENS = "‐‑﹣－"
# Characters without width that are not format characters.
INVISIBLE_MARKS = "͏ᅟᅠ឴឵ㅤﾠ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"


@cache
def tables() -> tuple[dict[str, str], str, dict[str, str]]:
    """(character -> one character, characters that are dropped, character -> several), by rule over the whole of Unicode."""
    one, drop, many = dict(LETTERS) | dict.fromkeys(HYPHENS, "-"), set(INVISIBLE_MARKS), {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        kind, d = unicodedata.category(c), unicodedata.decomposition(c)
        if ord(c) > 0x1FFFF and not 0xE0000 <= ord(c) <= 0xE0FFF:
            continue  # ideographs, private use and unassigned
        if kind == "Zs":
            one[c] = " "
        elif kind == "Cf" and "ARABIC" not in unicodedata.name(c, "") or kind == "Mn" and "VARIATION SELECTOR" in unicodedata.name(c, ""):
            drop.add(c)
        elif d.startswith(("<wide>", "<narrow>")) and c not in one:
            one[c] = unicodedata.normalize("NFKC", c)
        elif d.startswith("<font>") and kind[0] in "LN" or d.startswith("<compat>") and "ROMAN NUMERAL" in unicodedata.name(c, ""):
            x = unicodedata.normalize("NFKC", c)  # bold, italic, script, double-struck letters and digits; numerals that are letters
            if len(x) == 1:
                one[c] = one.get(x, x)
        elif (name := unicodedata.name(c, "")).startswith("LATIN LETTER SMALL CAPITAL ") and name[27:] in SMALL_CAPITALS:
            one[c] = name[27:].lower()
        elif d.startswith("<compat>") and kind in ("Ll", "Lu", "Lt") and len(x := unicodedata.normalize("NFKC", c)) > 1 and x.isalpha():
            many[c] = x  # joined letters
    one = {k: LETTERS.get(v, v) for k, v in one.items()}  # a bold Greek letter looks like a Latin one, too
    return {k: v for k, v in one.items() if len(v) == 1}, "".join(sorted(drop - set(one))), many


@cache
def _table() -> dict[int, str | None]:
    one, drop, many = tables()
    return {ord(k): v for k, v in (one | many).items()} | {ord(c): None for c in drop}


def consistent(text: str) -> str:
    """The consistent form of one text, in Python; for callers that already run there."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_table()))


def plain(text: Column) -> Column:
    """Whether a text is ASCII throughout, and so in the consistent form already."""
    return F.length(text) == F.octet_length(text)


def mapped(text: Column) -> Column:
    """The look-alike map in SQL: one-to-one and dropped characters by translate, joined letters by replace; ASCII texts are passed on."""
    one, drop, many = tables()
    keys = sorted(one)
    out = F.translate(text, "".join(keys) + drop, "".join(one[k] for k in keys))
    for k, v in sorted(many.items()):
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(plain(text), text).otherwise(out)


def digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def same_length(text: Column) -> Column:
    """The one-to-one part alone: blanks, widths, hyphens and look-alike letters in one form, every position kept."""
    one, _, _ = tables()
    keys = sorted(one)
    return F.translate(text, "".join(keys), "".join(one[k] for k in keys))


def classes(df: DataFrame, text: str, key: str = "text_class") -> DataFrame:
    """df with the class of each row's text under the consistent form, and the class's canonical member.

    Adds `<key>` (binary, equal exactly for texts that look alike; null for a null text) and `<key>_canonical` (the most
    frequent mapped text of the class, the smallest on a tie). Rows and all other columns are kept as they are.

    How: the distinct mapped texts are counted first (exact copies, however many, are one row from here on), grouped under
    the accent-sensitive, case-sensitive collation UNICODE, and the class is joined back by the digest of the mapped text.
    The empty text is a class like any other. Added columns replace columns of the same name.
    """
    hashed = df.drop(key, f"{key}_canonical").withColumn("__mapped", mapped(F.col(f"`{text}`"))).withColumn("__digest", digest(F.col("__mapped")))
    members = _members(hashed).select("__digest", F.col("class").alias(key), F.col("canonical").alias(f"{key}_canonical"))
    return hashed.drop("__mapped").join(members, "__digest", "left").drop("__digest")


def _members(hashed: DataFrame) -> DataFrame:
    """(__digest, class, canonical) of every distinct mapped text: the canonical member of its class under the collation, and its digest."""
    distinct = hashed.where("__digest is not null").groupBy("__digest").agg(F.first("__mapped").alias("m"), F.count("*").alias("n"))
    rank = F.struct(-F.col("n"), F.collate("k", "UTF8_BINARY"))
    w = Window.partitionBy("k")
    return distinct.select("__digest", F.collate("m", "UNICODE").alias("k"), "n").select(
        "__digest", F.min_by("__digest", rank).over(w).alias("class"), F.min_by(F.collate("k", "UTF8_BINARY"), rank).over(w).alias("canonical")
    )


def look_alike_pairs(df: DataFrame, *scope: str, id: str, text: str) -> DataFrame:
    """(scope..., id_lo, id_hi): pairs of rows whose stored texts differ but belong to one class; scope separates sources.

    Ids are compared in their own type. Every row gets the digest of its class's canonical member. Classes with a single
    stored text - the great mass of rows and of exact copies - leave before the join, so only rows with a partner take
    part in it. Null texts and null ids have no partner.
    """
    texts = df.select(*scope, F.col(id).alias("__id"), F.col(text).alias("__text")).where("__id is not null and __text is not null")
    hashed = texts.select("*", mapped(F.col("__text")).alias("__mapped"), digest(F.col("__text")).alias("__raw"))
    hashed = hashed.select("*", F.when(plain(F.col("__text")), F.col("__raw")).otherwise(digest(F.col("__mapped"))).alias("__digest"))
    rows = hashed.select(*scope, "__id", "__digest", "__raw").join(_members(hashed).select("__digest", F.col("class").alias("__class")), "__digest").drop("__digest")
    rows = cut(rows)  # ids and digests only; read three times below
    odd = rows.groupBy(*scope, "__class").agg(F.min("__raw").alias("a"), F.max("__raw").alias("b")).where("a <> b").select(*scope, "__class")
    rows = rows.join(odd, [*scope, "__class"], "left_semi")
    a, b = rows.select(*scope, "__class", F.col("__id").alias("id_lo"), F.col("__raw").alias("__ra")), rows.select(*scope, "__class", F.col("__id").alias("id_hi"), F.col("__raw").alias("__rb"))
    return a.join(b, [*scope, "__class"]).where("id_lo < id_hi and __ra <> __rb").select(*scope, "id_lo", "id_hi")
