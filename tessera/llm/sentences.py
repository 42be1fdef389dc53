"""Sentence boundaries across languages and scripts, in SQL expressions throughout.

1. The text is brought to one notation that keeps every position (blanks, widths, look-alike letters).
2. Stops that end no sentence - decimals, URLs, initials, abbreviations, ordinals, stops inside quotations and brackets -
   are replaced by private-use placeholders of the same length.
3. A private-use mark is put after every terminator that ends a sentence, by rules for each kind of script, at blank
   lines, at Thai blanks and around code lines; the text is split at the marks.
4. Lengths of the pieces give each sentence's place in the stored text, from which the sentence is restored unchanged.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.lookalikes import plain, tables

#: Placeholders: a stop that ends nothing, a closing and an opening quotation mark, the end of a sentence, an invisible character, a full stop of a further script.
DOT, CLOSE, OPEN, END, GAP, STOP = (chr(0xE000 + i) for i in range(6))

#: White space that is left once every kind of blank is one.
WHITE = " \t\n\r"
# Abbreviations that go before a name or a word, so their stop never ends a sentence.
ALWAYS = """
Dr Mr Mrs Ms Prof St approx vs incl
Hr Fr Dipl Ing bzw ca
Sn Av Müh Doç yakl örn
Sr Sra Srta Dra Avda aprox ej
Mme ex env
проф прим
डॉ प्रो श्री
"""
# Abbreviations that go before a number.
BEFORE_NUMBER = """
No no Nos Nr fig Fig figs p pp ch sec vol art
núm pág págs tel nº
janv févr avr juil sept oct nov déc
Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec
см рис стр гл табл
नं
กม
"""
# Words after a closing quotation mark with which a Chinese or Japanese sentence goes on.
GOES_ON = "然后|于是|随后|接着|就|便|说|道|地|的|而|と|って|という|に|を|は|が|の|も|で|や"


@cache
def terminators() -> str:
    """Sentence terminators of scripts in which nothing but them looks like one: by the Unicode property, without those that have rules of their own."""
    import regex

    return "".join(c for c in map(chr, range(0x80, 0x10000)) if regex.match(r"\p{Sentence_Terminal}", c) and not unicodedata.normalize("NFKC", c) in ".!?" and c not in "。।॥…" and unicodedata.normalize("NFKC", c)[0] not in ".!?")


@cache
def _patterns() -> dict[str, str]:
    one, _, many = tables()
    gap = f"{GAP}{{0,3}}"
    joined = {v: k for k, v in many.items() if v in ("ff", "fi", "fl")}

    def tolerant(word: str) -> str:
        """word with invisible characters between its letters, accents in either spelling, joined letters, look-alikes."""
        out, i = [], 0
        while i < len(word):
            if word[i : i + 2] in joined:
                out.append(f"(?:{gap.join(word[i : i + 2])}|{joined[word[i : i + 2]]})")
                i += 2
                continue
            c = one.get(word[i], word[i])
            parts = unicodedata.normalize("NFD", c)
            out.append(c if len(parts) == 1 or not parts[0].isalpha() else f"(?:{c}|{parts[0]}{gap}{parts[1]}?)")
            i += 1
        return gap.join(out)

    words = lambda text: "|".join(sorted({tolerant(w) for w in text.split()}, key=len, reverse=True))
    return {"always": words(ALWAYS), "number": words(BEFORE_NUMBER), "gap": gap}


def _sub(column: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(column, pattern, replacement)


def _marked(text: Column) -> Column:
    """text, position by position, with placeholders, and with END marks inserted."""
    p = _patterns()
    one, drop, _ = tables()
    same = {c: " " for c in "\u0085\u000b\u000c"} | {c: "\n" for c in "\u2028\u2029"} | {c: "\u00b7" for c in (DOT, CLOSE, OPEN, END, GAP, STOP)}
    same = one | same | dict.fromkeys(drop, GAP) | dict.fromkeys(terminators(), STOP)
    unlike = plain(text) & ~F.contains(text, F.lit("\u000b")) & ~F.contains(text, F.lit("\u000c"))
    t = F.when(unlike, text).otherwise(F.translate(text, "".join(same), "".join(same.values())))
    # URLs: every stop with something after it (a small letter right after a stop starts no sentence anyway)
    t = _sub(t, r"((?:(?i:(?=[hw])\b(?:https?://|www(?=\.)))|(?!^)\G)[^\s.]*+)\.(?=[\p{L}\p{N}])", "$1" + DOT)
    # each alternative looks for the stop first and for what stands around it then, so that nothing is tried elsewhere:
    # decimals, times, versions, thousands; initials and single-letter abbreviations; a month or day in figures;
    # abbreviations, those before a number; two of single scripts
    stops = [
        r"(?<=[0-9]\.)(?=[0-9])",
        r"(?<=(?<![\p{L}\p{M}\p{N}])\p{L}\p{M}{0,16}\.)(?!" + p["gap"] + r"\.\.)",
        r"(?<=(?<![\p{L}\p{N}.,])[0-9]{1,2}\.)(?=\s+[\p{L}])",
        r"(?<=(?<![\p{L}\p{M}])(?iu:" + p["always"] + r")\.)",
        r"(?=\s*[0-9०-९#])(?<=(?<![\p{L}\p{M}])(?iu:" + p["number"] + r")\.)",
        r"(?<=कि\.?मी\.)",
        r"(?<=\p{InThai}\.)(?=\s*[\p{InThai}0-9])",
    ]
    t = _sub(t, r"\.(?:" + "|".join(stops) + ")", DOT)
    # quotation marks whose shape doesn't tell their side; up to the closing mark, within one paragraph
    within = lambda marks: rf"[^{marks}\n]*+(?:\n(?!\s*\n)[^{marks}\n]*+)*+"
    t = _sub(t, rf"„({within('„“”')})“", "„$1" + CLOSE)
    t = _sub(t, rf'"(?<![\p{{L}}\p{{N}}]")(?=[^\s"])({within(chr(34))})(?<=\S)"', OPEN + "$1" + CLOSE)
    # stops inside quotations and brackets, but those right before the closing mark: from an opening mark on, stop by stop
    sides = [OPEN + CLOSE, "“”", "„" + CLOSE, "«»", "「」", "『』", "()"]
    marks = "".join(dict.fromkeys("".join(sides)))
    begin = f"(?=[{''.join(a for a, _ in sides)}])(?:" + "|".join(rf"[{a}](?={within(a + z)}[{z}])" for a, z in sides) + ")"
    t = _sub(t, rf"((?:{begin}|(?!^)\G)[^{marks}.!?。…।{STOP}]*+)[.!?。…।{STOP}](?=[.!?。…।{STOP}]*+\s*+[^{marks}.!?。…।{STOP}\s])", "$1" + DOT)
    closers = rf"(?:[ ]?»|[”』」)’\]'{CLOSE}])*+"
    begins = rf"\p{{Lu}}\p{{Lt}}\p{{Lo}}«“„「『‘¿¡#{OPEN}"
    ends = [
        # a terminator, blanks, and something a sentence can begin with
        rf"[.!?…]++{closers}(?=\s++(?:$|[{begins}\p{{N}}(\[|•*<>-]))(?!\s*+(?:{GOES_ON}))",
        # no blank: after a word, not before a figure that may be the rest of a number
        rf"(?=[.!?…])(?<=[\p{{L}}\p{{M}}\p{{N}})”»\]{CLOSE}])[.!?…]++{closers}(?=[{begins}])(?!{GOES_ON})",
        rf"(?=[.!?…])(?<=[\p{{L}}\p{{M}})”»\]{CLOSE}])[.!?…]++{closers}(?=[0-9])",
        # ideographic full stop and danda
        rf"[。।॥]++[.!?…]*+{closers}(?!\s*+(?:{GOES_ON}|[\p{{Ll}}，、,;:；]))",
        # full stops of further scripts (Arabic, Armenian, Ethiopic, Burmese, Khmer, Tibetan ...)
        rf"{STOP}++[.!?…]*+{closers}(?!\s*+[\p{{Ll}},;:])",
    ]
    t = _sub(t, rf"(?=[.!?…。।॥{STOP}])(?:" + "|".join(ends) + ")", "$0" + END)
    # Thai: a blank between two Thai characters
    t = _sub(t, r"((?=\s)(?<=\p{InThai})\s++)(?=\p{InThai})", END + "$1")
    # blank lines, and lines that hold only a code or a log
    t = _sub(t, r"(\r?\n[ \t\r]*+\n)", END + "$1")
    code = r"(?:#[ ]?[\p{Lu}\p{N}]\S*|(?:[Rr]ef|[Rr]e)[.:]?[ ][\p{Lu}\p{N}]{4,}\S*|(?=\S*[0-9])[\x21-\x7e]{20,})"
    t = _sub(t, r"(?m)^([ \t]*" + code + r"[ \t]*)$", END + "$1" + END)
    return t


def sentence_spans(text: Column) -> Column:
    """array<struct<start int, end_char int>>: each sentence of text in order, as code points [start, end_char) of text.

    Empty for a null text and for one of blanks only. Blanks around a sentence belong to none.
    """
    pieces = F.split(_marked(text), END)
    block = 256  # prefix sums in two levels: linear for ordinary texts, n^1.5 for very long ones
    measured = F.transform(
        pieces,
        lambda s: F.struct(
            F.length(s).alias("n"),
            (F.length(s) - F.length(F.ltrim(s, F.lit(WHITE)))).alias("lead"),
            F.length(F.rtrim(s, F.lit(WHITE))).alias("body"),
        ),
    )
    # the parts are bound once, by a one-element array, instead of being repeated in the plan
    bound = F.transform(F.array(measured), lambda m: F.struct(m.alias("m"), F.transform(m, lambda x: x["n"]).alias("n")))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(
        bound,
        lambda b: F.struct(
            b["m"].alias("m"),
            b["n"].alias("n"),
            F.transform(F.sequence(F.lit(0), F.floor((F.size(b["n"]) - 1) / block).cast("int")), lambda k: add(F.slice(b["n"], k * block + 1, F.lit(block)))).alias("s"),
        ),
    )
    out = F.transform(
        blocks,
        lambda b: F.transform(
            b["m"],
            lambda x, i: F.transform(
                F.array(
                    add(F.slice(b["s"], F.lit(1), F.floor(i / block).cast("int")))
                    + add(F.slice(b["n"], (F.floor(i / block) * block + 1).cast("int"), (i % block).cast("int")))
                ),
                lambda at: F.struct((at + x["lead"]).cast("int").alias("start"), (at + x["body"]).cast("int").alias("end_char")),
            )[0],
        ),
    )[0]
    return F.when(text.isNull(), F.array().cast("array<struct<start:int,end_char:int>>")).otherwise(F.filter(out, lambda s: s["end_char"] > s["start"]))


def sentences(df: DataFrame, text: str) -> DataFrame:
    """One row per sentence: df's columns, sent_no (from 1), start_char, end_char, sentence.

    Null, empty and blank texts give no row; repeated rows give their sentences each; an empty table gives an empty one.
    Columns of df with one of the added names are replaced. Nothing is shuffled.
    """
    added = ("sent_no", "start_char", "end_char", "sentence")
    kept = [c for c in df.columns if c not in added or c == text]
    spans = df.select(*[F.col(f"`{c}`") for c in kept], F.posexplode(sentence_spans(F.col(f"`{text}`"))).alias("__no", "__span"))
    return spans.select(
        *[F.col(f"`{c}`") for c in kept if c not in added],
        (F.col("__no") + 1).alias("sent_no"),
        F.col("__span.start").alias("start_char"),
        F.col("__span.end_char").alias("end_char"),
        F.substring(F.col(f"`{text}`"), F.col("__span.start") + 1, F.col("__span.end_char") - F.col("__span.start")).alias("sentence"),
    )
