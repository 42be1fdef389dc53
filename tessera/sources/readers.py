"""Sources: nested JSON documents, JSON lines, CSV of unknown shape, compressed containers, lexicons, guarded tables, subtitles, HTML pages."""

from __future__ import annotations

import glob as globbing
import io
import os
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "array<struct<text:string,start:double,duration:double>>"
VIDEO = (
    "video_id string, title string, channel string, matched_queries array<string>, duration_seconds int, view_count_raw bigint, "
    f"video_type_category string, video_language string, transcript_status string, transcript_text string, transcript_segments {SEGMENTS}"
)


def video_corpus(spark: SparkSession, path: str, status: str = "ok") -> tuple[DataFrame, DataFrame]:
    """(videos with the status, others) of a nested {meta, videos: [...]} document."""
    doc = spark.read.schema(f"videos array<struct<{VIDEO}>>").option("multiLine", True).json(path)
    rows = doc.select(F.inline("videos"))
    ok = F.coalesce(F.col("transcript_status") == status, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def json_lines(spark: SparkSession, schema: str, *paths: str, tolerant: bool = True) -> DataFrame:
    """The first of the paths that exists; malformed lines are dropped (tolerant) or fail."""
    from tessera.session import exists

    path = next((p for p in paths if exists(spark, p)), None)
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def link_list(spark: SparkSession, path: str) -> DataFrame:
    """(link): links of a JSON-lines file, the first occurrence of each, in file order (position by file offset order)."""
    rows = spark.read.schema("link string").json(path).where("link is not null").select("link", F.monotonically_increasing_id().alias("pos"))
    return rows.groupBy("link").agg(F.min("pos").alias("pos")).orderBy("pos")


def resolve_column(columns: Sequence[str], *wanted: str) -> str | None:
    """The first column that a pattern names (exact before containing), whatever its case."""
    low = {c.lower().strip(): c for c in columns}
    for w in wanted:
        if w.lower() in low:
            return low[w.lower()]
    for w in wanted:
        for k, c in low.items():
            if re.search(w.lower().replace("*", ".*"), k):
                return c
    return None


def text_csv(spark: SparkSession, path: str, columns: Mapping[str, Sequence[str]], sep: str = ",") -> DataFrame:
    """All-text CSV, its columns found by tolerant names and renamed; a column that isn't there is null."""
    df = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("mode", "DROPMALFORMED").option("multiLine", True).option("escape", '"').csv(path)
    found = {new: resolve_column(df.columns, *names) for new, names in columns.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(new) for new, c in found.items()])


def sniffed_csv(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """CSV whose separator is | if the header has more pipes than commas; column names trimmed, in small letters."""
    head = (spark.read.text(path).limit(1).collect() or [[""]])[0][0]
    sep = "|" if head.count("|") > head.count(",") else ","
    df = spark.read.option("header", True).option("sep", sep).option("mode", "DROPMALFORMED").csv(path)
    df = df.toDF(*[c.lower().strip() for c in df.columns])
    return df.where(where) if where is not None else df


def aligned_union(*sources: tuple[str, DataFrame | None, Mapping[str, str]]) -> DataFrame:
    """(source, columns...) of several tables after renames; a missing source is skipped, a missing column null."""
    out = None
    for name, df, renames in sources:
        if df is None:
            continue
        part = df.withColumnsRenamed(dict(renames)).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source is there")
    return out


def container_lines(spark: SparkSession, path: str, encoding: str = "latin-1") -> DataFrame:
    """(file, member, line_no, line) of zip files (any method Python reads); gzip and plain text are read by Spark itself.

    Archives on a file system that the executors share are opened in place, whatever their size: their directories are
    listed first, then every member is read by a task of its own. Archives elsewhere come as one cell (up to 2 GB).
    """
    files = spark.read.format("binaryFile").load(path)
    place = lambda name: name.removeprefix("file://").removeprefix("file:")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["path"]:
                with zipfile.ZipFile(place(name)) as z:
                    own = [m for m in z.namelist() if not m.endswith("/")]
                yield pd.DataFrame({"file": [name] * len(own), "member": own})

    def lines(z: zipfile.ZipFile, name: str, member: str) -> Iterator[pd.DataFrame]:
        with z.open(member) as f:
            block, no = [], 0
            for line in io.TextIOWrapper(f, encoding):
                block.append((name, member, no, line.rstrip("\r\n")))
                no += 1
                if len(block) == 20_000:
                    yield pd.DataFrame(block, columns=["file", "member", "line_no", "line"])
                    block = []
            if block:
                yield pd.DataFrame(block, columns=["file", "member", "line_no", "line"])

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, member in zip(b["file"], b["member"]):
                with zipfile.ZipFile(place(name)) as z:
                    yield from lines(z, name, member)

    def unzip_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        yield from lines(z, name, member)

    schema = "file string, member string, line_no int, line string"
    if "://" in path and not path.startswith("file:"):
        return files.select("path", "content").mapInPandas(unzip_cell, schema)
    listed = files.select("path").mapInPandas(members, "file string, member string")
    return listed.repartition("file", "member").mapInPandas(unzip, schema)


def workbook(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet of an XLSX workbook: its first row names the columns, all values are texts, empty cells null."""
    import xml.etree.ElementTree as tree

    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [s.get("name") for s in tree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")]
                    shared = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in tree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")] if "xl/sharedStrings.xml" in z.namelist() else []
                    block = []
                    with z.open(f"xl/worksheets/sheet{names.index(sheet) + 1}.xml") as f:
                        for _, row in tree.iterparse(f):
                            if row.tag != f"{main}row":
                                continue
                            values: dict[int, str | None] = {}
                            for k, c in enumerate(row.iter(f"{main}c")):
                                at = 0
                                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                                    at = at * 26 + ord(letter) - 64
                                v = "".join(t.text or "" for t in c.iter() if t.tag in (f"{main}v", f"{main}t"))
                                values[at - 1 if at else k] = (shared[int(v)] if c.get("t") == "s" else v) or None
                            block.append((int(row.get("r", len(block) + 1)), [values.get(k) for k in range(max(values, default=-1) + 1)]))
                            row.clear()
                            if len(block) == 5_000:
                                yield pd.DataFrame(block, columns=["row", "cells"])
                                block = []
                    yield pd.DataFrame(block, columns=["row", "cells"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "row int, cells array<string>")
    head = rows.orderBy("row").first()
    if head is None:
        return spark.createDataFrame([], "row int").drop("row")
    return rows.where(F.col("row") > head.row).select(*[F.try_element_at("cells", F.lit(k + 1)).alias(name or f"column_{k + 1}") for k, name in enumerate(head.cells)])


def lexicon_file(spark: SparkSession, path: str) -> list[str]:
    """One word a line, blank lines and # comments left out; a lexicon is small by nature and bounded here."""
    rows = spark.read.text(path).select(F.trim("value").alias("w")).where("w <> '' and w not like '#%'").distinct().orderBy("w").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too long for a lexicon")
    return [r[0] for r in rows]


def scaffold(folder: str, slug: str) -> dict:
    """The YAML description of an entity: the exact file, else the first (sorted) whose words of over two letters all occur in the slug."""
    import yaml

    exact = os.path.join(folder, f"{slug}.yaml")
    if not os.path.exists(exact):
        named = [p for p in sorted(globbing.glob(os.path.join(folder, "*.yaml"))) if all(w in slug for w in os.path.basename(p)[:-5].split("_") if len(w) > 2)]
        if not named:
            raise FileNotFoundError(slug)
        exact = named[0]
    with open(exact, encoding="utf-8") as f:
        return yaml.safe_load(f)


def scaffold_summary(spec: Mapping, most: int = 4_000) -> str:
    """A description as plain lines, `key: value` with nested keys joined by dots and lists by commas, for a prompt; at most so many letters, whole lines."""
    lines: list[str] = []

    def walk(value, name: str) -> None:
        if isinstance(value, Mapping):
            for k, v in value.items():
                walk(v, f"{name}.{k}" if name else str(k))
        elif isinstance(value, (list, tuple)) and any(isinstance(v, Mapping) for v in value):
            for k, v in enumerate(value, 1):
                walk(v, f"{name}.{k}")
        elif value not in (None, "", [], ()):
            lines.append(f"{name}: {', '.join(map(str, value)) if isinstance(value, (list, tuple)) else value}")

    walk(spec, "")
    kept, size = [], 0
    for line in lines:
        if size + len(line) + 1 > most:
            break
        kept.append(line)
        size += len(line) + 1
    return "\n".join(kept)


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A table, or an empty frame where it doesn't exist: a missing collection is no error."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def partitions_of(spark: SparkSession, path: str, column: str, values: Sequence[str]) -> DataFrame:
    """Some partitions of a partitioned store; those that don't exist are skipped by pruning."""
    return spark.read.parquet(path).where(F.col(column).isin(*values))


def with_file(df: DataFrame, into: str = "file") -> DataFrame:
    return df.withColumn(into, F.col("_metadata.file_name"))


def embedding_cache(df: DataFrame, cache: DataFrame, text: str, embed, hash_column: str = "text_hash") -> tuple[DataFrame, DataFrame]:
    """(rows with cached vectors, rows newly embedded): only texts whose digest is not cached are embedded, each once."""
    keyed = df.withColumn(hash_column, F.sha2(F.col(text), 256))
    missing = keyed.join(cache.select(hash_column), hash_column, "left_anti").dropDuplicates([hash_column])
    return keyed.join(cache, hash_column), embed(missing)


def subtitles(content: Column) -> Column:
    """array<struct<text, start, duration>> (seconds) of a json3 subtitle document; events without text left out."""
    doc = F.from_json(content, "events array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>")
    rows = F.transform(
        doc["events"],
        lambda e: F.struct(
            F.trim(F.regexp_replace(F.array_join(F.transform(F.coalesce(e["segs"], F.array().cast("array<struct<utf8:string>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), r"\s+", " ")).alias("text"),
            (e["tStartMs"] / 1000.0).alias("start"),
            (F.coalesce(e["dDurationMs"], F.lit(0)) / 1000.0).alias("duration"),
        ),
    )
    return F.filter(rows, lambda r: r["text"] != "")


# -- HTML pages: an Arrow-batched parser on the standard library


class _Blocks:
    """Text of the elements that a selector (tag, class) names; elements to drop are skipped with all they hold."""

    def __init__(self, selectors: Sequence[tuple[str, str]], drop: Sequence[str]):
        self.selectors, self.drop = selectors, set(drop) | {"script", "style"}

    def read(self, page: str) -> list[str]:
        from html.parser import HTMLParser

        for tag, cls in self.selectors:
            found: list[str] = []
            drop = self.drop

            class P(HTMLParser):
                depth = skip = 0
                parts: list[str] = []

                def handle_starttag(self, t, attrs):
                    if t in ("br", "img", "hr", "input", "meta", "link"):
                        return
                    if self.depth:
                        self.depth += t == tag
                        self.skip += t in drop
                    elif t == tag and (not cls or cls in (dict(attrs).get("class") or "").split()):
                        self.depth, self.parts = 1, []

                def handle_endtag(self, t):
                    if self.depth:
                        self.skip -= t in drop and self.skip > 0
                        if t == tag:
                            self.depth -= 1
                            if not self.depth:
                                found.append(" ".join("".join(self.parts).split()))

                def handle_data(self, data):
                    if self.depth and not self.skip:
                        self.parts.append(data + " ")

            parser = P()
            parser.feed(page)
            if any(found):
                return [x for x in found if x]
        return []


def page_blocks(pages: DataFrame, html: str, selectors: Sequence[tuple[str, str]], drop: Sequence[str] = ("blockquote",), least: int = 10, into: str = "posts") -> DataFrame:
    """pages with the texts of the first selector that finds any; quotations dropped, short ones and repeats (by their first 160 letters) left out."""
    blocks = _Blocks(selectors, drop)

    @F.pandas_udf("array<string>")
    def read(values: pd.Series) -> pd.Series:
        def one(page):
            seen: dict[str, str] = {}
            for t in blocks.read(page) if page else []:
                t = re.sub(r"(?is)\[quote[^\]]*\].*?\[/quote\]", " ", t).strip()
                if len(t) >= least:
                    seen.setdefault(t[:160].lower(), t)
            return list(seen.values())

        return values.map(one)

    return pages.withColumn(into, read(F.col(html)))


def page_fields(pages: DataFrame, html: str, into: str = "fields") -> DataFrame:
    """pages with the map of their <li><strong>key</strong><span>value</span> lists and two-cell table rows, and JSON-LD additionalProperty (page wins)."""
    from tessera.functions.nested import merge_first

    pair = r"(?is)<li[^>]*>\s*<strong[^>]*>([^<]*)</strong>\s*<span[^>]*>([^<]*)</span>|<tr[^>]*>\s*<t[hd][^>]*>([^<]*)</t[hd]>\s*<td[^>]*>([^<]*)</td>"
    cells = lambda i: F.regexp_extract_all(F.col(html), F.lit(pair), F.lit(i))
    keys, values = F.transform(F.arrays_zip(cells(1), cells(3)), lambda z: F.trim(F.concat(z["0"], z["1"]))), F.transform(F.arrays_zip(cells(2), cells(4)), lambda z: F.trim(F.concat(z["0"], z["1"])))
    entries = F.filter(F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda z: F.struct(z["k"].alias("key"), z["v"].alias("value"))), lambda e: e["key"] != "")
    page = F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), 1)["value"].alias("value"))))
    ld = F.from_json(F.regexp_extract(F.col(html), r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1), "additionalProperty array<struct<name:string,value:string>>")["additionalProperty"]
    named = F.filter(F.coalesce(ld, F.array().cast("array<struct<name:string,value:string>>")), lambda p: p["name"].isNotNull())
    return pages.withColumn(into, merge_first(page, F.map_from_entries(F.transform(named, lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value"))))))


def blocked_page(title: Column, html: Column, url: Column, markers: Sequence[str], login: str = "/login") -> Column:
    from tessera.functions.text import contains_any

    return contains_any(F.lower(F.concat_ws(" ", title, html, url)), markers) | F.contains(F.lower(url), F.lit(login))


def slug_fields(url: Column) -> Column:
    """struct(year, km, tokens) read from the words of a listing URL when the page itself can't be had."""
    words = F.split(F.regexp_replace(F.lower(F.parse_url(url, F.lit("PATH"))), r"[^a-z0-9]+", " "), " ")
    text = F.array_join(words, " ")
    year = F.nullif(F.regexp_extract(text, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")
    km = F.nullif(F.regexp_extract(text, r"\b([0-9]{2,6}) ?km\b", 1), F.lit("")).cast("bigint")
    return F.struct(year.alias("year"), km.alias("km"), F.filter(words, lambda w: w != "").alias("tokens"))
