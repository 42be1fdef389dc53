"""Sinks: JSON and flattened CSV, keyed upsert into partitions, checkpoints of finished keys, histories, manifests, reports, sheets."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import zipfile
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.nested import flat_json
from tessera.session import exists


def json_and_csv(df: DataFrame, json_path: str, csv_path: str) -> None:
    """JSON lines as they are; CSV with nested columns as JSON text."""
    df.write.mode("overwrite").json(json_path)
    text_csv(flat_json(df), csv_path)


def text_csv(df: DataFrame, path: str, sep: str = ",", compression: str = "none") -> None:
    """CSV with a header; quotes doubled, blanks at the ends of values kept, empty texts told from nulls."""
    options = {"header": True, "sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "compression": compression}
    df.write.mode("overwrite").options(**options).csv(path)


def ordered_json(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in one deterministic order: files are ranges of it, rows inside them sorted."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def upsert(df: DataFrame, path: str, key: str, partition: str, rebuild: bool = False) -> None:
    """Rows replace those of equal key; only the partitions that df touches are rewritten. rebuild drops what was there."""
    spark = df.sparkSession
    there = exists(spark, path) and not rebuild
    if there:
        old = spark.read.parquet(path)
        touched = df.select(partition).distinct()
        df = old.join(touched, partition, "left_semi").join(df.select(key), key, "left_anti").unionByName(df)
        staged = f"{path}__staged"
        df.write.mode("overwrite").partitionBy(partition).parquet(staged)
        df = spark.read.parquet(staged)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if there else "static").partitionBy(partition).parquet(path)


def append_run(df: DataFrame, path: str, run: str) -> None:
    """A run's metrics appended to the history, one partition a run."""
    df.withColumn("run_ts", F.lit(run)).write.mode("append").partitionBy("run_ts").parquet(path)


def mark_done(df: DataFrame, path: str, key: str) -> None:
    df.select(key).distinct().write.mode("append").parquet(path)


def still_to_do(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key no earlier run marked as done."""
    return df.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti") if exists(df.sparkSession, path) else df


def sheets(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One Parquet table a sheet, control characters stripped from texts."""
    from tessera.functions.text import sanitise

    for name, df in tables.items():
        texts = {f.name: sanitise(F.col(f"`{f.name}`")) for f in df.schema.fields if f.dataType.simpleString() == "string"}
        df.withColumns(texts).write.mode("overwrite").parquet(os.path.join(folder, name))


#: Rows that a sheet of a workbook can hold.
SHEET_ROWS = 1_048_575


def put_text(spark, path: str, text: str) -> None:
    """One small file, by the file system that the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def workbook(spark, tables: Mapping[str, DataFrame], path: str) -> None:
    """An XLSX workbook with a sheet a table: header, then rows as text, control characters stripped.

    A sheet holds at most SHEET_ROWS rows by its format; a larger table is refused (write `sheets` instead). Rows come to
    the driver a partition at a time and are written as they come; a path on another file system is copied there.
    """
    from xml.sax.saxutils import escape

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    text = lambda v: escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))
    line = lambda r, cells: f'<row r="{r}">' + "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{text(v)}</t></is></c>' for v in cells) + "</row>"
    local = path.removeprefix("file://").removeprefix("file:")
    remote = "://" in local
    file = tempfile.NamedTemporaryFile(suffix=".xlsx", delete=False).name if remote else local
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(tables) + 1)
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        links = lambda xs: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{kind}/{t}" Target="{p}"/>' for i, t, p in xs) + "</Relationships>"
        z.writestr("_rels/.rels", links([(1, "officeDocument", "xl/workbook.xml")]))
        z.writestr("xl/_rels/workbook.xml.rels", links([(i, "worksheet", f"worksheets/sheet{i}.xml") for i in n]))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{kind}"><sheets>' + "".join(f'<sheet name="{text(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, tables)) + "</sheets></workbook>")
        for i, (name, df) in enumerate(tables.items(), 1):
            if df.limit(SHEET_ROWS + 1).count() > SHEET_ROWS:
                raise ValueError(f"{name}: more rows than a sheet holds")
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>{line(1, df.columns)}'.encode())
                for r, row in enumerate(flat_json(df).toLocalIterator(), 2):
                    f.write(line(r, row).encode())
                f.write(b"</sheetData></worksheet>")
    if remote:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(file), target)


def split_sink(gated: DataFrame, kept: str, rejected: str, columns: Sequence[str]) -> None:
    """Accepted rows, and the projection of the rejected ones with their reason; one table partitioned by the verdict is read twice."""
    gated.where("keep").drop("keep", "reason").write.mode("overwrite").parquet(kept)
    gated.where("not keep").select(*columns, "reason").write.mode("overwrite").parquet(rejected)


def manifest(path: str, stages: Sequence[Mapping[str, object]]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"stages": list(stages)}, f, indent=2, sort_keys=True)


#: Rows of one table that a page may hold.
PAGE_ROWS = 50_000


def explorer(spark, title: str, tables: Mapping[str, DataFrame], path: str) -> None:
    """One HTML page that holds tables as JSON, with a search box over each; a table of more than PAGE_ROWS rows is refused."""
    from html import escape

    from tessera.functions.text import script_safe_json

    data = []
    for name, df in tables.items():
        rows = df.select(script_safe_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("j")).limit(PAGE_ROWS + 1).collect()
        if len(rows) > PAGE_ROWS:
            raise ValueError(f"{name}: more rows than a page may hold")
        data.append(f'<h2>{escape(name)}</h2><input data-of="{escape(name, True)}"><table></table><script type="application/json" data-name="{escape(name, True)}">[{",".join(r[0] for r in rows)}]</script>')
    script = """for (const s of document.querySelectorAll('script[data-name]')) {
  const rows = JSON.parse(s.textContent), table = s.previousElementSibling, box = table.previousElementSibling;
  const show = () => { table.replaceChildren(); for (const r of rows.filter(r => JSON.stringify(r).toLowerCase().includes(box.value.toLowerCase()))) { const tr = table.insertRow(); for (const v of Object.values(r)) tr.insertCell().textContent = typeof v === 'object' ? JSON.stringify(v) : v; } };
  box.oninput = show; show();
}"""
    put_text(spark, path, f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{"".join(data)}<script>{script}</script></body></html>')


def evidence_name(slug: str, query: str) -> str:
    """A file name for a query's evidence: slug, 40 safe letters, 8 of the digest."""
    return f"{slug}__{re.sub(r'[^A-Za-z0-9]+', '_', query)[:40].strip('_')}__{hashlib.sha1(query.encode()).hexdigest()[:8]}__retrieval.json"


def report(title: str, facts: Mapping[str, object], tables: Mapping[str, DataFrame], rows: int = 50) -> str:
    """A Markdown audit: facts, and the first rows of (already aggregated) tables."""
    out = [f"# {title}", "", *[f"- {k}: {v}" for k, v in facts.items()]]
    for name, df in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v) for v in r) + " |" for r in df.limit(rows).collect()]
    return "\n".join(out) + "\n"
