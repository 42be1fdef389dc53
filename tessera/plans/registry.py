"""Registration of queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function name; sql is its DuckDB equivalent, None where SQL can't express it."""

        def add(f: Query) -> Query:
            if f.__name__ in self.queries:
                raise ValueError(f"two queries named {f.__name__}")
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return add


def spans_sql(raw: str) -> str:
    """CTEs part, num and span(k, lo, hi): the year spans of raw(k, t), read on another road than year_spans: parts between
    separators, their numbers, then the words around a lone number."""
    return rf"""raw AS ({raw}),
part AS (SELECT k, trim(unnest(regexp_split_to_array(lower(t), '[;,&]'))) AS p FROM raw WHERE t IS NOT NULL),
num AS (SELECT k, p, [CASE WHEN length(x) = 2 THEN 2000 + x::INT ELSE x::INT END FOR x IN regexp_extract_all(p, '[0-9]{{4}}|[0-9]{{2}}')] AS ys FROM part),
span AS (SELECT * FROM (
  SELECT k,
    CASE WHEN len(ys) > 1 THEN list_min(ys) WHEN regexp_matches(p, '^(before|pre|up to|until|-)') THEN 2000 WHEN regexp_matches(p, '^post') THEN ys[1] + 1 ELSE ys[1] END AS lo,
    CASE WHEN len(ys) > 1 THEN list_max(ys) WHEN regexp_matches(p, '^(before|pre)') THEN ys[1] - 1
      WHEN regexp_matches(p, '^(post|since|from)|[0-9](-|\+| ?-? ?present| onwards)$') THEN 2024 ELSE ys[1] END AS hi
  FROM num WHERE len(ys) > 0) WHERE lo <= hi)"""


def islands_sql(source: str, name: str = "isl") -> str:
    """CTEs <name>y and <name>(k, lo, hi): the spans of source(k, lo, hi) as merged periods."""
    return f"{name}y AS (SELECT DISTINCT k, unnest(range(lo, hi + 1)) AS y FROM {source}), {name} AS (SELECT k, min(y)::INT AS lo, max(y)::INT AS hi FROM (SELECT *, y - row_number() OVER (PARTITION BY k ORDER BY y) AS g FROM {name}y) GROUP BY k, g)"
