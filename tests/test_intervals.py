import random

from pyspark.sql import functions as F

from tessera.operators.intervals import sweep, year_spans


def brute(spans):
    years = sorted({y for lo, hi in spans for y in range(lo, hi + 1)})
    out, start = [], None
    for i, y in enumerate(years):
        start = y if start is None else start
        if i + 1 == len(years) or years[i + 1] != y + 1:
            out.append(("period", start, y))
            if i + 1 < len(years):
                out.append(("gap", y + 1, years[i + 1] - 1))
            start = None
    return out


def test_reading(spark):
    cases = {
        "2017-2019": [(2017, 2019)], "2019-2017": [(2017, 2019)], "MY13-MY16": [(2013, 2016)], "'21-'23": [(2021, 2023)],
        "2002-03": [(2002, 2003)], "mid-2018 to late 2019": [(2018, 2019)], "pre-2013": [(2000, 2012)], "before 2016": [(2000, 2015)],
        "up to 2012": [(2000, 2012)], "-2013": [(2000, 2013)], "2015-": [(2015, 2024)], "post-2009": [(2010, 2024)], "2020+": [(2020, 2024)],
        "2010-present": [(2010, 2024)], "2012 & 2007-2008": [(2012, 2012), (2007, 2008)], "2007, 2012-2015": [(2007, 2007), (2012, 2015)],
        "between 2011 and 2014": [(2011, 2014)], "all years": [], "n/a": [], "": [], None: [], "２０１２": [(2012, 2012)],
    }
    df = spark.createDataFrame([(k, i) for i, k in enumerate(cases)], "y string, i int")
    got = {r.y: [(s.lo, s.hi) for s in r.s] for r in df.select("y", year_spans(F.col("y")).alias("s")).collect()}
    assert got == cases


def test_sweep_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(12), a, a + rng.choice([0, 0, 1, 3, -1])) for a in (rng.randrange(2000, 2025) for _ in range(80))]
    rows += rows[:20] + [(3, None, 2001), (4, 2001, None), (None, 2005, 2006), (None, 2009, 2009)]
    # columns with the names used inside don't matter
    df = spark.createDataFrame([(e, a, b, 1, "x") for e, a, b in rows], "e int, lo int, hi int, d int, at string")
    got = {}
    for r in sweep(df, "e").collect():
        got.setdefault(r.e, []).append((r.kind, r.lo, r.hi))
    want = {}
    for e in {r[0] for r in rows}:
        if ok := [(a, b) for k, a, b in rows if k == e and a is not None and b is not None and a <= b]:
            want[e] = brute(ok)
    assert {k: sorted(v, key=lambda x: x[1]) for k, v in got.items()} == want


def test_empty(spark):
    assert sweep(spark.createDataFrame([], "e string, lo int, hi int"), "e").collect() == []
