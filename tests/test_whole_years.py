import random

from tessera.plans import table_queries as T

#: Notations and the years they mean.
SPANS = {
    "2017-2019": [(2017, 2019)], "2010—2012": [(2010, 2012)], "2012 to 2015": [(2012, 2015)], "2003/2005": [(2003, 2005)], "'19-'20": [(2019, 2020)],
    "up to 2009": [(2000, 2009)], "2017 only": [(2017, 2017)], "2012 & 2007-2008": [(2012, 2012), (2007, 2008)], "2007, 2012-2015": [(2007, 2007), (2012, 2015)],
    "post-2009": [(2010, 2024)], "1985": [(1985, 1985)], "all years": [], "": [], None: [],
}
ENGINES = {"E1": (2000, 2006), "E2": (2007, 2011), "E3": (2012, 2020), "E4": (None, None)}


def tables(spark, folder):
    rng = random.Random(5)
    forms = list(SPANS)
    contexts = [(f"c{i}", rng.choice(["i1", "i2", "i3", "i4", None]), rng.choice(["E1", " E2 ", "E3", " ", None]), forms[i % len(forms)], rng.randrange(1, 9)) for i in range(60)]
    contexts += [("x1", "only", "E1", "1985", 3), ("x2", "only", "E2", "n/a", 4)]
    issues = [(f"i{i}", forms[i % len(forms)], rng.choice([["E1", "E2", "E3"], ["E2"], ["E3", "E4", "E9"], [], None, ["E1", "E3"]])) for i in range(80)]
    put = lambda rows, schema, name: spark.createDataFrame(rows + rows[:3], schema).write.parquet(f"{folder}/{name}.parquet")
    put(contexts, "ctx_id string, issue_id string, engine string, years string, evidence_hits int", "engine_year_context")
    put(issues, "issue_id string, affected_years string, affected_engines array<string>", "issues")
    spark.createDataFrame([(k, *v) for k, v in ENGINES.items()], "engine_code string, year_lo int, year_hi int").write.parquet(f"{folder}/engines.parquet")
    return contexts, issues


def test_every_notation_against_brute_force(spark, tmp_path):
    contexts, issues = tables(spark, tmp_path)
    want = {}
    for _, issue, engine, text, hits in contexts:
        if issue and engine and engine.strip():
            e = want.setdefault((issue, engine.strip()), [set(), 0])
            e[0] |= {y for lo, hi in SPANS.get(text, []) for y in range(lo, hi + 1) if 1990 <= y <= 2030}
            e[1] += hits
    got = {(r.issue_id, r.engine): (r.year_lo, r.year_hi, r.years, r.hits) for r in T.year_context_merge(spark, str(tmp_path)).collect()}
    assert got == {k: (min(y, default=None), max(y, default=None), len(y), h) for k, (y, h) in want.items()}

    want = {}
    for issue, text, codes in issues:
        fits = [c for c in codes or [] if ENGINES.get(c, (None,))[0] is None or not SPANS[text] or any(ENGINES[c][0] <= hi and lo <= ENGINES[c][1] for lo, hi in SPANS[text])]
        if codes:
            want[issue] = (sorted(fits or codes), len(codes) - len(fits) if fits else 0)
    assert {r.issue_id: (r.engines, r.dropped) for r in T.engine_year_validation(spark, str(tmp_path)).collect()} == want


def test_whole_vectors(spark, small):
    assert {len(r.text.split(",")) for r in T.vector_text(spark, small).collect()} == {64}
