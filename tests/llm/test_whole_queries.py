from tessera.llm import queries as Q


def test_every_text_and_title_has_a_form(spark, tmp_path):
    docs = [(6, 'he said “оil leak” and "Ｐump"', None), (1, "oil leak", "Pump"), (2, "oil\u00a0leak", "ｐｕｍｐ"), (3, "oil leak", "Ｐump"), (4, "Oil leak", None), (5, None, "oil leak")]
    videos = [("v1", "Pump"), ("v2", "pump"), ("v1", "Pump"), ("v3", None)]
    spark.createDataFrame(docs, "doc_id int, text string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(videos, "video_id string, title string").write.parquet(f"{tmp_path}/videos.parquet")
    rows = Q.p4_forms(spark, str(tmp_path)).collect()
    got = {(r.src, r.rec_id, r.field, r.pos): r.canonical for r in rows}
    want = {("documents", str(i), f, 0): v for i, text, title in docs for f, v in (("text", text), ("title", title))} | {("videos", i, "title", 0): t for i, t in videos}
    want |= {("documents", "2", "text", 0): "oil leak", ("documents", "2", "title", 0): "pump", ("documents", "3", "title", 0): "Pump"}
    want |= {("documents", "6", "text", 0): 'he said “oil leak” and "Pump"', ("documents", "6", "quote", 1): "oil leak", ("documents", "6", "quote", 2): "Pump"}
    assert got == want and len(rows) == len(want)
    classes = {(r.canonical, r.text_class) for r in rows}
    assert len(classes) == len({c for c, _ in classes}) == len({k for _, k in classes}) == 6  # five forms and none


def test_every_text_has_a_language(spark, small):
    rows = Q.p5_languages(spark, small).toPandas()
    key = lambda r: (r.src, r.rec_id, r.lang)
    got = {key(r) for r in rows.itertuples()}
    odd = {key(r) for r in Q.p5_found(spark, small).collect()}
    assert odd < got and len(got) == len(rows) and rows["confidence"].between(0, 1).all()
    videos = Q.p5_video_segments(spark, small).toPandas()
    assert set(videos["video_id"]) == set(rows[rows.src == "videos"].rec_id) and videos["confidence"].between(0, 1).all()
    assert (set(rows[rows.src == "videos"].rec_id) - {k for s, k, _ in odd if s == "videos"})  # rightly labelled ones too
