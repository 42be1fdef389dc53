import random

from pyspark.sql import functions as F

from tessera.llm import language as L


def samples(spark, small):
    return [(r.lang, r.text) for r in spark.read.parquet(f"{small}/lang_samples.parquet").orderBy("sample_id").collect()]


def test_held_out_accuracy(spark, small):
    rows = samples(spark, small)
    order = list(range(len(rows)))
    random.Random(1).shuffle(order)
    model = L.Classifier([rows[i] for i in order[110:]])
    guessed = model.predict([rows[i][1] for i in order[:110]])
    assert sum(g == rows[i][0] for (g, _), i in zip(guessed, order)) >= 0.96 * 110
    assert model.predict(["JPDHLR"])[0][0] not in ("zh", "ja", "th", "hi", "ru") and model.predict(["真是太让人失望了！"])[0][0] == "zh"
    assert all(0 <= c <= 1 for _, c in guessed) and model.predict([]) == [] and model.predict(["123 #", ""]) == [("", 0.0)] * 2


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "en_GB": "en", "pt-BR": "pt", "deu": "de", "German": "de", "und": None, "": None, None: None, "unknown": None, "xx": None, " fr ": "fr"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r.l: r.n for r in df.select("l", L.named_language(F.col("l")).alias("n")).collect()} == cases


def test_mixed_missing_wrong(spark, small):
    model = L.train(spark.read.parquet(f"{small}/lang_samples.parquet"))
    en, de, zh = "The tow truck came at 7.30 a.m. and took the Ilmo.", "Die Werkstatt wollte 1961 Euro haben.", "大约需要2.3升机油。"
    rows = [
        (1, en, "en"), (2, en, "de"), (3, en, None), (4, f"{en} {de} {en}", "en"), (5, f"{en}\n\n{zh}", "zho"), (6, None, "en"), (7, "", None), (8, "#AB12CD!", None),
        (9, f"{de}\n\n#AB12CD", "German"), (10, en + " Ok.", "en-GB"), (11, "12 34", "fr"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, t string, l string, lang string").drop("lang")
    got = sorted((r.id, r.lang) for r in L.wrongly_labelled(df, "id", "t", "l", model).collect())
    assert got == [(2, "en"), (3, "en"), (4, "de"), (4, "en"), (5, "en"), (5, "zh")]
    one = sorted((r.id, r.lang) for r in L.wrongly_labelled(df, "id", "t", "l", model, one=True).collect())
    assert (4, "en") not in one and (2, "en") in one
    stretches = L.segments(df.where("id = 4"), "t", model).orderBy("seg_no").collect()
    assert [r.lang for r in stretches] == ["en", "de", "en"] and rows[3][1][stretches[1].start_char : stretches[1].end_char] == de
    assert L.segments(df.where("false"), "t", model).count() == 0
    long = spark.createDataFrame([(1, (en + " ") * 3000)], "id int, t string")
    assert [(r.lang, r.seg_no) for r in L.segments(long, "t", model).collect()] == [("en", 1)]


def test_decide():
    assert L.decide([("en", 0.95, 40), ("fr", 0.4, 10), ("", 0.0, 0)])[1][0] == "en"
    assert L.decide([("es", 0.95, 40), ("pt", 0.55, 40)])[1][0] == "es"
    assert L.decide([("en", 0.95, 40), ("pt", 0.75, 40)])[1][0] == "pt"
    assert L.decide([("de", 0.5, 5)]) == [("de", 0.5)] and L.decide([]) == []


def test_languages_without_samples_are_told_apart(spark, small):
    model = L.train(spark.read.parquet(f"{small}/lang_samples.parquet"))
    unknown = {
        "el": "Η αντλία νερού χάλασε μετά από χίλια χιλιόμετρα και έπρεπε να αλλαχθεί.", "ar": "المضخة تعطلت بعد ألف كيلومتر", "ko": "워터 펌프가 천 킬로미터 후에 고장났습니다",
        "uk": "Водяний насос зламався після тисячі кілометрів, і його довелося замінити.", "pl": "Pompa wodna zepsuła się po tysiącu kilometrów i trzeba było ją wymienić.", "he": "משאבת המים התקלקלה אחרי אלף קילומטר",
    }
    assert [lang for lang, _ in model.predict(list(unknown.values()))] == [L.OTHER] * len(unknown)
    wide = "Ａｆｔｅｒ that the ｏｉｌ cooler was fine for 302 days."
    assert model.predict([wide])[0][0] == "en"
    df = spark.createDataFrame([(1, f"{wide}\n\n{unknown['el']}", "en"), (2, unknown["ar"], None)], "id int, t string, l string")
    assert [(r.id, r.lang) for r in L.segments(df, "t", model).orderBy("id", "seg_no").collect()] == [(1, "en"), (1, L.OTHER), (2, L.OTHER)]
    assert L.wrongly_labelled(df, "id", "t", "l", model).count() == 0
    assert {(r.id, r.lang) for r in L.wrongly_labelled(df, "id", "t", "l", model, every=True).collect()} == {(1, "en"), (1, L.OTHER), (2, L.OTHER)}
