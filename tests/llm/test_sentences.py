import random

from pyspark.sql import functions as F

from tessera.llm.sentences import sentence_spans, sentences

CASES = {
    "Dr. Keltsom came at 7.30 a.m. and left. He paid 9.5 euros, etc. Then he slept.": ["Dr. Keltsom came at 7.30 a.m. and left.", "He paid 9.5 euros, etc.", "Then he slept."],
    'He said: "It is done." Then "why?" she asked. „Das wird teuer.“ Ja.': ['He said: "It is done."', 'Then "why?" she asked.', "„Das wird teuer.“", "Ja."],
    "One.Two\n\nno stop\n\nThree": ["One.", "Two", "no stop", "Three"],
    "师傅说：“换掉。不能再拖了。”然后走了。好！「もう限界です！」と言った。": ["师傅说：“换掉。不能再拖了。”然后走了。", "好！", "「もう限界です！」と言った。"],
    "อู่คิด 730 กม. ผมพบ ดี": ["อู่คิด 730 กม. ผมพบ", "ดี"],
    "डॉ. Okonvar ने कहा। क्या यह है? हाँ।": ["डॉ. Okonvar ने कहा।", "क्या यह है?", "हाँ।"],
    "Am 3. Mai um 17.45 Uhr, d.h. spät... aber gut. Ende...": ["Am 3. Mai um 17.45 Uhr, d.h. spät... aber gut.", "Ende..."],
    "See https://a.b.org/x.html for more. Good": ["See https://a.b.org/x.html for more.", "Good"],
    "Text here.\n#AB12CD": ["Text here.", "#AB12CD"],
    "app​rox. 5 km. Ok": ["app​rox. 5 km.", "Ok"],
    "Er sagte leise „Das\nwird teuer.“ Nach 3 Tagen Schluss.": ["Er sagte leise „Das\nwird teuer.“", "Nach 3 Tagen Schluss."],
    "Av. Ellquist ve Muh. Toskil; dr. Who": ["Av. Ellquist ve Muh. Toskil; dr. Who"],
    "هل هذا صحيح؟ نعم. حسنا": ["هل هذا صحيح؟", "نعم.", "حسنا"],
    "یہ ٹھیک ہے۔ اور یہ؟ جی۔": ["یہ ٹھیک ہے۔", "اور یہ؟", "جی۔"],
    "Բարև։ Ինչպես ես։": ["Բարև։", "Ինչպես ես։"],
    "ሰላም። እንዴት ነህ፧ ደህና።": ["ሰላም።", "እንዴት ነህ፧", "ደህና።"],
    "မင်္ဂလာပါ။ ကောင်းပါတယ်။": ["မင်္ဂလာပါ။", "ကောင်းပါတယ်။"],
    "សួស្តី។ អរគុណ។": ["សួស្តី។", "អរគុណ។"],
    "He said “" + "So it is. " * 60 + "Done” and left. Then (" + "no. " * 200 + ") he slept. Ok": ["He said “" + "So it is. " * 60 + "Done” and left.", "Then (" + "no. " * 200 + ") he slept.", "Ok"],
    'He said "' + "So it is. " * 60 + 'Done" and left. Then': ['He said "' + "So it is. " * 60 + 'Done" and left.', "Then"],
    "An open ( mark. Next one.\n\nLast) here. End": ["An open ( mark.", "Next one.", "Last) here.", "End"],
    "   \n ": [], "": [], "...": ["..."],
}


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(CASES)] + [(99, None, "z")], "id int, t string, sentence string")
    got = {}
    for r in sentences(df, "t").orderBy("id", "sent_no").collect():
        got.setdefault(r.id, []).append(r.sentence)
    for i, (t, want) in enumerate(CASES.items()):
        assert got.get(i, []) == want, t
    assert 99 not in got


def test_labelled_sentences_stay_whole_and_joined_ones_come_apart(spark, small):
    samples = [(r.lang, r.text) for r in spark.read.parquet(f"{small}/lang_samples.parquet").collect()]
    rng, rows = random.Random(5), []
    for i in range(300):
        lang = rng.choice(sorted({x for x, _ in samples}))
        own, text, ends = [t for x, t in samples if x == lang], "", []
        for k in range(4):
            text += rng.choice(["", "", "\n\n"] if lang in ("ja", "zh") else [" ", "\n", "  ", "\n\n"]) * bool(k) + rng.choice(own)
            ends.append(len(text))
        rows.append((i, text, ends))
    df = spark.createDataFrame(rows, "id int, t string, ends array<int>")
    got = df.select("ends", F.transform(sentence_spans(F.col("t")), lambda s: s["end_char"]).alias("got")).collect()
    assert sum(r.ends == r.got for r in got) / len(got) > 0.99


def test_very_long_repeated_and_empty(spark):
    long = "Short one here. " * 3000
    odd = [("(" * 30_000 + " a. B",), ("„" * 30_000 + " a. B",), ('" x. Y ' * 20_000,), ("“" + "A b. " * 60_000 + "”",), ("x\n" * 50_000,)]
    assert spark.createDataFrame(odd, "t string").select(F.min(F.size(sentence_spans(F.col("t"))))).first()[0] >= 1
    df = spark.createDataFrame([(1, long), (1, long)], "id int, t string")
    r = sentences(df, "t").agg(F.count("*"), F.max("end_char"), F.max("sent_no")).first()
    assert tuple(r) == (6000, len(long) - 1, 3000)
    assert sentences(df.where("false"), "t").count() == 0
