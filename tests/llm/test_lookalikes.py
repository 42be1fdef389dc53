import itertools

from pyspark.sql import functions as F

from tessera.llm.lookalikes import classes, consistent, look_alike_pairs, mapped, same_length

LIKE = ["Check fine", "Ｃｈｅｃｋ fine", "Сhесk fine", "Check ﬁne", "Che​ck fine", "Check fine", "Check　fi­ne"]
ACCENTS = ["Müh. ağır", "Müh. ağır"]
DIFFERENT = ["check fine", "Check  fine", "Check\nfine", "Check fıne", "Check fine.", "Check fine1", "Chéck fine", "Check–fine", "Check-fine", "", " "]


def test_consistent_form():
    assert len({consistent(t) for t in LIKE}) == 1 and len({consistent(t) for t in ACCENTS}) == 1
    assert consistent("a‑b") == "a-b" and consistent("ｶ") == "カ" and consistent("６.７") == "6.7"
    for odd, same in (("𝐁𝐨𝐥𝐝 𝟏𝟐", "Bold 12"), ("𝛂𝐛", "ab"), ("ⅣⅤ", "ⅣV"), ("ρυ", "pu"), ("κ", "к"), ("ᴄᴏ", "co"), ("ℝ𝕩", "Rx"), ("x\U000e0101y\U000e0041", "xy"), ("Ꭺո", "An")):
        assert consistent(odd) == same and consistent(same) == same
    assert consistent("ι") == "ı" != consistent("i") and consistent("Ⓐ") != "A"  # dotless; a circle is seen
    assert len({consistent(t) for t in [LIKE[0], ACCENTS[0], *DIFFERENT]}) == len(DIFFERENT) + 2


def test_pairs_against_brute_force(spark):
    texts = [*LIKE, *ACCENTS, *DIFFERENT, *LIKE[:3], None, None, "x" * 50_000, "x" * 49_999 + "х"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "Check fine", 2)], "k int, txt string, __class int")
    want = {(a, b) for (a, s), (b, t) in itertools.combinations(enumerate(texts), 2) if s is not None and t is not None and s != t and consistent(s) == consistent(t)}
    got = look_alike_pairs(df.drop("__class"), id="k", text="txt").collect()
    assert {(r.id_lo, r.id_hi) for r in got} == want and len(got) == len(want)


def test_scope_and_empty(spark):
    df = spark.createDataFrame([("a", 1, "Ab"), ("b", 2, "Аb"), ("a", 10, "Аb"), ("a", 9, "Ab")], "s string, k int, txt string")
    assert {(r.s, r.id_lo, r.id_hi) for r in look_alike_pairs(df, "s", id="k", text="txt").collect()} == {("a", 1, 10), ("a", 9, 10)}
    assert look_alike_pairs(df.where("false"), "s", id="k", text="txt").count() == 0


def test_classes_keep_rows_and_choose_the_most_frequent(spark):
    df = spark.createDataFrame([(1, "été", "x"), (2, "été", "y"), (3, "été", "y"), (4, None, "z"), (4, None, "z")], "k int, t string, text_class string")
    got = classes(df, "t").orderBy("k").collect()
    assert len(got) == 5 and len({bytes(r.text_class) for r in got[:3]}) == 1 and got[3].text_class is None
    assert {r.text_class_canonical for r in got[:3]} == {"été"}


def test_sql_and_python_agree(spark):
    texts = [*LIKE, *DIFFERENT, "𝐁𝐨𝐥𝐝 𝟏", "ⅴ ᴄ x\U000e0101 ﬁρ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mapped(F.col("t")).alias("m"), F.length(same_length(F.col("t"))).alias("n")).collect()
    assert all(consistent(r.m) == consistent(r.t) and (r.m == consistent(r.t) or r.t in ACCENTS) and r.n == len(r.t) for r in got)
