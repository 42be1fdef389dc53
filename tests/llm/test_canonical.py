import random

from tessera.llm import canonical as C

ENGINES = [("1.4_Vextor", 1391, ["1.4 Vextor", "Soukstind"]), ("2.0_Vextor", 1963, ["2.0 Vextor", "Serknax"]), ("2.0_Drallin", 1981, ["Rastdras"]), ("2.5_Drallin", 2496, None)]
CASES = {
    "1.4 Vextor": "1.4_Vextor", "1,4VEXTOR 107PS": "1.4_Vextor", "１.４ vxetor": "1.4_Vextor", "Vexxtor 2.0 S&S": "2.0_Vextor", "1391 cc Vextor": "1.4_Vextor",
    "one point four Vetor": "1.4_Vextor", "two litre Drallin": "2.0_Drallin", "two and a half litre drallin": "2.5_Drallin", "soukstind": "1.4_Vextor", " Souksttind ": "1.4_Vextor",
    "2.6 Vextor": "UNMATCHED", "Vextor": "UNMATCHED", "diesel": "UNMATCHED", "?": "UNMATCHED", "1.4 Drallin": "UNMATCHED", "1.4 Vxtr": "UNMATCHED", "2.0-Drallin": "2.0_Drallin",
}


def brute(word, name):
    """Whether name becomes word by at most one slip, by trying every slip."""
    made = {name} | {name[:i] + name[i + 1 :] for i in range(len(name))} | {name[:i] + name[i] + name[i:] for i in range(len(name))}
    made |= {name[:i] + name[i + 1] + name[i] + name[i + 2 :] for i in range(len(name) - 1)} | {name[:i] + c + name[i + 1 :] for i in range(len(name)) for c in "abcd"}
    return word in made


def test_slip_against_brute_force():
    rng = random.Random(1)
    for _ in range(20_000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(2))
        assert (C.distance(a, b) is not None) == brute(a, b), (a, b)
    assert C.distance("abdc", "abcd") == C.SWAPPED and C.distance("abccd", "abcd") == C.DOUBLED and C.distance("abd", "abcd") == C.LOST and C.distance("abxd", "abcd") == C.CHANGED
    assert C.distance("bacdd", "abcd") is None and C.distance("bacdd", "abcd", 2) == C.SWAPPED + C.DOUBLED


def test_values_and_mentions(spark):
    names = C.Names([(c, n, a or []) for c, n, a in ENGINES])
    assert {v: names.value(v) for v in CASES} == CASES
    assert names.mention("The car has the 2,0 TURBO DRALLIN under the bonnet.") == "2.0_Drallin"
    assert names.mention("My Vextor 1.4 ran 2.5 litres short.") == "1.4_Vextor" and names.mention("Fitted with a Serknax.") == "2.0_Vextor"
    assert names.mention("A Vextor with 2.5 litres of oil") is None and names.mention("") is None
    table = spark.createDataFrame([*ENGINES, *ENGINES, (None, 1, None)], "engine_code string, displacement_cc int, search_alias array<string>")
    reference = C.names(table)
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate([*CASES, None, "", " \t "])], "id int, v string, engine_code string")
    assert {r.v: r.engine_code for r in C.resolve_values(df, "v", reference).collect()} == CASES
    missed = C.unmatched(C.resolve_values(df.unionAll(df), "v", reference), "v").collect()
    assert {r.n for r in missed} == {2} and len(missed) == sum(x == "UNMATCHED" for x in CASES.values())
    assert C.resolve_values(df.where("false"), "v", reference).count() == 0
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "every 1.4 Vextor does"), (4, "word " * 20_000 + "Rastdras")], "id int, t string")
    assert {(r.id, r.engine_code) for r in C.resolve_mentions(texts, "t", reference).collect()} == {(3, "1.4_Vextor"), (4, "2.0_Drallin")}


def test_empty_reference(spark):
    empty = C.names(spark.createDataFrame([], "engine_code string, displacement_cc int, search_alias array<string>"))
    assert empty.value("1.4 Vextor") == "UNMATCHED" and empty.mention("1.4 Vextor") is None


def test_names_with_figures_short_ones_and_those_of_several_words():
    names = C.Names([("N47", 1995, []), ("M57", 2993, []), ("EA888", 1984, ["EA 888 evo"]), ("EA211", 1395, []), ("R8_40", 3993, ["4.0 V8"]), ("R8_42", 4163, ["4.2 V8"]), ("B6", None, [])])
    for v, code in {
        "N47": "N47", "m57": "M57", "EA888": "EA888", "EA211": "EA211", "ea 888 EVO": "EA888", "4.0 V8": "R8_40", "V8 4,2 480PS": "R8_42", "4.4 V8": "UNMATCHED", "V8": "UNMATCHED", "B6": "B6",
        "2.0 N47 engine": "UNMATCHED", "N47 177PS": "N47", "1995 cc n47": "N47", "EA88": "EA888", "AE888": "EA888", "N4": "UNMATCHED", "EA888 evo": "EA888",
    }.items():
        assert names.value(v) == code, v
    assert names.mention("it has the N47, with 12.5 litres of oil") == "N47" and names.mention("a 4.0   -   V8 sits there") == "R8_40" and names.mention("a V8") is None
    assert names.mention("the 4.2 " + "turbo " * 40 + "V8 is loud") == "R8_42" and names.mention("an EA-888 evo here") == "EA888"
