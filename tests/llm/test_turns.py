import pytest

from tessera.llm.turns import Roster, one_slip, turns

NAMES = [(1, "Brenna Abernoll"), (2, "Caspor Bickvar"), (3, "Dovrel Corrimund")]


@pytest.mark.parametrize("label, who", [("Brenna", 1), ("ABERNOLL", 1), ("Brenna Abernoll", 1), ("B. Abernoll", 1), ("Brenna A.", 1), ("Brena", 1), ("Brenan", 1), ("Caspor Bickvaar", 2), ("C. B.", 2), ("DC", 3), ("head", None), ("", None), ("Brenna Bickvar", None), ("B.", None)])
def test_roster(label, who):
    assert Roster(NAMES).resolve(label) == who


def test_one_slip():
    assert one_slip("abc", "abc") and one_slip("ac", "abc") and one_slip("abbc", "abc") and one_slip("axc", "abc") and one_slip("bac", "abc")
    assert not one_slip("abxc", "abc") and not one_slip("cba", "abc") and not one_slip("a", "abc")


def test_turns(spark):
    segments = [
        ("[00:01] Brenna: Hello uh there", 1.0), ("more words as Caspor said", 2.5), ("Caspor - [music]", 4.0), ("um, erm", 5.0), (">> CASPOR B.: Fine. [Dovrel] Yes", 6.0),
        ("more words as Caspor said", 2.5), ("<Brenna> (laughs)", 8.0), ("Dovrel : 0:09 right, “Caspor, no”", 9.0), (None, 9.5), ("", 9.6), ("D. Corrimund: he shook his head: gone", 10.25),
    ]
    rows = [("v1", [(t, s, 1.0) for t, s in reversed(segments)], 7), ("v2", None, 7), ("v3", [], 7), ("v4", [("uh (laughs)", 0.0, 1.0)], 7), ("v5", [("no label here", 0.5, 1.0)], 7)]
    videos = spark.createDataFrame(rows, "video_id string, transcript_segments array<struct<text string, start double, duration double>>, turn_no int")
    speakers = spark.createDataFrame([*NAMES, *NAMES, (None, "x"), (9, None)], "speaker_id int, full_name string")
    got = {}
    for r in turns(videos, speakers).orderBy("video_id", "turn_no").collect():
        got.setdefault(r.video_id, []).append((r.turn_no, r.speaker_id, r.start_ms, r.words))
    assert got == {
        "v1": [(1, 1, 1000, "Hello there more words as Caspor said"), (2, 2, 6000, "Fine."), (3, 3, 6000, "Yes right, “Caspor, no” he shook his head: gone")],
        "v5": [(1, None, 500, "no label here")],
    }
    assert turns(videos.where("false"), speakers).count() == 0 and turns(videos, speakers.where("false")).count() == 2


def run(spark, rows):
    videos = spark.createDataFrame(rows, "video_id string, transcript_segments array<struct<text string, start double, duration double>>")
    got = {}
    for r in turns(videos, spark.createDataFrame(NAMES, "speaker_id int, full_name string")).orderBy("video_id", "turn_no").collect():
        got.setdefault(r.video_id, []).append((r.speaker_id, r.start_ms, r.words))
    return got


@pytest.mark.parametrize("form", ["{{{0}}} {1}", "{0} » {1}", "={0}= {1}", "{0}| {1}", "⟦{0}⟧ {1}", "~{0}~ {1}", "{0} → {1}"])
def test_a_layout_that_nobody_listed_is_mined(spark, form):
    lines = [("Brenna", "the pump, Caspor said, is dry"), ("C. Bickvar", "so replace it"), ("DOVREL", "not Brenna again"), ("Brenan", "why not")]
    rows = [(f"v{k}", [(form.format(*line), float(i), 1.0) for i, line in enumerate(lines)]) for k in range(3)]
    assert run(spark, rows)["v0"] == [(1, 0, lines[0][1]), (2, 1000, lines[1][1]), (3, 2000, lines[2][1]), (1, 3000, lines[3][1])]


def test_a_clock_that_nobody_listed_is_mined_and_other_figures_stay(spark):
    rows = [("v1", [(f"{{{m}.{s:02}}} Brenna: the part costs {m + 3}.{s:02} or {s}:1 today", m * 60.0 + s, 1.0) for m in (1, 2) for s in (5, 30, 59)])]
    assert run(spark, rows)["v1"][0][2].startswith("the part costs 4.05 or 5:1 today the part costs 4.30")


def test_a_long_note_is_no_speech_and_a_spoken_name_no_label(spark):
    note = "[" + "a long description of what is to be heard " * 6 + "]"
    rows = [("v1", [(f"Brenna: so {note} it goes, Caspor, and on", 1.0, 1.0), (note, 3.0, 1.0), ("Dovrel, listen", 4.0, 1.0)])]
    assert run(spark, rows) == {"v1": [(1, 1000, "so it goes, Caspor, and on Dovrel, listen")]}
