import random
import re

import pytest

from tessera.llm.chunking import ENDS, cuts, split_oversized


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 12)))
    for n in (0, 1, 30, 150, 400, 2500):
        yield " ".join(word() + rng.choice(["", "", ".", "!", "\n\n"]) for _ in range(n))
    yield "x" * 5000
    yield "a b. " * 20 + "x" * 1201 + " end"
    yield "a b. " * 20 + "x" * 1200 + ". " + "y" * 1200
    yield "。" * 3000 + " " * 2000 + "z"
    yield "日本語の文です。" * 400


def test_pieces_hold_the_contract():
    for t in texts():
        t = t.strip(ENDS)
        got = cuts(t, 1200, 120)
        assert got[0][0] == 0 and got[-1][2] == len(t)
        for (a, b, z, _), following in zip(got, [*got[1:], None]):
            assert z - a <= 1200 and 0 <= b - a <= 120 and (not t or z > b)
            assert following is None or following[1] == z
        forced = any(p == 50.0 for *_, p in got)
        assert forced == bool(re.search(r"[^\s.!?。！？।…]{1201}", t)) and (len(got) == 1) == (len(t) <= 1200)


def test_a_cut_falls_on_a_paragraph_and_repeats_whole_words():
    t = ("word " * 150).strip() + "\n\n" + ("term " * 150).strip()
    (a0, b0, z0, _), (a1, b1, z1, p) = cuts(t, 1200, 120)
    assert t[b1:].startswith("term") and p == 0.0 and t[a1 - 1].isspace() and b1 - a1 > 100


def test_operator(spark):
    rows = [(1, "short", "a"), (2, None, "b"), (3, "", "c"), (4, "   \n", "d"), (5, "  " + "w. " * 2000, "e"), (5, "  " + "w. " * 2000, "e")]
    df = spark.createDataFrame(rows, "id int, t string, piece string")
    got = split_oversized(df, "t").collect()
    assert {r.id for r in got} == {1, 5} and [r for r in got if r.id == 1][0].piece == "short"
    five = [r for r in got if r.id == 5]
    assert len(five) % 2 == 0 and all(rows[4][1][r.start_char : r.end_char] == r.piece for r in five)
    assert {r.id for r in split_oversized(df, "t", only_oversized=True).collect()} == {5}
    assert split_oversized(df.where("false"), "t").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "t", 100, 100)


def test_no_way_to_cut_costs_less():
    """Against a plain recursion over all boundaries, words too."""
    import functools

    from tessera.llm import chunking as C

    rng = random.Random(9)
    for _ in range(150):
        word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9)))
        t = "".join(word() + rng.choice([" ", " ", " ", ". ", "\n", "\n\n", "! "]) for _ in range(rng.randrange(2, 40))).strip()
        limit, overlap = rng.choice([20, 30, 45]), rng.choice([0, 5])
        if len(t) <= limit:
            continue
        at, pen = (x.tolist() for x in C.boundaries(t, limit))
        share = len(t) / -(-len(t) // (limit - overlap))

        @functools.cache
        def least(j):
            return 0.0 if not j else min((least(i) + C.EVENNESS * ((at[j] - at[i] - share) / limit) ** 2 + pen[j] for i in range(j) if at[j] - at[i] <= limit), default=float("inf"))

        got = cuts(t, limit, overlap)
        cost = sum(C.EVENNESS * ((z - b - share) / limit) ** 2 for _, b, z, _ in got) + sum(p for *_, p in got[1:])
        assert abs(cost - least(len(at) - 1)) < 1e-9
