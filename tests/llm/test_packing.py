import os
import random

import pytest

from tessera.llm import packing as P


def test_shard():
    rng = random.Random(2)
    for sizes in ([], [5], [1024] * 3, [600] * 5, [rng.randrange(1, 1025) for _ in range(2000)], [max(1, int(rng.lognormvariate(5, 1)) % 1024) for _ in range(3000)]):
        place = P.pack_shard(sizes, 1024)
        total = {}
        for s, c in zip(sizes, place):
            total[c] = total.get(c, 0) + s
        assert all(t <= 1024 for t in total.values()) and sorted(total) == list(range(len(total)))
        if len(sizes) > 1000:
            assert sum(sizes) / 1024 / len(total) > 0.95


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1, 900), "x") for i in range(300)] + [(1000, 5000, "x"), (1001, 1024, "x"), (1002, 0, "x"), (1003, None, "x"), (None, 5, "x"), (0, 7, "x")]
    df = spark.createDataFrame(rows, "id int, tokens int, container string")
    for shard in (50, 10_000):
        got = P.pack(df, "id", capacity=1024, shard=shard).collect()
        fill = {}
        for r in got:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
        assert max(fill.values()) <= 1024 and sum(fill.values()) == sum(t for i, t, _ in rows if t and i is not None)
        assert sorted((r.piece_no, r.tokens) for r in got if r.id == 1000) == [(1, 1024), (2, 1024), (3, 1024), (4, 1024), (5, 904)]
        assert all(r.piece_no == 1 for r in got if r.id < 1000) and not {1002, 1003} & {r.id for r in got}
    assert P.pack(df.where("false"), "id").count() == 0


@pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no tokenizer files here")
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    df = spark.createDataFrame([(1, "Hello world <|endoftext|>"), (2, None), (3, "")], "id int, t string")
    got = {r.id: r.tokens for r in P.token_counts(df, "t", os.path.join(os.path.dirname(P.TOKENIZER), name)).collect()}
    assert got[1] > 3 and got[2] is None and got[3] == 0


def test_every_document_goes_to_the_least_cost_with_room():
    """Against a plain search over all open sequences, document by document."""
    rng = random.Random(5)
    for _ in range(20):
        sizes = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 60))]
        room, spent, want = [64] * -(-sum(sizes) // 64), [0.0] * -(-sum(sizes) // 64), [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            with_room = [c for c in range(len(room)) if room[c] >= sizes[i]]
            if not with_room:
                room.append(64)
                spent.append(0.0)
                with_room = [len(room) - 1]
            c = min(with_room, key=lambda c: (spent[c], room[c], c))
            room[c] -= sizes[i]
            spent[c] += P.cost(sizes[i], 64)
            want[i] = c
        number = {c: k for k, c in enumerate(sorted(set(want)))}
        assert P.pack_shard(sizes, 64) == [number[c] for c in want]


def best_fit(sizes, capacity):
    room, place = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        c = min((c for c in range(len(room)) if room[c] >= sizes[i]), key=lambda c: room[c], default=None)
        if c is None:
            c = len(room)
            room.append(capacity)
        room[c] -= sizes[i]
        place[i] = c
    return place


def test_costs_are_balanced_and_little_is_unused():
    rng = random.Random(6)
    sizes = [min(1024, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(3000)]

    def spread(place):
        cost, fill = {}, {}
        for s, c in zip(sizes, place):
            cost[c], fill[c] = cost.get(c, 0) + P.cost(s, 1024), fill.get(c, 0) + s
        mean = sum(cost.values()) / len(cost)
        return (sum((x - mean) ** 2 for x in cost.values()) / len(cost)) ** 0.5, sum(fill.values()) / 1024 / len(fill)

    (deviation, fill), (other, _) = spread(P.pack_shard(sizes, 1024)), spread(best_fit(sizes, 1024))
    assert fill >= 0.99 and deviation < 0.9 * other
