import random

from tessera.llm import leakage as L


def data(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(900 + i, " ".join(word() for _ in range(rng.randrange(5, 60)))) for i in range(12)]
    docs = []
    for i in range(60):
        ws = [word() for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.6:
            src = rng.choice(items)[1].split()
            a = rng.randrange(max(1, len(src) - 12))
            ws[len(ws) // 2 : len(ws) // 2] = src[a : a + rng.choice([8, 11, 12, 13, 40])]
        docs.append((i, ", ".join(ws)))
    return items, docs


def brute(items, docs, n=12):
    grams = {}
    for i, t in items:
        ws = L.words(t)
        for k in range(len(ws) - n + 1):
            grams.setdefault(tuple(ws[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for ws in [L.words(t)] for k in range(len(ws) - n + 1) for i in grams.get(tuple(ws[k : k + n]), ())}


def test_against_brute_force(spark, monkeypatch):
    items, docs = data()
    odd = [(100, None), (101, ""), (None, items[0][1]), (102, "Ｗｏｒｄ " + items[-1][1].upper()), (103, "w " * 50_000 + items[-1][1])]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs + odd + docs[:3]], "doc_id int, text string, item_id string")
    e = spark.createDataFrame([*items, *items[:2], (None, "x"), (5, None)], "item_id int, text string")
    want = brute(items, [x for x in docs + odd if x[0] is not None and x[1]])
    assert want and {(r.doc_id, r.item_id) for r in L.leaks(d, e).collect()} == want
    monkeypatch.setattr(L, "PART", 40)  # items in several parts
    assert {(r.doc_id, r.item_id) for r in L.leaks(d, e).collect()} == want
    assert L.leaks(d.where("false"), e).count() == 0 and L.leaks(d, e.where("false")).count() == 0


def test_edited_passages(spark):
    items, _ = data(4)
    long = max(items, key=lambda x: len(x[1]))
    ws = long[1].split()
    ws[5] = "changed"
    d = spark.createDataFrame([(1, "intro words " + " ".join(ws[:30])), (2, "nothing of the kind " * 20)], "doc_id int, text string")
    e = spark.createDataFrame([long], "item_id int, text string")
    got = L.leaks(d, e, size=30, radius=12, similarity=0.5).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, long[0])] and 0.5 <= got[0].similarity < 1


def test_every_fingerprint_within_the_radius_is_found():
    import numpy as np

    rng = np.random.default_rng(3)
    items = [(i, [f"w{rng.integers(30)}" for _ in range(40)]) for i in range(8)]
    index = L.Index(items, 12, 5)
    probes = index.prints.copy()
    for k in range(len(probes)):
        for bit in rng.choice(64, int(rng.integers(0, 9)), replace=False):
            probes[k] ^= np.uint64(1 << int(bit))
    want = {(p, w) for p in range(len(probes)) for w in range(len(index.prints)) if int(probes[p] ^ index.prints[w]).bit_count() <= 5}
    assert set(zip(*map(lambda x: x.tolist(), index.candidates(probes)))) == want


def test_edited_passages_at_the_parameters_of_p9_near(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 11))) for _ in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randrange(20, 60))) for i in range(12)]
    items[3][1][:] = (items[3][1][:6] * 9)[:50]  # shingles that repeat
    docs = []
    for i in range(60):
        src = rng.choice(items)[1]
        n = min(len(src), rng.choice([20, 21, 22, 22, 22, 23, 24, 40]))
        a = rng.randrange(len(src) - n + 1)
        copied = src[a : a + n]
        if rng.random() < 0.3:
            copied[rng.randrange(n)] = "changed"
        docs.append((i, text(rng.randrange(30)) + copied + text(rng.randrange(30))))
    want, far = {}, set()
    for d, x in docs:
        for e, y in items:
            near = [(p, w, L.shingle_similarity(x[p : p + 24], y[w : w + 24])) for p in range(len(x) - 23) for w in range(len(y) - 23)]
            near = [z for z in near if z[2] >= 0.8]
            if near:
                want[d, e] = (len({p for p, _, _ in near}), round(max(s for _, _, s in near), 9))
                f, g = L.simhashes(L.word_hashes(x, {}), 24), L.simhashes(L.word_hashes(y, {}), 24)
                if all(int(f[p] ^ g[w]).bit_count() > 7 for p, w, _ in near):
                    far.add((d, e))
    assert len(want) > 20 and far  # cases that no fingerprint within 7 bits shows
    frame = lambda rows, id: spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows], f"{id} int, text string")
    got = L.leaks(frame(docs, "doc_id"), frame(items, "item_id"), size=24, radius=7, similarity=0.8).collect()
    assert {(r.doc_id, r.item_id): (r.words, round(r.similarity, 9)) for r in got} == want and len(got) == len(want)
