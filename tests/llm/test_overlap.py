import random

from lexiframe.llm import overlap

SCHEMA = "sent_id bigint, words array<string>, section_id string, source string, word string"


def brute(sents, split, t=0.75):
    import re

    sets = {i: frozenset(w.lower().strip() for w in ws if w and re.search(r"\w", w)) for i, ws, _ in sents if ws}
    out = set()
    for i, _, a in sents:
        for j, _, b in sents:
            if i != j and split.get(a) == "train" and split.get(b) in ("dev", "test") and len(sets.get(i, ())) >= 10 and len(sets.get(j, ())) >= 10:
                x, y = sets[i], sets[j]
                if len(x & y) >= t * len(x | y):
                    out.add((min(i, j), max(i, j)))
    return out


def test_against_brute_force(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    sents = []
    for i in range(240):
        if i % 3 and sents:
            ws = list(r.choice(sents)[1])
            for _ in range(r.randint(0, 4)):
                ws[r.randrange(len(ws))] = r.choice(vocabulary)
        else:
            ws = [r.choice(vocabulary) for _ in range(r.choice([9, 14, 20, 60, 90]))]
        sents.append((i, ws, r.choice("abcde")))
    split = {"a": "train", "b": "train", "c": "dev", "d": "test"}
    df = spark.createDataFrame([(i, [*ws, None, " ", "."], s, "src", "x") for i, ws, s in sents], SCHEMA)
    df = df.unionByName(df.limit(40))
    portions = spark.createDataFrame([("train", ["a", "b", "a", None]), ("dev", ["c"]), ("test", ["d", None])], "portion_name string, sections array<string>")
    got = {tuple(x) for x in overlap.found(df, portions).collect()}
    want = brute(sents, split)
    assert len(want) > 50 and got == want
    pairs, members = overlap.overlaps(df, portions)
    assert pairs.where("n_common < 0.75 * n_union").count() == 0
    assert overlap.report(df, portions).agg({"n_links": "sum"}).first()[0] >= len(want) / 2


def test_dirt(spark):
    portions = spark.createDataFrame([("train", ["a"]), ("dev", None)], "portion_name string, sections array<string>")
    df = spark.createDataFrame([(1, None, "a", None, ""), (2, [], "a", None, ""), (None, ["x"] * 20, "a", None, ""), (3, list("abcdefghijkl"), None, None, "")], SCHEMA)
    assert overlap.found(df, portions).count() == 0
    assert overlap.found(df.limit(0), portions.limit(0)).count() == 0


def test_blocks_lose_no_pair():
    """Any two bit sets within the radius share EQUAL segments, so also the first chain of them."""
    import numpy as np

    r = random.Random(3)
    for radius in (0, 2, 5, 9, 16):
        for _ in range(60):
            a = r.sample(range(overlap.BITS), 30)
            b = list(a)
            for _ in range(r.randint(0, radius)):
                b.pop() if r.random() < 0.5 and len(b) > 15 else b.append(r.randrange(overlap.BITS))
            b = sorted(set(b))
            if len(set(a) ^ set(b)) > radius:
                continue
            c = overlap.segment_codes(np.array([0, len(a), len(a) + len(b)]), np.array(a + b), radius)
            assert c.shape == (2, radius + overlap.EQUAL) and (c[0] == c[1]).sum() >= overlap.EQUAL


def test_radii_cover_every_sum():
    for t in (0.75, 0.8, 0.9):
        levels = overlap.radii(t, 500)
        top = int((1 - t) / (1 + t) * (500 + 500 / t) + 1e-9)
        assert levels[-1] >= top and all(any(x >= r and x <= max(r, overlap.SMALL, r * 8 // 7 + 1) for x in levels) for r in range(top + 1))


def test_crowded_blocks_are_refined(spark, monkeypatch):
    """Sets that share most of their words crowd every block; refining them loses nothing."""
    monkeypatch.setattr(overlap, "CROWD", 0)
    r = random.Random(11)
    base = [f"b{i}" for i in range(9)]
    sents = [(i, base + r.sample([f"x{j}" for j in range(8)], 5), r.choice("abcd")) for i in range(120)]
    df = spark.createDataFrame([(i, ws, s, None, "") for i, ws, s in sents], SCHEMA)
    portions = spark.createDataFrame([("train", ["a", "b"]), ("dev", ["c"]), ("test", ["d"])], "portion_name string, sections array<string>")
    got = {tuple(x) for x in overlap.found(df, portions).collect()}
    assert got == brute(sents, {"a": "train", "b": "train", "c": "dev", "d": "test"})
