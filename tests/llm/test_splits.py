import random

from lexiframe.llm import splits

SCHEMA = "sent_id bigint, docid string, section_id string, annotations struct<speaker:string>, root string"


def brute(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for _, d, s, a, _ in rows:
        if d is None:
            continue
        find(("d", d))
        keys = [("s", s)] if s is not None else []
        if a and a[0] not in (None, "", "-"):
            keys.append(("p", a[0]))
        for k in keys:
            up[find(k)] = find(("d", d))
    groups = {}
    for x in list(up):
        if x[0] == "d":
            groups.setdefault(find(x), []).append(x[1])
    return {d: min(g) for g in groups.values() for d in g}


def test_groups_and_splits(spark):
    r = random.Random(2)
    rows = [(i, f"d{r.randrange(120)}", r.choice([None, f"s{r.randrange(60)}"]), (r.choice([None, "", "-", f"p{r.randrange(150)}"]),), "x") for i in range(400)]
    rows += [(1000 + i, f"c{i:03d}", f"k{i // 2}", (f"q{(i + 1) // 2}",), "x") for i in range(60)]  # a long chain
    rows += [(2000, None, "s1", None, "x"), (2001, "lonely", None, None, "x")] + rows[:30]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert {r.docid: r.group_docid for r in splits.groups(df).collect()} == want
    got = splits.split_sentences(df).collect()
    assert {x.docid for x in got} == set(want)
    by = {}
    for x in got:
        by.setdefault(x.group_docid, set()).add(x.split)
    assert all(len(v) == 1 for v in by.values())


def test_proportions(spark):
    w = spark.createDataFrame([(f"g{i}", 1.0) for i in range(4000)] + [("big", 300.0)], "group string, weight double")
    s = splits.assign(w, {"train": 0.8, "dev": 0.1, "test": 0.1}).join(w, "group").groupBy("split").agg({"weight": "sum"}).collect()
    share = {r.split: r[1] / 4300 for r in s}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["dev"] - 0.1) < 0.01 and abs(share["test"] - 0.1) < 0.01


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert splits.groups(df).count() == 0 and splits.split_sentences(df).count() == 0
