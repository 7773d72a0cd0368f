"""Splits, percentiles, formatting duplicates and packing."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import formatting as D
from framelake.llm import packing as K
from framelake.llm import percentiles as P
from framelake.llm import splits as S


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def found(df):
    return {r[0]: r[1] for r in df.collect()}


def test_links(spark):
    rows = [(1, "A ", None, None), (2, "a", " ", 7), (3, "unknown", "N/A", None), (4, "UNKNOWN", "n/a", 4), (5, None, "-", 3), (6, " b", "b", 99), (7, "", "x", None), (8, "c", "B", 2), (1, "A ", None, None), (None, "a", None, 1)]
    df = spark.createDataFrame(rows, "e bigint, op string, sc string, p bigint").withColumn("node", F.lit(0)).withColumn("key", F.lit("k"))
    got = found(S.components(S.links(df, "e", ["op", "sc"], "p")))
    # an operator is not a scene: b and B link 6 and 8 only where both are scenes
    assert got == {1: 1, 2: 1, 7: 1, 8: 1, 6: 1, 3: 3, 5: 3}
    assert S.components(S.links(df.limit(0), "e", ["op"], "p")).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    random.seed(3)
    if shape == "chain":
        order = random.sample(range(120), 120)
        edges = list(zip(order, order[1:]))
    elif shape == "star":
        edges = [(500, i) for i in range(200)]
    else:
        edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)]
    df = S._oriented(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert found(S.components(df)) == union_find([e for e in edges if e[0] != e[1]])


def test_components_grow(spark):
    old = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (9, 9)], "node bigint, component bigint")
    new = S._oriented(spark.createDataFrame([(6, 2), (7, 8)], "u bigint, v bigint"))
    assert found(S.components(new, old)) == {1: 1, 2: 1, 5: 1, 6: 1, 9: 9, 7: 7, 8: 7}


def test_splits_keep_and_quarantine(spark):
    random.seed(1)
    rows = [(i, f"op{i % 400}", None, "r" if i % 2 else "q", 1) for i in range(1200)]
    df = spark.createDataFrame(rows, "e bigint, op string, p bigint, repo string, w int")
    shares = spark.createDataFrame([("q", 0.5, 0.0, 0.5)], "home string, train double, val double, test double")
    first = S.split_records(df, "e", ["op"], "p", "repo", "w", shares).cache()
    by = {r["component"]: set() for r in first.select("component").distinct().collect()}
    count = {}
    for r in first.collect():
        by[r["component"]].add(r["split"])
        home = "r" if (r["component"] % 2) else "q"
        count[(home, r["split"])] = count.get((home, r["split"]), 0) + 1
    assert all(len(s) == 1 for s in by.values()) and first.count() == 1200
    assert abs(count[("r", "train")] - 480) <= 12 and abs(count[("r", "val")] - 60) <= 12 and abs(count[("q", "train")] - 300) <= 12 and ("q", "val") not in count
    # later: a new record joins a train and a test component, others stay
    sides = {s: first.where(F.col("split") == s).first()["node"] for s in ("train", "test")}
    more = df.union(spark.createDataFrame([(5000, f"op{sides['train'] % 400}", sides["test"], "r", 1), (5001, "new", None, "r", 1)], df.schema))
    second = {r["node"]: r for r in S.split_records(more, "e", ["op"], "p", "repo", "w", shares, previous=first.select("node", "component", "split")).collect()}
    old = {r["node"]: r["split"] for r in first.collect()}
    assert second[5000]["split"] == S.QUARANTINE and second[5000]["status"] == "quarantined" and second[5001]["status"] == "new"
    touched = {n for n, r in second.items() if r["split"] == S.QUARANTINE}
    assert len(touched) == 7 and all(second[n]["split"] == s for n, s in old.items() if n not in touched)


def test_shares(spark):
    rows = [("a", '{"train": "0:80", "test": "80:100"}'), ("b", None), ("c", "{"), ("d", '{"train": "x"}')]
    got = {r["home"]: (r["train"], r["val"], r["test"]) for r in S.shares_of(spark.createDataFrame(rows, "repo string, s string"), "repo", "s").collect()}
    assert got == {"a": (0.8, 0, 0.2), "b": (0.8, 0.1, 0.1), "c": (0.8, 0.1, 0.1), "d": (0.8, 0.1, 0.1)}


def test_exact_percentiles(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": np.concatenate([np.zeros(4000), rng.normal(size=2000)]), "one": np.array([3.0]), None: rng.integers(0, 9, 50).astype(float), "two": np.array([1.0, 2.0])}
    rows = [(g, float(x), i) for g, v in groups.items() for i, x in enumerate(v)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([*rows, ("hot", None, 0)], "g string, x double, i int").withColumn("n", F.lit(1)).withColumn("stats", F.lit("clash"))
    got = {r["g"]: r for r in P.percentiles(df, ["g"], "x", spread=F.pmod("i", F.lit(64))).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g]["n"] == len(v)
        for q in P.QUANTILES:
            assert math.isclose(got[g][f"q{round(q * 100):02d}"], float(np.quantile(v, q)), abs_tol=1e-12)
    assert P.percentiles(df.limit(0), ["g"], "x").count() == 0


def test_digests_combine_within_the_bound(spark):
    rng = np.random.default_rng(7)
    days = {d: rng.lognormal(sigma=2, size=n) for d, n in ((1, 5000), (2, 37), (3, 900))}
    df = spark.createDataFrame([("r", d, float(x)) for d, v in days.items() for x in v], "r string, d int, x double")
    parts = P.digests(df, ["r", "d"], "x", resolution=100)
    assert max(len(r["points"]) for r in parts.collect()) == 101
    got = P.combine_digests(parts, ["r"]).first()
    every = np.sort(np.concatenate(list(days.values())))
    assert got["n"] == len(every) and 0 < got["rank_error"] <= 0.01
    for q in P.QUANTILES:
        x = got[f"q{round(q * 100):02d}"]
        lo, hi = np.searchsorted(every, x, "left") / len(every), np.searchsorted(every, x, "right") / len(every)
        assert lo - got["rank_error"] - 1e-3 <= q <= hi + got["rank_error"] + 1e-3
    small = P.combine_digests(P.digests(df.where("d = 2"), ["r", "d"], "x"), ["r"]).first()
    assert small["rank_error"] == 0 and small["q50"] == float(np.sort(days[2])[18])


def test_wrong_quantiles(spark):
    rng = np.random.default_rng(11)
    values, stats, wrong = [], [], set()
    for e in range(60):
        v = np.round(rng.normal(size=int(rng.integers(15, 60))), 1)
        values += [(e, float(x)) for x in v]
        s = [float(np.quantile(v, q) + rng.choice([0, 0, 0.3, -0.3])) for q in (0.1, 0.5, 0.9)]
        if e == 7:
            s[1] = None
        stats.append((e, *s))
        n = len(v)
        bad = any(x is not None and (10 * int((v < x).sum()) > (p + 1) * n or 10 * int((v <= x).sum()) < (p - 1) * n) for p, x in zip((1, 5, 9), s))
        if bad and n >= 20:
            wrong.add(e)
    st = spark.createDataFrame([*stats, stats[0], (999, 0.0, 0.0, 0.0)], "e int, q10 double, q50 double, q90 double").withColumn("n", F.lit(3))
    vs = spark.createDataFrame(values, "e int, x double")
    assert {r[0] for r in P.wrong_quantiles(st, vs, ["e"], "x").collect()} == wrong and 5 < len(wrong) < 55


SAME = [
    ["Push the lid at 1.5 m", "push  the LID, at 1.5 m.", "push_the_lid_at_1.5_m", "“Push the ​lid (at 1.5 m)”…", "push-the-lid-at-1.5-m"],
    ["Push the lid at 15 m"], ["Push the lid at -1.5 m"], ["Push the lids at 1.5 m"], ["lid the push at 1.5 m"],
    ['{"action": "push", "note": "at -5 N"}', "note=At -5 n; action=PUSH;", "Action: push | NOTE: at -5 N", "action = push ;note = at -5 N", "note=at -5 N,\taction=push", '{"note":"at -5 N" ,"action":"push"}', "note=at -5 N,\taction=push;", "action=push,note=at\n-5 N", "| action: push\nnote: at -5 N ,"],
    ["action=push; note=at 5 N"], ["action push note at -5 N"], ["Stop: now"], ["now stop"], ["open the caf\u00e9", "Open the cafe\u0301"], ["open the cafe"],
]


def test_formatting_duplicates(spark):
    rows, k = [], 0
    for g, texts in enumerate(SAME):
        for t in texts:
            rows.append((k, t, g))
            k += 1
    extra = [(900, None, -1), (901, "  ​", -1), (902, "--", -1), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows + extra, "i bigint, t string, g int").withColumn("key", F.lit("x")).withColumn("hash", F.lit(1))
    want = {(min(i for i, _, h in rows if h == g), i) for i, _, g in rows} - {(i, i) for i, _, _ in rows}
    assert {tuple(r) for r in D.duplicate_members(df, "i", "t").collect()} == want
    copies = {r["first_key"]: r["n_copies"] for r in D.duplicate_groups(df, "i", "t").collect()}
    assert sorted(copies.values()) == sorted(len(t) for t in SAME) and sum(copies.values()) == len(rows)
    assert D.duplicate_members(df.limit(0), "i", "t").count() == 0
    long = spark.createDataFrame([(1, "a b " * 50_000), (2, "A  B " * 50_000)], "i bigint, t string")
    assert [tuple(r) for r in D.duplicate_members(long, "i", "t").collect()] == [(1, 2)]


def test_hash_collisions_are_divided(spark, monkeypatch):
    monkeypatch.setattr(D.F, "md5", lambda c: F.lit("00" * 16))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A."), (4, "b!")], "i bigint, t string")
    assert sorted(map(tuple, D.duplicate_members(df, "i", "t").collect())) == [(1, 3), (2, 4)]


def test_pack_sizes():
    rng = np.random.default_rng(0)
    for n, cap in ((0, 100), (1, 100), (400, 100), (3000, 100)):
        sizes = rng.uniform(0.1, 60, n)
        out = K.pack_sizes(sizes, sizes**2, cap)
        fill = np.bincount(out, sizes) if n else np.zeros(0)
        assert (fill <= cap + 1e-6).all() and len(out) == n
        if n > 100:
            assert len(fill) <= math.ceil(sizes.sum() / cap) * 1.03 + 1


def test_packing(spark):
    rng = random.Random(4)
    rows = [("r", "data", i, rng.uniform(0, 40), rng.randrange(400), 100.0) for i in range(900)]
    rows += [("r", "data", 1000, 250.0, 10, 100.0), ("r", "data", 1001, 200.0, 10, 100.0), ("q", "data", 1, None, None, 100.0), ("q", "data", 2, float("nan"), 5, 100.0), (None, "data", 3, -4.0, -1, 100.0), ("q", "video", 1, 100.0, 3, 100.0)]
    items = spark.createDataFrame(rows, "grp string, kind string, item bigint, size double, length bigint, capacity double").withColumn("block", F.lit(7)).withColumn("local", F.lit(7))
    for block in (20_000, 200):
        got = K.pack(items, block=block).collect()
        fill, seen = {}, {}
        for r in got:
            fill[(r["grp"], r["kind"], r["container"])] = fill.get((r["grp"], r["kind"], r["container"]), 0) + r["size"]
            seen.setdefault((r["grp"], r["kind"], r["item"]), []).append(r["piece"])
        assert max(fill.values()) <= 100 + 1e-6
        assert sorted(seen[("r", "data", 1000)]) == [0, 1, 2] and sorted(seen[("r", "data", 1001)]) == [0, 1] and len(seen) == len(rows)
        ordinals = sorted(k[2] for k in fill if k[0] == "r")
        assert ordinals == list(range(len(ordinals)))
        total = sum(r[3] for r in rows if r[0] == "r")
        assert len(ordinals) <= math.ceil(total / 100) * 1.04 + 2
    assert K.pack(items.limit(0)).count() == 0
