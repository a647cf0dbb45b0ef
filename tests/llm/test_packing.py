"""Packing: valid, whole, near the bound; bounds against exact optima."""

import random
from functools import cache

import numpy as np
import pytest

from notelode.llm import packing
from notelode.llm.packing import best_fit_decreasing, lower_bound, pack, use


def optimum(sizes, capacity):
    """Fewest containers, by search over sets."""
    n = len(sizes)

    @cache
    def best(mask):
        """(containers, - room left in the last one) of the items in a set, as few and as roomy as can be."""
        if mask == 0:
            return 0, 0
        out = []
        for i in range(n):
            if mask >> i & 1:
                bins, room = best(mask ^ (1 << i))
                out.append((bins, room + sizes[i]) if -room >= sizes[i] else (bins + 1, sizes[i] - capacity))
        return min(out)

    return best((1 << n) - 1)[0]


def test_bound_and_fit_against_optimum():
    rng = random.Random(3)
    for _ in range(60):
        c = rng.choice([7, 20, 33])
        sizes = [rng.randrange(1, c + 1) for _ in range(rng.randrange(1, 9))]
        best = optimum(tuple(sizes), c)
        bins = best_fit_decreasing(np.array(sizes), c)
        loads = np.bincount(bins, weights=sizes)
        assert loads.max() <= c
        assert lower_bound(np.array(sizes), c) <= best <= len(loads) <= best * 11 / 9 + 1


def test_bound_sees_large_items():
    assert lower_bound(np.array([51] * 7), 100) == 7
    assert lower_bound(np.array([34] * 9), 100) == 5
    assert lower_bound(np.array([], dtype=int), 100) == 0 and lower_bound(np.array([0, 0]), 100) == 0


@pytest.mark.parametrize("items", [packing.ITEMS, 60])
def test_whole(spark, items):
    rng = random.Random(8)
    rows = [(i, int(rng.lognormvariate(4, 1))) for i in range(500)] + [(500, 0), (501, None), (502, 1000), (503, 2150), (7, 12)]
    packs = [("a", 512), ("b", 1000)]
    packed = pack(spark.createDataFrame(rows, "doc long, n long"), "doc", "n", packs, items)
    got = packed.placed.collect()
    for name, c in packs:
        mine = [r for r in got if r["pack_name"] == name]
        loads, tokens, pieces = {}, {}, {}
        for r in mine:
            loads[r["container"]] = loads.get(r["container"], 0) + r["size"]
            tokens[r["doc"]] = tokens.get(r["doc"], 0) + r["size"]
            pieces.setdefault(r["doc"], []).append((r["first"], r["size"]))
        want = {}
        for d, n in rows:
            want[d] = want.get(d, 0) + (n or 0)
        assert tokens == want and max(loads.values()) <= c
        assert all(len(p) == 1 for d, p in pieces.items() if d != 7 and want[d] <= c)
        assert sorted(pieces[503])[0] == (0, min(c, 2150))
        assert len(loads) <= 1.1 * sum(want.values()) / c + 1
    used = {r["pack_name"]: r for r in use(packed, packs).collect()}
    bounds = packed.bounds.collect()
    for name, c in packs:
        mine = {r["container"] for r in got if r["pack_name"] == name}
        pieces = np.array([r["size"] for r in got if r["pack_name"] == name])
        assert used[name]["containers"] == len(mine) and used[name]["least"] == lower_bound(pieces, c) <= len(mine)
        # What was closed in each partition and round is what there is.
        own = [r for r in bounds if r["pack_name"] == name]
        assert sum(r["closed"] for r in own) == len(mine) and all(r["bound"] <= r["bins"] for r in own)
        assert (len(own) > 1) == (items == 60)


def test_exchange_between_partitions(spark):
    """Partitions that share what isn't full need hardly more containers than one partition."""
    rng = random.Random(5)
    rows = [(i, rng.randrange(1, 300)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc long, n long")
    packs = [("a", 512)]
    one, many = (use(pack(df, "doc", "n", packs, each), packs).first() for each in (10_000, 500))
    assert many["least"] == one["least"] and many["gap"] <= one["gap"] + 0.01 * one["containers"]


def test_ids_of_any_type(spark):
    rows = [("x" * i if i % 3 else None, i) for i in range(30)]
    got = pack(spark.createDataFrame(rows, "doc string, n int"), "doc", "n", [("a", 40)]).placed
    assert dict(got.dtypes)["doc"] == "string"
    assert sorted((r["doc"] or "", r["size"]) for r in got.collect()) == sorted((d or "", n) for d, n in rows)
    big = spark.createDataFrame([((1 << 60) + 1, 3), (None, 2)], "doc long, n int")
    assert {r["doc"] for r in pack(big, "doc", "n", [("a", 40)]).placed.collect()} == {(1 << 60) + 1, None}


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([], "doc long, n long")
    assert pack(df, "doc", "n", [("a", 10)]).placed.count() == 0
    with pytest.raises(ValueError, match="positive"):
        pack(df, "doc", "n", [("a", 0)])
