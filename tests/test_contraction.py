"""Filling, flats and accumulation over many small tiles against plain Python, and the number of passes over the raster."""

import heapq
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment import borders, tiles
from catchment.borders import Forest, ends_of, roots_of
from catchment.grid import DIRECTIONS, GridMeta
from catchment.operators import conditioning, routing


def frame(spark, z):
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "r int, c int, z double"), GridMeta(*z.shape)


def raster(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.select("r", "c", column).collect():
        out[r.r, r.c] = np.nan if r[2] is None else r[2]
    return out


def near(shape, r, c):
    for dr, dc in DIRECTIONS:
        if 0 <= r + dr < shape[0] and 0 <= c + dc < shape[1]:
            yield r + dr, c + dc


def flooded(z, nodata_outlets):
    h, w = z.shape
    level = np.full(z.shape, np.inf)
    queue = []
    for r in range(h):
        for c in range(w):
            edge = r in (0, h - 1) or c in (0, w - 1)
            if not np.isnan(z[r, c]) and (edge or nodata_outlets and any(np.isnan(z[n]) for n in near(z.shape, r, c))):
                level[r, c] = z[r, c]
                queue.append((z[r, c], r, c))
    heapq.heapify(queue)
    while queue:
        v, r, c = heapq.heappop(queue)
        for n in near(z.shape, r, c):
            if not np.isnan(z[n]) and max(z[n], v) < level[n]:
                level[n] = max(z[n], v)
                heapq.heappush(queue, (level[n], *n))
    return np.where(np.isinf(level), z, level)


def terrain(seed, shape=(23, 31), steps=6, holes=0.05):
    rng = np.random.default_rng(seed)
    z = rng.integers(0, steps, shape).astype(float)
    z[rng.random(shape) < holes] = np.nan
    return z


@pytest.fixture
def deep(monkeypatch):
    """Groups of two by two, so that small rasters have several levels."""
    monkeypatch.setattr(borders, "GROUP", 2)


@pytest.mark.parametrize("seed, size, outlets, holes", [(1, 4, True, 0.05), (2, 3, False, 0.05), (3, 5, False, 0.5), (4, 1, True, 0.02)])
def test_filling_in_tiles(spark, deep, seed, size, outlets, holes):
    z = terrain(seed, holes=holes) if size > 1 else terrain(seed, (7, 6), holes=holes)
    cells, meta = frame(spark, z)
    got = raster(conditioning.fill_depressions(cells, meta, outlets, size), "filled", z.shape)
    np.testing.assert_array_equal(got, flooded(z, outlets))


def test_tiles_without_rows_are_nodata(spark, deep):
    z = terrain(9, (12, 12), holes=0)
    gone = z.copy()
    gone[4:8, 4:8] = np.nan
    cells, meta = frame(spark, z)
    there = cells.filter("not (r between 4 and 7 and c between 4 and 7)")
    got = raster(conditioning.fill_depressions(there, meta, size=4), "filled", z.shape)
    np.testing.assert_array_equal(got, flooded(gone, True))


def flats_by_hand(z):
    h, w = z.shape
    cells = [(r, c) for r in range(h) for c in range(w) if not np.isnan(z[r, c])]
    candidate = {x: not any(z[n] < z[x] for n in near(z.shape, *x)) for x in cells}
    high = {x: candidate[x] and any(z[n] > z[x] for n in near(z.shape, *x)) for x in cells}
    edge = lambda x: x[0] in (0, h - 1) or x[1] in (0, w - 1)
    low = {x: candidate[x] and edge(x) or not candidate[x] and any(candidate.get(n) and z[n] == z[x] for n in near(z.shape, *x)) for x in cells}
    root = {}
    for x in cells:
        if low[x] and x not in root:
            root[x] = x
            todo = [x]
            while todo:
                at = todo.pop()
                for n in near(z.shape, *at):
                    if z[n] == z[x] and n not in root:
                        root[n] = x
                        todo.append(n)

    def steps(sources):
        d = dict.fromkeys(sources, 1)
        todo = deque(sources)
        while todo:
            x = todo.popleft()
            for n in near(z.shape, *x):
                if z[n] == z[x] and candidate[n] and n in root and n not in d:
                    d[n] = d[x] + 1
                    todo.append(n)
        return d

    d_low, d_high = steps([x for x in cells if low[x]]), steps([x for x in cells if high[x] and x in root and not low[x]])
    top = {}
    for x, d in d_high.items():
        top[root[x]] = max(top.get(root[x], 0), d)
    mask, label = np.zeros(z.shape), np.full(z.shape, np.nan)
    ranks = {x: k + 1 for k, x in enumerate(sorted(set(root.values())))}
    for x in cells:
        if x in root:
            label[x] = ranks[root[x]]
        a, b = d_low.get(x), d_high.get(x)
        mask[x] = (-(b or 0)) if a is None else (top[root[x]] - b + 2 * a if b else 2 * a)
    return label, mask


@pytest.mark.parametrize("seed, size", [(5, 4), (6, 3), (7, 64)])
def test_flats_in_tiles(spark, deep, seed, size):
    z = flooded(terrain(seed, (20, 24), 4), True)
    cells, meta = frame(spark, z)
    done = conditioning.materialize(conditioning.resolve_flats(cells, meta, size=size))
    label, mask = flats_by_hand(z)
    np.testing.assert_array_equal(raster(done, "label", z.shape), label)
    np.testing.assert_array_equal(raster(done, "flat_mask", z.shape), mask)
    np.testing.assert_array_equal(raster(conditioning.flats(cells, meta, size=size), "label", z.shape), label)


def claimed_by_hand(z, equal, lower):
    """(label, mask) where low edges claim cells one after the other."""
    h, w = z.shape
    cells = [(r, c) for r in range(h) for c in range(w) if not np.isnan(z[r, c])]
    valid = set(cells)
    around = {x: [n for n in near(z.shape, *x) if n in valid] for x in cells}
    candidate = {x: not any(z[n] - z[x] < -lower for n in around[x]) for x in cells}
    high = [x for x in cells if candidate[x] and any(z[n] - z[x] > equal for n in around[x])]
    edge = lambda x: x[0] in (0, h - 1) or x[1] in (0, w - 1)
    low = [x for x in cells if candidate[x] and edge(x) or not candidate[x] and any(candidate[n] and abs(z[n] - z[x]) <= equal for n in around[x])]
    label, count = {}, 0
    for seed in low:
        if seed in label:
            continue
        count += 1
        label[seed], todo = count, [seed]
        while todo:
            for n in around[todo.pop()]:
                if n not in label and abs(z[n] - z[seed]) <= equal:
                    label[n] = count
                    todo.append(n)

    def steps(sources):
        d = dict.fromkeys(sources, 1)
        todo = deque(sources)
        while todo:
            x = todo.popleft()
            for n in around[x]:
                if candidate[n] and label.get(n) == label.get(x) and n in label and n not in d:
                    d[n] = d[x] + 1
                    todo.append(n)
        return d

    kept = set(low)
    d_low, d_high = steps(low), steps([x for x in high if x in label and x not in kept])
    top = {}
    for x, d in d_high.items():
        top[label[x]] = max(top.get(label[x], 0), d)
    mask, labels = np.zeros(z.shape), np.full(z.shape, np.nan)
    for x in cells:
        labels[x] = label.get(x, np.nan)
        a, b = d_low.get(x), d_high.get(x)
        mask[x] = (-(b or 0)) if a is None else (top[label[x]] - b + 2 * a if b else 2 * a)
    return labels, mask


@pytest.mark.parametrize("seed, equal, lower, size", [(1, 0.5, 0.0, 64), (2, 0.5, 0.25, 5), (3, 1.0, 1.0, 4), (4, 0.0, 1.0, 6), (5, 0.01, 0.0, 5)])
def test_flats_within_a_tolerance(spark, deep, seed, equal, lower, size):
    """Claims of low edges in their order; some components are level, some uneven, some are cut by tiles."""
    z = terrain(seed, (18, 22), 12) / 4
    z[5:11, 4:15] = 1.0
    cells, meta = frame(spark, z)
    done = conditioning.materialize(conditioning.resolve_flats(cells, meta, size=size, equal_tol=equal, lower_tol=lower))
    label, mask = claimed_by_hand(z, equal, lower)
    np.testing.assert_array_equal(raster(done, "label", z.shape), label)
    np.testing.assert_array_equal(raster(done, "flat_mask", z.shape), mask)
    with pytest.raises(ValueError):
        conditioning.resolve_flats(cells, meta, equal_tol=-1)


def accumulated_by_hand(code, mass):
    """(total, whether every inflow is complete); cells on or behind a circle keep what is complete."""
    h, w = code.shape
    to, waits, into = {}, {}, {}
    for r in range(h):
        for c in range(w):
            if np.isnan(mass[r, c]):
                continue
            n = (r + DIRECTIONS[code[r, c]][0], c + DIRECTIONS[code[r, c]][1]) if code[r, c] >= 0 else None
            if n and 0 <= n[0] < h and 0 <= n[1] < w and not np.isnan(mass[n]):
                to[r, c] = n
                into.setdefault(n, []).append((r, c))
    total, ready = {}, [x for x in np.ndindex(h, w) if not np.isnan(mass[x]) and x not in into]
    waits = {x: len(v) for x, v in into.items()}
    while ready:
        x = ready.pop()
        total[x] = mass[x] + sum(total[s] for s in into.get(x, []))
        if x in to:
            waits[to[x]] -= 1
            if not waits[to[x]]:
                ready.append(to[x])
    out = np.zeros((h, w))
    for x in np.ndindex(h, w):
        if not np.isnan(mass[x]):
            out[x] = total[x] if x in total else mass[x] + sum(total.get(s, 0) for s in into.get(x, []))
    return out, all(x in total for x in np.ndindex(h, w) if not np.isnan(mass[x]))


@pytest.mark.parametrize("seed, size, circles", [(1, 4, True), (2, 3, False), (3, 7, True), (4, 64, True)])
def test_single_flow_in_tiles(spark, deep, seed, size, circles):
    rng = np.random.default_rng(seed)
    shape = (19, 26)
    mass = rng.integers(0, 9, shape).astype(float)
    mass[rng.random(shape) < 0.1] = np.nan
    code = rng.choice([-2, *range(8)], shape)
    if not circles:  # down or east alone
        code = rng.choice([1, 2, 3, 4], shape, p=[0.2, 0.3, 0.3, 0.2])
    rows = [(r, c, None if np.isnan(mass[r, c]) else 1.0, int(code[r, c]), float(np.nan_to_num(mass[r, c]))) for r, c in np.ndindex(shape)]
    cells = spark.createDataFrame(rows, "r int, c int, z double, dir int, area_m2 double")
    want, whole = accumulated_by_hand(code, mass)
    got = raster(routing.accumulate(cells, GridMeta(*shape), "m2", size, cycle_check=False), "acc", shape)
    np.testing.assert_allclose(got, want)
    if circles:
        assert not whole
        with pytest.raises(routing.FlowCycleError):
            routing.accumulate(cells, GridMeta(*shape), "m2", size)
    else:
        assert whole


def snake(n, long):
    """A valley of n x n cells whose only way out is near (or, if long, winds through the whole raster)."""
    z = np.full((n, n), 9.0)
    z[1:-1, 1:-1] = 1.0
    if long:
        for k in range(3, n - 1, 2):
            z[k, 1:-1] = 9.0
            z[k, 1 if (k // 2) % 2 else n - 2] = 1.0
    z[n - 1, n - 2] = 2.0
    return z


@pytest.mark.parametrize("job", ["fill", "labels", "flow"])
def test_passes_do_not_depend_on_the_distance(spark, deep, monkeypatch, job):
    """The same number of results is written and of tiles read whether water leaves nearby or after hundreds of cells."""
    written = []
    keep = borders.materialize
    for module in (borders, tiles, conditioning, routing):
        monkeypatch.setattr(module, "materialize", lambda df: written.append(1) or keep(df))
    counts = []
    for long in (False, True):
        z = snake(32, long)
        cells, meta = frame(spark, z)
        written.clear()
        if job == "fill":
            done = conditioning.fill_depressions(cells, meta, size=4)
            np.testing.assert_array_equal(raster(done, "filled", z.shape), flooded(z, True))
        elif job == "labels":
            conditioning.flats(cells, meta, size=4).collect()
        else:  # one path through every cell, or many short ones
            code = lambda r, c: (1 if r % 2 == 0 and c < 31 else 5 if r % 2 and c > 0 else 3) if long else 3
            rows = [(r, c, 1.0, code(r, c)) for r in range(32) for c in range(32)]
            acc = raster(routing.accumulate(spark.createDataFrame(rows, "r int, c int, z double, dir int"), meta, size=4), "acc", z.shape)
            assert acc.max() == (32 * 32 if long else 32)
        counts.append(len(written))
    assert counts[0] == counts[1] and counts[0] < 12


def test_graph_kernels():
    rng = random.Random(4)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(10)) for _ in range(90)]
    a, b, w = (np.array(x) for x in zip(*edges))

    def levels(source, pairs):
        best = {source: -np.inf}
        for _ in range(n):
            for x, y, v in pairs:
                for s, t in ((x, y), (y, x)):
                    if s in best and max(best[s], v) < best.get(t, np.inf):
                        best[t] = max(best[s], v)
        return [best.get(k, np.inf) for k in range(n)]

    forest = Forest(n, a, b, w)
    for s in (0, 7, 33):
        assert forest.levels(s).tolist() == levels(s, edges)
    keep = np.zeros(n, bool)
    keep[[0, 3, 7, 20, 33, 41, 59]] = True
    short = list(zip(*(x.tolist() for x in forest.contracted(keep))))
    assert len(short) < 7 and all(keep[x] and keep[y] for x, y, _ in short)
    assert [v for v, k in zip(levels(7, short), keep) if k] == [v for v, k in zip(levels(7, edges), keep) if k]
    root = roots_of(n, a, b)
    assert all(root[x] == root[y] for x, y, _ in edges) and all(root[root[k]] == root[k] <= k for k in range(n))
    assert len(set(root.tolist())) == n - len(forest.weight)
    step = np.array([1, 2, 2, 4, 5, 3, 3])  # 3, 4 and 5 run in a circle
    assert ends_of(step).tolist() == [2, 2, 2, -1, -1, -1, -1]


def test_multiple_flow_in_tiles(spark):
    z = flooded(terrain(12, (14, 17), 40), True) + np.random.default_rng(0).random((14, 17)) * 1e-3
    cells, meta = frame(spark, z)
    flow = routing.mfd(cells, meta, steps=(1.0, 1.0)).join(cells, ["r", "c"])
    flow = conditioning.materialize(flow)
    whole, parts = (raster(routing.accumulate(flow, meta, size=s), "acc", z.shape) for s in (64, 4))
    np.testing.assert_allclose(parts, whole)
    assert flow.filter(F.col("z").isNull()).count() == int(np.isnan(z).sum())


def test_small_tiles_are_solved_together(spark, monkeypatch):
    """Kernels take stacks of tiles and give each what it gets alone; a stack holds a bounded number of cells, whatever the number of tiles."""
    rng = np.random.default_rng(5)
    mass, total = np.ones((3, 6, 7)), np.full((3, 6, 7), np.nan)
    total[:, [0, -1]], total[:, :, [0, -1]] = 2.0, 2.0
    down = rng.random((8, 3, 6, 7)) * (np.arange(8) < 3)[:, None, None, None]  # to the east alone: no circles
    flow = {"mass": mass, "w": (down / down.sum(axis=0)).astype("f4"), "total": total}
    whole = routing._gather(flow)
    for i in range(3):
        np.testing.assert_array_equal(whole[i], routing._gather({"mass": mass[i], "w": flow["w"][:, i], "total": total[i]}))
    assert whole.shape == (3, 4, 5) and not np.isnan(whole).any()
    z = rng.integers(0, 2, (3, 6, 7)).astype(float)
    flat = {"z": z, "flags": np.full(z.shape, conditioning.OPEN, np.uint8), "dist": np.where(rng.random((2, 3, 6, 7)) < 0.1, 1, conditioning._NEVER).astype(np.int32)}
    steps = conditioning._spread(flat)
    for i in range(3):
        np.testing.assert_array_equal(steps[:, i], conditioning._spread({"z": z[i], "flags": flat["flags"][i], "dist": flat["dist"][:, i]}))
    meta = GridMeta(40, 4)
    rows = spark.createDataFrame([(i, 0) for i in range(10)], "tr int, tc int").coalesce(1)
    together = lambda most: sorted(r.n for r in tiles.each_stack(rows, lambda some: [{"n": len(some)}], "n long", meta, most).collect())
    assert together(4) == [10]
    monkeypatch.setattr(tiles, "STACK", 4 * 36)
    assert together(4) == [2, 4, 4]
    monkeypatch.setattr(tiles, "STACK", 1)
    assert together(4) == [1] * 10


def test_a_worker_gets_few_megabytes_of_tiles_at_once(spark):
    """A partition of many large tiles reaches Python in batches of bounded bytes."""
    many = spark.range(0, 40, 1, 1).select(F.col("id").cast("int").alias("tr"), F.lit(0).alias("tc"), F.repeat(F.lit("x"), 1 << 20).cast("binary").alias("z"))
    assert tiles.each_tile(many, lambda row: {"n": len(row["z"])}, "n long").agg(F.sum("n")).first()[0] == 40 << 20
    count = many.mapInArrow(lambda batches: (b.select(["tr"]).slice(0, 1) for b in batches), "tr int").count()
    assert count >= 4
