"""Depression filling and flat resolution."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..borders import Arrays, Block, Forest, contract, joined_rims, numbered, pack, rim_cells, roots_of
from ..checkpoints import materialize
from ..grid import DIRECTIONS, GridMeta, is_edge, neighbours
from ..tiles import SIZE, Field, each_tile, from_tiles, many, padded, relax, shape, shifted, to_tiles

EPSILON = 1e-5
_FAR, _NEVER = 2**62, 2**30
#: Roots in each range of their order.
RANKED_ROWS = 1_000_000
_Z = Field("f8", np.nan)
_N = [f"n{k}" for k in range(8)]


def seeds(cells: DataFrame, meta: GridMeta, nodata_outlets: bool = True) -> DataFrame:
    """r, c, z of outlet cells: valid cells on the raster's edge and, if asked, next to NoData."""
    edge = is_edge(meta)
    if not nodata_outlets:
        return cells.filter(F.col("z").isNotNull() & edge)
    hole = F.greatest(*[F.col(n).isNull().cast("int") for n in _N]) == 1
    return neighbours(cells).filter(F.col("z").isNotNull() & (edge | hole)).select("r", "c", "z")


def _basins(z: np.ndarray) -> np.ndarray:
    """For each cell the place of the lowest cell that steepest steps down lead to; of equal cells the first counts as lower."""
    n = z.size
    height, at = np.where(np.isnan(z), np.inf, z), np.arange(n).reshape(z.shape)
    around, places = np.pad(height, 1, constant_values=np.inf), np.pad(at, 1, constant_values=n)
    best, low = height.copy(), at.copy()
    for k in range(8):
        nz, ni = shifted(around, k), shifted(places, k)
        take = (nz < best) | ((nz == best) & (ni < low))
        best, low = np.where(take, nz, best), np.where(take, ni, low)
    down = np.where(np.isnan(z), at, low).ravel()
    while not np.array_equal(down[down], down):
        down = down[down]
    return down


def _spills(z: np.ndarray, block: Block, nodata_outlets: bool) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(basin of each cell, edges): the spill levels between basins of a tile, and from basins to the outside (node z.size) at outlets."""
    basin, valid = _basins(z), ~np.isnan(z)
    h, w = z.shape
    of, parts = basin.reshape(z.shape), []
    for dr, dc in ((0, 1), (1, 1), (1, 0), (1, -1)):
        here = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
        there = (slice(dr, h), slice(max(0, dc), w + min(0, dc)))
        meet = valid[here] & valid[there] & (of[here] != of[there])
        parts.append((of[here][meet], of[there][meet], np.maximum(z[here], z[there])[meet]))
    out = np.zeros(z.shape, bool)
    for edge, on in (((0, slice(None)), block.r0 == 0), ((-1, slice(None)), block.r1 == block.meta.height), ((slice(None), 0), block.c0 == 0), ((slice(None), -1), block.c1 == block.meta.width)):
        out[edge] |= on
    if nodata_outlets:
        hole = np.pad(~valid, 1)
        for k in range(8):
            out |= shifted(hole, k)
    at = np.flatnonzero((out & valid).ravel())
    parts.append((basin[at], np.full(len(at), z.size), z.ravel()[at]))
    return basin, tuple(np.concatenate(x) for x in zip(*parts))


#: Nodes of the spill graph are basins, named by the key of their lowest cell; OUTSIDE is where water leaves.
OUTSIDE, HOLE = -1, -2


def _names(block: Block, places: np.ndarray) -> np.ndarray:
    w = block.c1 - block.c0
    return np.where(places < (block.r1 - block.r0) * w, (block.r0 + places // w) * np.int64(block.meta.width) + block.c0 + places % w, OUTSIDE)


def _shorter(edges: tuple[np.ndarray, ...], kept: np.ndarray) -> Arrays:
    """The edges contracted to the nodes to keep and the outside."""
    every, (a, b, k) = numbered(edges[0], edges[1], np.append(kept, OUTSIDE))
    keep = np.zeros(len(every), bool)
    keep[k] = True
    a, b, w = Forest(len(every), a, b, edges[2]).contracted(keep)
    return {"a": every[a], "b": every[b], "w": w}


def _met(block: Block, members: dict, nodata_outlets: bool) -> tuple[Arrays, tuple[np.ndarray, ...]]:
    """The members' rims and edges, with the edges between members and, beside NoData of another member, to the outside."""
    rims = joined_rims(members, "z", "node")
    z, node = rims["z"], rims["node"]
    i, j, alone = block.meetings(rims["key"])
    both = ~np.isnan(z[i]) & ~np.isnan(z[j])
    beside = np.concatenate([i[~np.isnan(z[i]) & np.isnan(z[j])], alone[~np.isnan(z[alone])]]) if nodata_outlets else np.empty(0, np.int64)
    a = [m["a"] for m in members.values()] + [node[i[both]], node[beside]]
    b = [m["b"] for m in members.values()] + [node[j[both]], np.full(len(beside), OUTSIDE)]
    w = [m["w"] for m in members.values()] + [np.maximum(z[i[both]], z[j[both]]), z[beside]]
    return rims, (np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64), np.concatenate(w))


def fill_depressions(cells: DataFrame, meta: GridMeta, nodata_outlets: bool = True, size: int = SIZE) -> DataFrame:
    """r, c, z, filled: each cell raised to the lowest level at which it drains to an outlet; without one it stays.

    Each tile becomes a graph of basins and the levels at which they spill; the graphs of tiles are contracted to those
    basins that reach their rims, groups of tiles likewise, and the levels of basins go back down to the tiles.
    """
    kept = {"z": _Z, "level": _Z}

    def block_of(row: dict) -> tuple[Block, np.ndarray]:
        h, w = shape(meta, row["tr"], row["tc"], size)
        return Block.at(meta, row["tr"], row["tc"], size, size), _Z.read(row["z"], h, w)

    def summary(row: dict) -> dict:
        block, z = block_of(row)
        basin, (a, b, w) = _spills(z, block, nodata_outlets)
        at, key = rim_cells(meta, block)
        level = z.ravel()[at]
        node = np.where(np.isnan(level), HOLE, _names(block, basin[at]))
        short = _shorter((_names(block, a), _names(block, b), w), node[node != HOLE])
        return {"tr": row["tr"], "tc": row["tc"], "blob": pack({"key": key, "z": level, "node": node} | short)}

    def merge(block: Block, members: dict) -> Arrays:
        rims, edges = _met(block, members, nodata_outlets)
        out = block.outer(rims["key"])
        node = rims["node"][out]
        return {"key": rims["key"][out], "z": rims["z"][out], "node": node} | _shorter(edges, node[node != HOLE])

    def solve(block: Block, members: dict, answer: Arrays | None) -> dict:
        _, (a, b, w) = _met(block, members, nodata_outlets)
        if answer:
            a, b, w = np.append(a, answer["node"]), np.append(b, np.full(len(answer["node"]), OUTSIDE)), np.append(w, answer["level"])
        nodes = {k: np.unique(m["node"][m["node"] != HOLE]) for k, m in members.items()}
        every, (a, b, out) = numbered(a, b, np.concatenate([[OUTSIDE], *nodes.values()]))
        level = Forest(len(every), a, b, w).levels(int(out[0]))
        return {k: {"node": n, "level": level[np.searchsorted(every, n)]} for k, n in nodes.items()}

    def flood(row: dict) -> dict:
        block, z = block_of(row)
        basin, (a, b, w) = _spills(z, block, nodata_outlets)
        if row.get("blob"):
            told = pickle.loads(row["blob"])
            at = np.flatnonzero(np.isfinite(told["level"]))
            node = told["node"][at]
            place = (node // meta.width - block.r0) * (block.c1 - block.c0) + node % meta.width - block.c0
            a, b, w = np.append(a, place), np.append(b, np.full(len(at), z.size)), np.append(w, told["level"][at])
        every, (a, b, mine, out) = numbered(a, b, basin, np.array([z.size]))
        level = Forest(len(every), a, b, w).levels(int(out[0]))[mine].reshape(z.shape)
        raised = np.where(np.isinf(level), z, np.maximum(z, level))
        return {"tr": row["tr"], "tc": row["tc"], "z": z.tobytes(), "level": raised.tobytes()}

    tiles = to_tiles(cells, meta, {"z": _Z}, size)
    if many(meta, size):
        tiles = materialize(tiles)
        answers = contract(materialize(each_tile(tiles, summary, "tr int, tc int, blob binary")), meta, size, merge, solve)
        tiles = tiles.join(answers, ["tr", "tc"], "left")
    done = from_tiles(each_tile(tiles, flood, "tr int, tc int, z binary, level binary"), meta, {n: (f, "double") for n, f in kept.items()}, size)
    known = lambda n: F.when(~F.isnan(n), F.col(n))
    return done.select("r", "c", known("z").alias("z"), known("level").alias("filled"))


def fill_depth(filled: DataFrame, nodata: float | None = None) -> DataFrame:
    """r, c, depth: by how much cells were raised; at NoData NULL, or 0 where NoData is told by a number."""
    depth = F.col("filled") - F.col("z")
    return filled.select("r", "c", (depth if nodata is None or nodata != nodata else F.coalesce(depth, F.lit(0.0))).alias("depth"))


def flat_cells(cells: DataFrame, meta: GridMeta, edges_drain: bool = True) -> DataFrame:
    """r, c, z, candidate (no lower neighbour), low (drains the flat), high (has a higher neighbour)."""
    valid = F.col("z").isNotNull()
    near = neighbours(cells.select("r", "c", "z"))
    lower = F.array_contains(F.array(*[F.coalesce(F.col(n) < F.col("z"), F.lit(False)) for n in _N]), True)
    higher = F.array_contains(F.array(*[F.coalesce(F.col(n) > F.col("z"), F.lit(False)) for n in _N]), True)
    judged = near.select("r", "c", "z", (valid & ~lower).alias("candidate"), (valid & ~lower & higher).alias("high"))
    again = neighbours(judged.withColumn("spot", F.when(F.col("candidate"), F.col("z"))), "spot")
    beside = F.array_contains(F.array(*[F.coalesce(F.col(n) == F.col("z"), F.lit(False)) for n in _N]), True)
    low = valid & ((F.lit(edges_drain) & is_edge(meta) & F.col("candidate")) | (~F.col("candidate") & beside))
    return again.select("r", "c", "z", "candidate", low.alias("low"), "high")


#: Bits of a cell's flags in tiles.
CANDIDATE, HIGH, LOW, OPEN = 1, 2, 4, 8
_FLAT = {"z": _Z, "flags": Field("u1", 0), "root": Field("i8", _FAR), "dist": Field("i4", _NEVER, 2)}


def _judge(meta: GridMeta, size: int, tolerance: tuple[float, float] = (0.0, 0.0)):
    """Candidates and high cells of a tile whose z is padded; tolerance: by how much a neighbour may be higher (or differ), and by how much lower, before it counts."""

    def work(row: dict) -> dict:
        h, w = shape(meta, row["tr"], row["tc"], size)
        padded_z = _Z.read(row["z"], h + 2, w + 2)
        z = padded_z[1:-1, 1:-1]
        near = [shifted(padded_z, k) for k in range(8)]
        equal, lower = tolerance
        candidate = ~np.isnan(z) & ~np.any([x - z < -lower for x in near], axis=0)
        high = candidate & np.any([x - z > equal for x in near], axis=0)
        return {"tr": row["tr"], "tc": row["tc"], "z": z.tobytes(), "flags": (candidate * CANDIDATE + high * HIGH).astype(np.uint8).tobytes()}

    return work


def _parts(meta: GridMeta, size: int, edges_drain: bool, row: dict, equal: float = 0.0) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, z, flags, component, root) of a tile with z and flags padded: LOW is set, and a component is what elevations that differ by no more than twice ``equal`` join."""
    h, w = shape(meta, row["tr"], row["tc"], size)
    block = Block.at(meta, row["tr"], row["tc"], size, size)
    pz, pf = _Z.read(row["z"], h + 2, w + 2), _FLAT["flags"].read(row["flags"], h + 2, w + 2)
    z, flags = pz[1:-1, 1:-1], pf[1:-1, 1:-1].copy()
    candidate = (flags & CANDIDATE) > 0
    low = ~np.isnan(z) & ~candidate & np.any([(np.abs(shifted(pz, k) - z) <= equal) & ((shifted(pf, k) & CANDIDATE) > 0) for k in range(8)], axis=0)
    if edges_drain:
        r, c = np.arange(block.r0, block.r1)[:, None], np.arange(block.c0, block.c1)
        low |= candidate & ((r == 0) | (r == meta.height - 1) | (c == 0) | (c == meta.width - 1))
    flags[low] |= LOW
    a, b = [], []
    place = np.arange(h * w).reshape(h, w)
    for dr, dc in ((0, 1), (1, 1), (1, 0), (1, -1)):
        here = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
        there = (slice(dr, h), slice(max(0, dc), w + min(0, dc)))
        same = np.abs(z[here] - z[there]) <= 2 * equal
        a.append(place[here][same])
        b.append(place[there][same])
    part = roots_of(h * w, np.concatenate(a), np.concatenate(b))
    root = np.full(h * w, _FAR, np.int64)
    at = np.flatnonzero(low.ravel())
    np.minimum.at(root, part[at], _names(block, at))
    return block, z, flags, part, root[part]


def _least_roots(rims: Arrays, block: Block, equal: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, component of each, its root) after the members' components are joined where equal cells meet."""
    i, j, _ = block.meetings(rims["key"])
    same = np.abs(rims["z"][i] - rims["z"][j]) <= 2 * equal
    every, (node, a, b) = numbered(rims["node"], rims["node"][i[same]], rims["node"][j[same]])
    part = roots_of(len(every), a, b)
    root = np.full(len(every), _FAR, np.int64)
    np.minimum.at(root, part[node], rims["root"])
    return every, part, root[part]


def _flat_tiles(cells: DataFrame, meta: GridMeta, edges_drain: bool, size: int, tolerance: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Tiles with z, flags, root (row-major id of the flat's first low edge), and dist: 1 at low and at high edges.

    Components of a tile are joined with those of its neighbours on their rims alone, group by group.
    """
    tiles = to_tiles(cells, meta, {"z": _Z}, size)
    tiles = materialize(tiles) if many(meta, size) else tiles
    keep = {n: _FLAT[n] for n in ("z", "flags")}
    judged = each_tile(padded(tiles, meta, {"z": _Z}, size), _judge(meta, size, tolerance), "tr int, tc int, z binary, flags binary")
    base = padded(materialize(judged) if many(meta, size) else judged, meta, keep, size)

    def summary(row: dict) -> dict:
        block, z, _, part, root = _parts(meta, size, edges_drain, row, tolerance[0])
        at, key = rim_cells(meta, block)
        valid = ~np.isnan(z.ravel()[at])
        at, key = at[valid], key[valid]
        return {"tr": row["tr"], "tc": row["tc"], "blob": pack({"key": key, "z": z.ravel()[at], "node": _names(block, part[at]), "root": root[at]})}

    def merge(block: Block, members: dict) -> Arrays:
        rims = joined_rims(members, "z", "node", "root")
        every, part, root = _least_roots(rims, block, tolerance[0])
        out = block.outer(rims["key"])
        node = np.searchsorted(every, rims["node"][out])
        return {"key": rims["key"][out], "z": rims["z"][out], "node": every[part[node]], "root": root[node]}

    def solve(block: Block, members: dict, answer: Arrays | None) -> dict:
        every, part, root = _least_roots(joined_rims(members, "z", "node", "root"), block, tolerance[0])
        if answer:
            at = part[np.searchsorted(every, answer["node"])]
            told = np.full(len(every), _FAR, np.int64)
            np.minimum.at(told, at, answer["root"])
            root = np.minimum(root, told[part])
        nodes = {k: np.unique(m["node"]) for k, m in members.items()}
        return {k: {"node": n, "root": root[np.searchsorted(every, n)]} for k, n in nodes.items()}

    def start(row: dict) -> dict:
        block, z, flags, part, root = _parts(meta, size, edges_drain, row, tolerance[0])
        if row.get("blob"):
            told = pickle.loads(row["blob"])
            place = (told["node"] // meta.width - block.r0) * (block.c1 - block.c0) + told["node"] % meta.width - block.c0
            known = np.full(z.size, _FAR, np.int64)
            known[place] = told["root"]
            root = np.minimum(root, known[part])
        root = root.reshape(z.shape)
        low, drained = (flags & LOW) > 0, root < _FAR
        flags[drained & ((flags & CANDIDATE) > 0)] |= OPEN
        dist = np.full((2, *z.shape), _NEVER, np.int32)
        dist[0][low] = 1
        dist[1][drained & ~low & ((flags & HIGH) > 0)] = 1
        return {"tr": row["tr"], "tc": row["tc"], "z": z.tobytes(), "flags": flags.tobytes(), "root": root.tobytes(), "dist": dist.tobytes()}

    if many(meta, size):
        base = materialize(base)
        answers = contract(materialize(each_tile(base, summary, "tr int, tc int, blob binary")), meta, size, merge, solve)
        base = base.join(answers, ["tr", "tc"], "left")
    return each_tile(base, start, "tr int, tc int, z binary, flags binary, root binary, dist binary")


def _spread(p: dict[str, np.ndarray]) -> np.ndarray:
    """Steps through open cells of equal elevation from the cells whose distance is known, for both distances: waves of cells."""
    around = lambda a, fill: np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1)] * 2, constant_values=fill)
    z = around(p["zone" if "zone" in p else "z"], np.nan)
    padded_shape, width = z.shape, z.shape[-1]
    may = np.zeros(z.shape, bool)
    may[..., 2:-2, 2:-2] = (p["flags"][..., 1:-1, 1:-1] & OPEN) > 0
    z, may = z.ravel(), may.ravel()
    out = []
    for plane in p["dist"]:
        dist = around(plane, _NEVER).ravel()
        known = np.flatnonzero(dist < _NEVER)
        known = known[np.argsort(dist[known], kind="stable")]
        starts = dist[known]
        at, front, d = 0, np.empty(0, np.int64), 0
        while len(front) or at < len(known):
            if not len(front):
                d = int(starts[at])
            end = int(np.searchsorted(starts, d, "right"))
            new = known[at:end]
            front, at = np.concatenate([front, new[dist[new] == d]]), end
            found = []
            for dr, dc in DIRECTIONS:
                to = front + dr * width + dc
                ok = may[to] & (z[to] == z[front]) & (dist[to] > d + 1)
                dist[to[ok]] = d + 1
                found.append(to[ok])
            front, d = np.unique(np.concatenate(found)), d + 1
        out.append(dist.reshape(padded_shape)[..., 2:-2, 2:-2])
    return np.stack(out)


def _ranked(ids: DataFrame, column: str) -> DataFrame:
    """Distinct ids with their place (from 1) in ascending order: sorted ranges, then offsets of the few ranges."""
    placed = materialize(ids.repartitionByRange(1 + ids.count() // RANKED_ROWS, column).withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return placed.join(F.broadcast(base), "part").withColumn("place", within + F.col("base")).drop("part", "base")


_SHOWN = {"z": (_Z, "double"), "flags": (Field("i2", 0), "short"), "root": (_FLAT["root"], "bigint"), "label": (Field("i4", 0), "int"), "d_high": (Field("i4", 0), "int"), "d_low": (Field("i4", 0), "int"), "flat_mask": (Field("i4", 0), "int")}


def _flat_cells_of(tiles: DataFrame, meta: GridMeta, size: int) -> DataFrame:
    """One row per cell of tiles with flags, roots and distances: labels are ranks of roots, and masks need the furthest high cell of a flat, which may lie in another tile."""
    tops_of = "tr int, tc int, tops array<struct<root: bigint, top: int>>"

    def tops(row: dict) -> dict:
        root, dist = np.frombuffer(row["root"], "i8"), np.frombuffer(row["dist"], "i4").reshape(2, -1)
        at = np.flatnonzero(root < _FAR)
        ids, of = np.unique(root[at], return_inverse=True)
        top = np.zeros(len(ids), np.int32)
        far = dist[1][at]
        np.maximum.at(top, of, np.where(far < _NEVER, far, 0))
        return {"tr": row["tr"], "tc": row["tc"], "tops": [{"root": int(i), "top": int(t)} for i, t in zip(ids, top)]}

    def finish(row: dict) -> dict:
        h, w = shape(meta, row["tr"], row["tc"], size)
        known = row["ranked"] if "ranked" in row else [t | {"label": k + 1} for k, t in enumerate(tops(row)["tops"])]
        ids = np.array([k["root"] for k in known or []], np.int64)
        order = np.argsort(ids)
        ids = np.append(ids[order], _FAR)
        top, label = (np.append(np.array([k[n] for k in known or []], np.int32)[order], 0) for n in ("top", "label"))
        root = np.frombuffer(row["root"], "i8")
        of = np.searchsorted(ids, root)
        low, high = np.frombuffer(row["dist"], "i4").reshape(2, -1)
        low, high = np.where(low < _NEVER, low, 0), np.where(high < _NEVER, high, 0)
        mask = np.where(low == 0, -high, np.where(high > 0, top[of] - high + 2 * low, 2 * low))
        out = {"z": row["z"], "flags": np.frombuffer(row["flags"], "u1"), "root": root, "label": label[of], "d_high": high, "d_low": low, "flat_mask": mask}
        return {"tr": row["tr"], "tc": row["tc"]} | {n: a if isinstance(a, bytes) else a.astype(_SHOWN[n][0].dtype).tobytes() for n, a in out.items()}

    if many(meta, size):
        each = materialize(each_tile(tiles, tops, tops_of).select("tr", "tc", F.explode("tops").alias("t")).select("tr", "tc", "t.root", "t.top"))
        flat = each.groupBy("root").agg(F.max("top").alias("top"))
        whole = flat.join(_ranked(each.select("root").distinct(), "root"), "root")
        told = each.select("tr", "tc", "root").join(whole, "root").groupBy("tr", "tc").agg(F.collect_list(F.struct("root", "top", F.col("place").cast("int").alias("label"))).alias("ranked"))
        tiles = tiles.join(told, ["tr", "tc"], "left")
    schema = "tr int, tc int, " + ", ".join(f"{n} binary" for n in _SHOWN)
    done = from_tiles(each_tile(tiles, finish, schema), meta, _SHOWN, size)
    bit = lambda b: F.col("flags").bitwiseAND(F.lit(b)) > 0
    return done.select(
        "r", "c", F.when(~F.isnan("z"), F.col("z")).alias("z"), bit(CANDIDATE).alias("candidate"), bit(LOW).alias("low"), bit(HIGH).alias("high"), F.when(F.col("root") < _FAR, F.col("root")).alias("root"),
        F.when(F.col("root") < _FAR, F.col("label")).alias("label"), *[F.nullif(n, F.lit(0)).alias(n) for n in ("d_high", "d_low")], "flat_mask",
    )


def _claimed(table: pa.Table) -> pa.Table:
    """r, c, owner of one component: low edges in row-major order each take, from where they stand, what is not taken yet and lies within the tolerance of their own elevation."""
    r, c, key, z, low = (table.column(n).to_numpy() for n in ("r", "c", "key", "z", "low"))
    equal = table.column("equal")[0].as_py()
    order = np.argsort(key)
    spot = dict(zip(zip(r.tolist(), c.tolist()), range(len(r))))
    owner = np.full(len(key), _FAR, np.int64)
    for seed in order[low[order]].tolist():
        if owner[seed] != _FAR:
            continue
        owner[seed], todo = key[seed], [seed]
        while todo:
            at = todo.pop()
            for dr, dc in DIRECTIONS:
                n = spot.get((int(r[at]) + dr, int(c[at]) + dc))
                if n is not None and owner[n] == _FAR and abs(z[n] - z[seed]) <= equal:
                    owner[n] = key[seed]
                    todo.append(n)
    return pa.table({"r": r, "c": c, "owner": owner})


def _tolerant_tiles(cells: DataFrame, meta: GridMeta, edges_drain: bool, size: int, tolerance: tuple[float, float]) -> DataFrame:
    """Tiles as of ``_flat_tiles`` with zone, in which a flat is what a low edge claims.

    A claim may rule out a later one, so flats depend on the order of low edges - but only among cells that chains of steps of twice the tolerance join,
    and those components are found by contraction, as flats are. One that is level within the tolerance is a single flat, whatever its size; of
    the uneven ones each is claimed in a task of its own, which holds its cells.
    """
    shown = {"z": (_Z, "double"), "flags": (Field("i2", 0), "short"), "root": (_FLAT["root"], "bigint")}
    widen = lambda row: row | {"flags": np.frombuffer(row["flags"], "u1").astype("i2").tobytes()}
    joined = each_tile(_flat_tiles(cells, meta, edges_drain, size, tolerance).select("tr", "tc", *shown), widen, "tr int, tc int, z binary, flags binary, root binary")
    every = materialize(from_tiles(joined, meta, shown, size))
    key, low = F.col("r").cast("long") * meta.width + F.col("c"), F.col("flags").bitwiseAND(F.lit(LOW)) > 0
    drained = every.filter(F.col("root") < _FAR)
    uneven = drained.groupBy("root").agg((F.max("z") - F.min("z")).alias("range")).filter(F.col("range") > tolerance[0]).select("root")
    parted = drained.join(uneven, "root").select("root", "r", "c", key.alias("key"), "z", low.alias("low"), F.lit(float(tolerance[0])).alias("equal"))
    claimed = parted.groupBy("root").applyInArrow(_claimed, "r int, c int, owner long").filter(F.col("owner") < _FAR)
    owners = drained.join(uneven, "root", "left_anti").select("r", "c", F.col("root").alias("owner")).unionByName(claimed)
    flags = F.col("flags").bitwiseAND(F.lit(~OPEN & 255))
    has = lambda b: F.col("flags").bitwiseAND(F.lit(b)) > 0
    owned = F.col("owner").isNotNull()
    never = F.lit(_NEVER)
    rows = every.join(owners, ["r", "c"], "left").select(
        "r", "c", "z", F.when(owned & has(CANDIDATE), flags.bitwiseOR(F.lit(OPEN))).otherwise(flags).cast("short").alias("flags"), F.coalesce("owner", F.lit(_FAR)).alias("root"), F.col("owner").cast("double").alias("zone"),
        F.array(F.when(has(LOW), 1).otherwise(never), F.when(owned & has(HIGH) & ~has(LOW), 1).otherwise(never)).alias("dist"),
    )
    return to_tiles(rows, meta, _FLAT | {"zone": _Z}, size)


def flats(cells: DataFrame, meta: GridMeta, edges_drain: bool = True, size: int = SIZE) -> DataFrame:
    """r, c, z, candidate, low, high, root, label: root is the flat's first low edge (row-major id), label its rank; NULL off drainable flats.

    A flat is what equal elevation joins to a low edge, eight-connected.
    """
    return _flat_cells_of(materialize(_flat_tiles(cells, meta, edges_drain, size)), meta, size).drop("d_high", "d_low", "flat_mask")


def resolve_flats(cells: DataFrame, meta: GridMeta, epsilon: float = EPSILON, edges_drain: bool = True, size: int = SIZE, equal_tol: float = 0.0, lower_tol: float = 0.0) -> DataFrame:
    """Flats with an imposed gradient: r, c, z, label, flat_mask, resolved, and the flags and distances of each cell.

    flat_mask rises away from higher terrain, and twice as strongly towards lower; 0 where neither reaches. With ``equal_tol`` a low edge
    claims, in row-major order, what lies within that much of its own elevation; a neighbour is lower only by more than ``lower_tol``.
    """
    if equal_tol < 0 or lower_tol < 0:
        raise ValueError("tolerances must not be negative")
    if equal_tol or lower_tol:
        start, fields = _tolerant_tiles(cells, meta, edges_drain, size, (equal_tol, lower_tol)), _FLAT | {"zone": _Z}
    else:
        start, fields = _flat_tiles(cells, meta, edges_drain, size), _FLAT
    done = _flat_cells_of(relax(start, meta, fields, "dist", _spread, size), meta, size)
    lift = F.col("label").isNotNull() & (F.col("flat_mask") > 0)
    return done.withColumn("resolved", F.when(lift, F.col("z") + epsilon * F.col("flat_mask")).otherwise(F.col("z")))


def flat_stats(resolved: DataFrame) -> DataFrame:
    """One row of counts. Where no cell drains a flat, all high edges count, none as removed, and note_undrainable_flats is 1 if there are any."""
    inside, dominated = F.col("label").isNotNull(), F.col("low")
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    counts = resolved.agg(
        F.coalesce(F.max("label"), F.lit(0)).cast("long").alias("n_flats"), n(inside).alias("n_flat_cells"), n(F.col("low")).alias("n_low_edges"), n(F.col("high")).alias("every"),
        n(F.col("high") & inside & ~dominated).alias("n_high_edges"), n(F.col("high") & ~inside).alias("removed_highedges_unlabeled"),
        n(F.col("high") & inside & dominated).alias("removed_highedges_low_dominates"),
    )
    none = F.col("n_low_edges") == 0
    return counts.select(
        "n_flats", "n_flat_cells", "n_low_edges", F.when(none, F.col("every")).otherwise(F.col("n_high_edges")).alias("n_high_edges"),
        F.when(none, 0).otherwise(F.col("removed_highedges_unlabeled")).cast("long").alias("removed_highedges_unlabeled"), "removed_highedges_low_dominates",
        (none & (F.col("every") > 0)).cast("int").alias("note_undrainable_flats"),
    )
