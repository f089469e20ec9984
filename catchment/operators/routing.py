"""Flow direction (single and multiple), flow graphs, and accumulation."""

from __future__ import annotations

import math
import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..borders import Arrays, Block, contract, ends_of, joined_rims, pack, rim_cells
from ..checkpoints import materialize
from ..functions.geo import row_steps
from ..grid import DIRECTIONS, NO_DATA, NO_FLOW, GridMeta, neighbours
from ..tiles import SIZE, Field, each_tile, from_tiles, many, relax, shape, to_tiles

METHODS = ("d8", "mfd_quinn_1991")
UNITS = {"cells": 1.0, "m2": 1.0, "km2": 1e-6}


def _lengths(dx, dy):
    diag = F.sqrt(dx * dx + dy * dy)
    return [diag if dr and dc else (dx if dc else dy) for dr, dc in DIRECTIONS]


def d8(cells: DataFrame, meta: GridMeta, steps: tuple[float, float] | None = None) -> DataFrame:
    """r, c, dir: the steepest of the downward neighbours, the first in code order of equals; steps default to CRS units."""
    dx, dy, _ = meta.steps()
    if steps:
        dx, dy = steps
    diag = math.hypot(dx, dy)
    length = [diag if dr and dc else (dx if dc else dy) for dr, dc in DIRECTIONS]
    drop = [F.when(F.col(f"n{k}") < F.col("z"), (F.col("z") - F.col(f"n{k}")) / F.lit(length[k])) for k in range(8)]
    drops = neighbours(cells.select("r", "c", "z")).select("r", "c", "z", F.array(*drop).alias("drops"))
    code = F.coalesce(F.nullif(F.array_position("drops", F.array_max("drops")), F.lit(0)) - 1, F.lit(NO_FLOW))
    return drops.select("r", "c", F.when(F.col("z").isNull(), NO_DATA).otherwise(code).cast("short").alias("dir"))


def mfd(cells: DataFrame, meta: GridMeta, metric: bool = True, min_slope: float = 0.0, steps: tuple[float, float] | None = None) -> DataFrame:
    """r, c, w: eight weights in proportion to contour length times gradient, summing to 1; zeros without outflow."""
    if min_slope < 0:
        raise ValueError("min_slope must not be negative")
    dx, dy = (F.lit(steps[0]), F.lit(steps[1])) if steps else row_steps(meta, metric)
    length = _lengths(dx, dy)
    contour = [math.sqrt(2) / 4 if dr and dc else 0.5 for dr, dc in DIRECTIONS]
    tan = [(F.col("z") - F.col(f"n{k}")) / length[k] for k in range(8)]
    raw = [F.coalesce(F.when(tan[k] > F.lit(min_slope), contour[k] * tan[k]), F.lit(0.0)) for k in range(8)]
    # the array is made once and then summed and scaled: written out, each weight would repeat all eight
    weighed = neighbours(cells.select("r", "c", "z")).select("r", "c", F.array(*raw).alias("raw")).withColumn("t", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x))
    return weighed.select("r", "c", F.transform("raw", lambda x: F.when(F.col("t") > 0, x / F.col("t")).otherwise(0.0).cast("float")).alias("w"))


def _targets(edges: DataFrame) -> DataFrame:
    step = lambda i: F.element_at(F.array(*[F.lit(d[i]) for d in DIRECTIONS]), F.col("k") + 1)
    return edges.withColumn("nr", F.col("r") + step(0)).withColumn("nc", F.col("c") + step(1))


def flow_edges(routes: DataFrame, valid: DataFrame) -> DataFrame:
    """r, c, k, nr, nc, w: flow to valid cells within the grid; ``routes`` has dir or w."""
    if "dir" in routes.columns:
        edges = routes.filter("dir >= 0").select("r", "c", F.col("dir").cast("int").alias("k"), F.lit(1.0).alias("w"))
    else:
        edges = routes.select("r", "c", F.posexplode("w").alias("k", "w")).select("r", "c", "k", F.greatest(F.nanvl(F.col("w").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w")).filter("w > 0")
    return _targets(edges).join(valid.select(F.col("r").alias("nr"), F.col("c").alias("nc")), ["nr", "nc"]).select("r", "c", "k", "nr", "nc", "w")


def indegree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("nr").alias("r"), F.col("nc").alias("c")).agg(F.count("*").alias("indeg"))


def sources(valid: DataFrame, edges: DataFrame) -> DataFrame:
    """Valid cells that nothing flows into."""
    return valid.select("r", "c").join(edges.select(F.col("nr").alias("r"), F.col("nc").alias("c")), ["r", "c"], "left_anti")


class FlowCycleError(RuntimeError):
    """Flow directions form a cycle."""


def _padded_flow(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(valid, own mass, outflow shares by direction, index step of each direction) of padded tiles, flat."""
    valid = ~np.isnan(p["mass"])
    width = valid.shape[-1]
    share = np.stack([(p["dir"] == k) for k in range(8)]).astype(float) if "dir" in p else p["w"].astype(float)
    own = p["mass"] + p["inflow"] if "inflow" in p else p["mass"]
    return valid.ravel(), own.ravel(), (share * valid).reshape(8, -1), [dr * width + dc for dr, dc in DIRECTIONS]


def _inside(padded: tuple[int, ...]) -> np.ndarray:
    """Whether cells of padded tiles are the tiles' own, flat."""
    own = np.zeros(padded, bool)
    own[..., 1:-1, 1:-1] = True
    return own.ravel()


def _gather(p: dict[str, np.ndarray]) -> np.ndarray:
    """Totals of the cells whose inflow is complete, NaN elsewhere: cells are taken once each, in topological order."""
    valid, own, share, step = _padded_flow(p)
    total = p["total"].copy().ravel()
    inside = _inside(p["mass"].shape) & valid
    open_ = inside & np.isnan(total)
    waits = p["open"].ravel().astype(np.int16) if "open" in p else np.zeros(len(total), np.int16)
    cells = np.flatnonzero(open_)
    for k in range(8):
        source = cells - step[k]
        waits[cells] += (share[k, source] > 0) & np.isnan(total[source])
    ready = cells[waits[cells] == 0]
    while len(ready):
        value = own[ready].copy()
        for k in range(8):
            source = ready - step[k]
            flow = share[k, source]
            value += np.where(flow > 0, flow * np.where(flow > 0, total[source], 0.0), 0.0)
        total[ready] = value
        after = []
        for k in range(8):
            to = ready[share[k, ready] > 0] + step[k]
            to = to[inside[to]]
            np.subtract.at(waits, to, 1)
            after.append(to)
        after = np.unique(np.concatenate(after))
        ready = after[(waits[after] == 0) & np.isnan(total[after])]
    return total.reshape(p["total"].shape)[..., 1:-1, 1:-1]


def _leftover(p: dict[str, np.ndarray]) -> np.ndarray:
    """``_gather``'s totals; a cell on or behind a cycle gets its own mass and the inflow that is complete."""
    valid, own, share, step = _padded_flow(p)
    total = p["total"].ravel()
    cells = np.flatnonzero(_inside(p["mass"].shape) & valid & np.isnan(total))
    out = total.copy()
    out[cells] = own[cells]
    for k in range(8):
        source = cells - step[k]
        out[cells] += np.where(share[k, source] > 0, share[k, source] * np.nan_to_num(total[source]), 0.0)
    return out.reshape(p["total"].shape)[..., 1:-1, 1:-1]


def _open_cells(row: dict) -> dict:
    return {"n": int((np.isnan(np.frombuffer(row["total"])) & ~np.isnan(np.frombuffer(row["mass"]))).sum())}


_FLOW = {"mass": Field("f8", np.nan), "dir": Field("i2", NO_DATA)}
_LOST = -1


def _paths(block: Block, mass: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next, exit) of a tile's cells: where a cell flows within the tile (itself where its path ends), and the key of a cell of another tile that it flows to, or -1."""
    h, w = mass.shape
    valid, k = ~np.isnan(mass).ravel(), code.ravel()
    moves = valid & (k >= 0) & (k < 8)
    step = np.array(DIRECTIONS)[np.where(moves, k, 0)]
    at = np.arange(h * w)
    r, c = at // w + step[:, 0], at % w + step[:, 1]
    inside = moves & (r >= 0) & (r < h) & (c >= 0) & (c < w)
    to = np.where(inside, r * w + c, at)
    r, c = r + block.r0, c + block.c0
    leaves = moves & ~inside & (r >= 0) & (r < block.meta.height) & (c >= 0) & (c < block.meta.width)
    return np.where(valid[to], to, at), np.where(leaves, r * np.int64(block.meta.width) + c, _LOST)


def _chained(block: Block, members: dict) -> tuple[Arrays, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rims, entry, exit of it, leaves, after) of a group: the place that each exit flows to within the group and the exit that its flow then takes (-1 if none),
    whether an exit leaves the group, and the exit that follows each exit (itself at the end; the last number stands for lost flow)."""
    rims = joined_rims(members, "valid", "end", "to", "out")
    key, n = rims["key"], len(rims["key"])

    def place(of: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(key, of), n - 1)
        return np.where(key[at] == of, at, -1)

    to, width = rims["to"], block.meta.width
    goes = to >= 0
    within = goes & block.holds(to // width, to % width)
    entry = np.where(within, place(to), -1)
    entry = np.where((entry >= 0) & rims["valid"][entry], entry, -1)
    ends = np.where(rims["end"] >= 0, place(rims["end"]), -1)  # the exit of each rim cell as an entry
    leaves = goes & ~within
    after = np.append(np.where(leaves | ~goes, np.arange(n), np.where(entry >= 0, np.where(ends[entry] >= 0, ends[entry], n), n)), n)
    return rims, entry, ends, leaves, after


def _merged_flow(block: Block, members: dict) -> Arrays:
    """A group as one tile: where flow that enters its rim leaves it, and what its own mass sends out."""
    rims, _, ends, leaves, after = _chained(block, members)
    n = len(rims["key"])
    final = ends_of(after)[:n]
    led = np.where(ends >= 0, final[ends], -1)
    led = np.where((led >= 0) & (led < n) & leaves[np.clip(led, 0, n - 1)], led, -1)
    out = np.zeros(n)
    sends = np.flatnonzero((rims["to"] >= 0) & (final >= 0) & (final < n))
    np.add.at(out, final[sends], rims["out"][sends])
    rim = block.outer(rims["key"])
    end = np.where(led >= 0, rims["key"][led], _LOST)
    return {"key": rims["key"][rim], "valid": rims["valid"][rim], "end": end[rim], "to": np.where(leaves, rims["to"], _LOST)[rim], "out": np.where(leaves, out, 0.0)[rim]}


def _entering(block: Block, members: dict, answer: Arrays | None) -> dict:
    """What flows into each member's rim cells; ``open`` where some of it never comes to an end (a cycle)."""
    rims, entry, ends, leaves, after = _chained(block, members)
    n = len(rims["key"])
    inflow, open_ = np.zeros(n), np.zeros(n, bool)
    if answer:
        at = np.searchsorted(rims["key"], answer["key"])
        inflow[at], open_[at] = answer["inflow"], answer["open"]
    flow, waits = np.append(rims["out"], 0.0), np.zeros(n + 1, np.int64)
    np.add.at(flow, ends[ends >= 0], inflow[ends >= 0])
    np.add.at(waits, ends[open_ & (ends >= 0)], 1)
    on = np.flatnonzero((rims["to"] >= 0) & (after[:n] != np.arange(n)))
    np.add.at(waits, after[on], 1)
    ready = np.flatnonzero((rims["to"] >= 0) & (waits[:n] == 0))
    done = np.zeros(n, bool)
    while len(ready):
        done[ready] = True
        moving = ready[(after[ready] != ready) & (after[ready] < n)]
        np.add.at(flow, after[moving], flow[moving])
        np.subtract.at(waits, after[moving], 1)
        following = np.unique(after[moving])
        ready = following[(waits[following] == 0) & ~done[following]]
    into = np.flatnonzero(entry >= 0)
    np.add.at(inflow, entry[into[done[into]]], flow[into[done[into]]])
    open_[entry[into[~done[into]]]] = True
    some = (inflow != 0) | open_
    of = {k: np.flatnonzero(some & (rims["member"] == m)) for m, k in enumerate(members)}
    return {k: {"key": rims["key"][i], "inflow": inflow[i], "open": open_[i]} for k, i in of.items()}


def _accumulate_single(tiles: DataFrame, meta: GridMeta, size: int, cycle_check: bool) -> DataFrame:
    """Tiles with mass, total and left (cells whose inflow is not complete) of single flow.

    A tile maps each rim cell to the cell by which what enters there leaves it. The maps of a group compose by doubling
    along the exits of its members, so a path of any length takes two passes over the raster, and a circle shows as a path without an end.
    """

    def block_of(row: dict) -> tuple[Block, np.ndarray, np.ndarray]:
        h, w = shape(meta, row["tr"], row["tc"], size)
        return Block.at(meta, row["tr"], row["tc"], size, size), _FLOW["mass"].read(row["mass"], h, w), _FLOW["dir"].read(row["dir"], h, w)

    def summary(row: dict) -> dict:
        block, mass, code = block_of(row)
        to, leaves = _paths(block, mass, code)
        end, flat = ends_of(to), mass.ravel()
        counted = np.flatnonzero(~np.isnan(flat) & (end >= 0))
        out = np.bincount(end[counted], flat[counted], mass.size)
        at, key = rim_cells(meta, block)
        led = end[at]
        w = block.c1 - block.c0
        name = (block.r0 + led // w) * np.int64(meta.width) + block.c0 + led % w
        exits = leaves[at] >= 0
        known = (led >= 0) & (leaves[led] >= 0) & ~np.isnan(flat[at])
        return {"tr": row["tr"], "tc": row["tc"], "blob": pack({"key": key, "valid": ~np.isnan(flat[at]), "end": np.where(known, name, _LOST), "to": leaves[at], "out": np.where(exits, out[at], 0.0)})}

    def gather(row: dict) -> dict:
        block, mass, code = block_of(row)
        p = {n: np.pad(a, 1, constant_values=f) for n, a, f in (("mass", mass, np.nan), ("dir", code, NO_DATA), ("total", np.full(mass.shape, np.nan), np.nan))}
        p |= {"inflow": np.zeros(p["mass"].shape), "open": np.zeros(p["mass"].shape, bool)}
        if row.get("blob"):
            told = pickle.loads(row["blob"])
            at = told["key"] // meta.width - block.r0 + 1, told["key"] % meta.width - block.c0 + 1
            p["inflow"][at], p["open"][at] = told["inflow"], told["open"]
        total = _gather(p)
        left = int((np.isnan(total) & ~np.isnan(mass)).sum())
        if left and not cycle_check:
            p["total"][1:-1, 1:-1] = total
            total = _leftover(p)
        return {"tr": row["tr"], "tc": row["tc"], "mass": mass.tobytes(), "total": total.tobytes(), "left": left}

    if many(meta, size):
        tiles = materialize(tiles)
        answers = contract(materialize(each_tile(tiles, summary, "tr int, tc int, blob binary")), meta, size, _merged_flow, _entering)
        tiles = tiles.join(answers, ["tr", "tc"], "left")
    return materialize(each_tile(tiles, gather, "tr int, tc int, mass binary, total binary, left long"))


def accumulate(cells: DataFrame, meta: GridMeta, out: str = "cells", size: int = SIZE, cycle_check: bool = True) -> DataFrame:
    """r, c, acc: own mass plus what flows in, 0 at NoData.

    ``cells`` has r, c, z (NULL: NoData), one of dir and w, and area_m2 for areas. Mass that leaves the
    grid or enters NoData is lost; a cell without mass passes on what it gets. A cell is done when all cells
    that flow into it are, so cells on or behind a cycle never are: that raises, or without ``cycle_check``
    they keep their own mass and the complete part of their inflow. Single flow is contracted along the borders of tiles; multiple flow,
    of which a border cell may reach every other, goes in rounds that keep borders alone.
    """
    if out not in UNITS:
        raise ValueError(f"out must be one of {', '.join(UNITS)}")
    if ("dir" in cells.columns) == ("w" in cells.columns):
        raise ValueError("exactly one of dir and w is needed")
    if out != "cells" and "area_m2" not in cells.columns:
        raise ValueError("areas need area_m2")
    valid, nan = F.col("z").isNotNull(), F.lit(float("nan"))
    mass = F.when(valid, F.lit(1.0) if out == "cells" else F.coalesce("area_m2", F.lit(0.0))).otherwise(nan)
    shown = {"mass": (_FLOW["mass"], "double"), "total": (Field("f8", np.nan), "double")}
    if "dir" in cells.columns:
        rows = cells.select("r", "c", mass.alias("mass"), F.when(valid, F.col("dir")).otherwise(F.lit(NO_DATA)).cast("short").alias("dir"))
        tiles = _accumulate_single(to_tiles(rows, meta, _FLOW, size), meta, size, cycle_check)
        if cycle_check and tiles.filter("left > 0").take(1):
            raise FlowCycleError("flow directions form a cycle")
        done = from_tiles(tiles, meta, shown, size)
    else:
        zero = F.lit(0.0).cast("float")
        weights = F.coalesce(F.when(valid, F.transform("w", lambda x: F.greatest(F.nanvl(F.coalesce(x, zero), zero), zero))), F.array_repeat(zero, 8))
        fields = {"mass": _FLOW["mass"], "w": Field("f4", 0.0, 8), "total": Field("f8", np.nan)}
        rows = cells.select("r", "c", mass.alias("mass"), weights.alias("w"), nan.alias("total"))
        tiles = relax(to_tiles(rows, meta, fields, size), meta, fields, "total", _gather, size)
        done = from_tiles(tiles, meta, shown, size)
        open_ = each_tile(tiles.select("mass", "total"), _open_cells, "n long")
        if open_.agg(F.max("n")).first()[0]:
            if cycle_check:
                raise FlowCycleError("flow directions form a cycle")
            done = from_tiles(relax(tiles, meta, fields, "total", _leftover, size, once=True), meta, shown, size)
    return done.select("r", "c", F.when(F.isnan("mass"), 0.0).otherwise(F.col("total") * UNITS[out]).alias("acc"))


def route(cells: DataFrame, meta: GridMeta, method: str, steps: tuple[float, float] | None = None) -> DataFrame:
    """Flow directions by method name."""
    if method == "d8":
        return d8(cells, meta, steps)
    if method == "mfd_quinn_1991":
        return mfd(cells, meta, steps=steps)
    raise ValueError(f"flow method must be one of {', '.join(METHODS)}")
