"""Graphs on the borders of tiles, contracted group by group up to one, and solved back down.

A tile is summed up by its rim (the cells on its edge) and by what its inside does between rim cells. Groups of
GROUP x GROUP tiles join their members' summaries along shared borders and keep only what concerns the rim of the
group; groups of groups follow until one group holds the raster. Then answers go down the same way, each group
telling its members what holds on their rims. The raster itself is read once for the summaries and once
for the answers, whatever distance water or labels travel; the levels between grow with the logarithm of the
raster's edge, and their data with the rims.

Summaries and answers are dicts of numpy arrays; a rim is ``key`` (the cell's row-major number in the raster, ascending) and columns.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import materialize
from .grid import DIRECTIONS, GridMeta

#: Tiles, or groups of the level below, along each edge of a group.
GROUP = 8
Arrays = dict[str, np.ndarray]
_BLOB = "tr int, tc int, blob binary"


@dataclass(frozen=True)
class Block:
    """A tile or a group of tiles: the cells [r0, r1) x [c0, c1) of a raster, made of members of ``edge`` cells."""

    meta: GridMeta
    r0: int
    r1: int
    c0: int
    c1: int
    edge: int

    @classmethod
    def at(cls, meta: GridMeta, row: int, col: int, edge: int, member: int) -> Block:
        return cls(meta, row * edge, min(meta.height, (row + 1) * edge), col * edge, min(meta.width, (col + 1) * edge), member)

    def outer(self, key: np.ndarray) -> np.ndarray:
        """Whether cells lie on the block's rim."""
        r, c = key // self.meta.width, key % self.meta.width
        return (r == self.r0) | (r == self.r1 - 1) | (c == self.c0) | (c == self.c1 - 1)

    def holds(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (r >= self.r0) & (r < self.r1) & (c >= self.c0) & (c < self.c1)

    def meetings(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, alone): pairs of rim cells of different members that touch, each in both orders, and cells that touch one in the block that no member has."""
        w = self.meta.width
        r, c = key // w, key % w
        found_i, found_j, alone = [], [], []
        for dr, dc in DIRECTIONS:
            nr, nc = r + dr, c + dc
            i = np.flatnonzero(self.holds(nr, nc) & ((nr // self.edge != r // self.edge) | (nc // self.edge != c // self.edge)))
            to = nr[i] * w + nc[i]
            j = np.minimum(np.searchsorted(key, to), len(key) - 1)
            met = key[j] == to
            found_i.append(i[met])
            found_j.append(j[met])
            alone.append(i[~met])
        return np.concatenate(found_i), np.concatenate(found_j), np.unique(np.concatenate(alone))


def rim_cells(meta: GridMeta, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(place in the tile, key) of a tile's rim, ascending."""
    h, w = block.r1 - block.r0, block.c1 - block.c0
    on = np.zeros((h, w), bool)
    on[0] = on[-1] = True
    on[:, 0] = on[:, -1] = True
    at = np.flatnonzero(on)
    return at, (block.r0 + at // w) * np.int64(meta.width) + block.c0 + at % w


def joined_rims(members: dict, *names: str) -> Arrays:
    """The members' rims as one, by key, with ``member`` (its number in the dict's order)."""
    out = {n: np.concatenate([m[n] for m in members.values()]) for n in ("key", *names)}
    out["member"] = np.repeat(np.arange(len(members)), [len(m["key"]) for m in members.values()])
    order = np.argsort(out["key"], kind="stable")
    return {n: a[order] for n, a in out.items()}


def pack(arrays: Arrays) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def contract(summaries: DataFrame, meta: GridMeta, size: int, merge: Callable[[Block, dict], Arrays], solve: Callable[[Block, dict, Arrays | None], dict]) -> DataFrame:
    """tr, tc, blob: the answer for each tile of ``summaries`` (tr, tc, blob, already materialized).

    ``merge(block, members)`` sums up a group; ``solve(block, members, answer)`` gives each member's answer, with the group's
    own answer (None at the top). Members are keyed by (tr, tc) of their level.
    """

    def read(table: pa.Table) -> dict:
        rows = sorted(zip(*(table.column(n).to_pylist() for n in ("tr", "tc", "blob"))), key=lambda r: r[:2])
        return {(r, c): pickle.loads(b) for r, c, b in rows}

    def out(rows: dict) -> pa.Table:
        return pa.table({"tr": pa.array([k[0] for k in rows], pa.int32()), "tc": pa.array([k[1] for k in rows], pa.int32()), "blob": pa.array([pack(b) for b in rows.values()], pa.binary())})

    def grouped(df: DataFrame) -> DataFrame:
        return df.select("*", (F.col("tr") / GROUP).cast("int").alias("gr"), (F.col("tc") / GROUP).cast("int").alias("gc")).groupBy("gr", "gc")

    def place(table: pa.Table) -> tuple[int, int]:
        return table.column("tr")[0].as_py() // GROUP, table.column("tc")[0].as_py() // GROUP

    def upward(edge: int) -> Callable[[pa.Table], pa.Table]:
        def up(table: pa.Table) -> pa.Table:
            at = place(table)
            return out({at: merge(Block.at(meta, *at, edge * GROUP, edge), read(table))})

        return up

    def downward(edge: int) -> tuple[Callable, Callable]:
        def told(table: pa.Table, answer: Arrays | None) -> pa.Table:
            return out(solve(Block.at(meta, *place(table), edge * GROUP, edge), read(table), answer))

        def top(table: pa.Table) -> pa.Table:
            return told(table, None)

        def below_top(table: pa.Table, answer: pa.Table) -> pa.Table:
            return told(table, pickle.loads(answer.column("blob")[0].as_py()))

        return top, below_top

    levels, edge = [(summaries, size)], size
    while -(-meta.height // (edge * GROUP)) * -(-meta.width // (edge * GROUP)) > 1:
        levels.append((materialize(grouped(levels[-1][0]).applyInArrow(upward(edge), _BLOB)), edge * GROUP))
        edge *= GROUP
    answers = None
    for below, edge in reversed(levels):
        top, below_top = downward(edge)
        if answers is None:
            answers = grouped(below).applyInArrow(top, _BLOB)
        else:
            answers = grouped(below).cogroup(answers.withColumnsRenamed({"tr": "gr", "tc": "gc"}).groupBy("gr", "gc")).applyInArrow(below_top, _BLOB)
    return answers


# --- kernels on graphs -------------------------------------------------------------------------------------------


def numbered(*ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All ids ascending, and each array as places in them."""
    every = np.unique(np.concatenate(ids))
    return every, [np.searchsorted(every, x) for x in ids]


def lightest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lightest edge of each pair of different nodes, by weight."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((w, hi, lo))
    lo, hi, w = lo[order], hi[order], w[order]
    first = np.ones(len(lo), bool)
    first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    first &= lo != hi
    lo, hi, w = lo[first], hi[first], w[first]
    order = np.argsort(w, kind="stable")
    return lo[order], hi[order], w[order]


class Forest:
    """Merges of a minimum spanning forest over nodes 0..n-1, by Kruskal's order."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        self.n = n
        a, b, w = lightest(a, b, w)
        up, tree = list(range(n)), list(range(n))  # union-find, and the merge that each root stands for
        self.left, self.right, self.weight = [], [], []
        self.ends: list[tuple[int, int]] = []
        for i, j, x in zip(a.tolist(), b.tolist(), w.tolist()):
            while up[i] != i:
                up[i] = i = up[up[i]]
            while up[j] != j:
                up[j] = j = up[up[j]]
            if i == j:
                continue
            self.left.append(tree[i])
            self.right.append(tree[j])
            self.weight.append(x)
            self.ends.append((i, j))
            up[j] = i
            tree[i] = n + len(self.weight) - 1

    def levels(self, source: int) -> np.ndarray:
        """The least over paths from the source of the greatest weight on the path; infinite where there is none, lowest at the source."""
        m = len(self.weight)
        above = [-1] * (self.n + m)
        for k in range(m):
            above[self.left[k]] = above[self.right[k]] = self.n + k
        value = [np.inf] * (self.n + m)
        on_path = [False] * (self.n + m)
        x = source
        while x >= 0:
            on_path[x] = True
            x = above[x]
        for k in range(m - 1, -1, -1):
            me = self.n + k
            for child in (self.left[k], self.right[k]):
                if not on_path[child]:
                    value[child] = self.weight[k] if on_path[me] else value[me]
        value[source] = -np.inf
        return np.array(value[: self.n])

    def contracted(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, w): a forest over the nodes to keep with the same least greatest weights between them."""
        held = np.where(keep, np.arange(self.n), -1).tolist() + [-1] * len(self.weight)
        out = []
        for k, (i, j, x) in enumerate(zip(self.left, self.right, self.weight)):
            a, b = held[i], held[j]
            if a >= 0 and b >= 0:
                out.append((a, b, x))
            held[self.n + k] = a if a >= 0 else b
        a, b, w = zip(*out) if out else ((), (), ())
        return np.array(a, np.int64), np.array(b, np.int64), np.array(w, float)


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, by hooking and pointer jumping."""
    f = np.arange(n)
    while len(a):
        fa, fb = f[a], f[b]
        np.minimum.at(f, np.maximum(fa, fb), np.minimum(fa, fb))
        jump = f[f]
        while not np.array_equal(jump, f):
            f, jump = jump, jump[jump]
        open_ = f[a] != f[b]
        a, b = a[open_], b[open_]
    return f


def ends_of(next_: np.ndarray) -> np.ndarray:
    """Where each node's path ends when ``next_`` is followed to a node that points at itself; -1 for paths that run in a circle."""
    f, steps = next_.copy(), 1
    while steps < len(f):
        f = f[f]
        steps *= 2
    return np.where(next_[f] == f, f, -1) if len(f) else f
