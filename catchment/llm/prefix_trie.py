"""The trie of conversation prefixes by Patricia construction over sorted sequences.

A turn (role, text) is a key of 128 hash bits, a conversation the array of its keys; conversations of equal
arrays become one with the number and the least of their ids. Ranges of the sorted arrays form partitions. In
each, neighbours' common prefixes tell where points lie: ends, leaves and branches, with all turns
between two points as one compressed edge. A stack holds the points on the current path; what leaves it is
summed (members, least member, leaves, tokens saved), and its edge is expanded to nodes by suffix sums.

Points on the path of a partition's first sequence, and those still open at its end, may go on in other partitions. Their
sums - some rows for each partition, however many conversations it holds - pass in order through the same stack
once more; edges that hang from them get their parent's id by a join.

Rows without a conv_id belong to no conversation. Null roles and texts are empty; turns are ordered by
turn (null first), then role, then text, so repeated rows are turns of their own. The remainder of a negative id has its sign, as in SQL. An empty table has
no nodes. A conversation's keys (about 20 bytes a turn), but not its texts, must fit a task; the ids that end at one node
are hashed in order, so they pass one task as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, scan_bytes

#: Bytes of the table for each partition of sorted sequences.
PART_BYTES = 8 << 20
#: Turns that a conversation may take from another, in groups of so many ids.
BORROWED, GROUP = 4, 20
NOBODY = hashlib.sha256(b"").hexdigest()
WORDS = r"[^\x20\x09-\x0D]+"
NODE, FIRST, ATTACH, OPEN, LAST, FOUND = range(6)
_SCHEMA = "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, place int, tokens array<int>, path array<bigint>"
_ARROW = pa.schema(
    [("kind", pa.int32())] + [(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("part", pa.int32()), ("place", pa.int32()), ("tokens", pa.list_(pa.int32())), ("path", pa.list_(pa.int64()))]
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (two longs a turn), tokens (words a turn): the first turns of the group's first conversation, then one's own after as many."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    key = [F.xxhash64(F.lit(k), "role", "text").alias(f"k{k}") for k in (1, 2)]
    own = cut(rows.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", *key, F.regexp_count("text", F.lit(WORDS)).alias("words")))
    borrowed = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).cast("int")
    ids = own.filter("pos = 1").select("conv_id", borrowed.alias("h"))
    lent = own.filter(F.col("pos") < BORROWED).withColumnRenamed("conv_id", "lender")
    taken = ids.filter("h > 0").withColumn("lender", F.col("conv_id") - F.col("conv_id") % GROUP).join(lent, "lender").filter("pos <= h")
    columns = ["conv_id", "pos", "k1", "k2", "words"]
    turns = taken.select(columns).unionByName(own.filter(F.col("pos") > borrowed).select(columns))
    every = turns.unionByName(ids.select("conv_id"), allowMissingColumns=True)  # one without turns is a conversation too
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "k1", "k2", "words"))
    # borrowed positions are 1..h and own ones begin after h, so positions alone give the order
    gathered = every.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select("conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["k1"], t["k2"]))).alias("path"), F.transform("turns", lambda t: t["words"]).alias("tokens"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (s1, s2, conv_id): each sequence's number of ids, the least, and the hash of all in order."""
    key, n, least, state = None, 0, 0, None
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        got = pa.RecordBatch.from_pydict({"conv_id": pa.array([x[0] for x in out], pa.int64()), "n": pa.array([x[1] for x in out], pa.int64()), "sha": pa.array([x[2] for x in out], pa.string())})
        out.clear()
        return got

    for b in batches:
        for s1, s2, conv in zip(*(b.column(i).to_pylist() for i in range(3))):
            if (s1, s2) == key:
                n += 1
                state.update(b",%d" % conv)
                continue
            if state:
                out.append((least, n, state.hexdigest()))
            key, n, least, state = (s1, s2), 1, conv, hashlib.sha256(b"%d" % conv)
        yield batch()
    if state:
        out.append((least, n, state.hexdigest()))
        yield batch()


class Point:
    """An end, leaf or branch on the current path, with the tokens of the edge above it and what is summed so far."""

    __slots__ = ("depth", "tokens", "n", "least", "children", "leaves", "saved", "ends", "edges", "refs")

    def __init__(self, depth: int, tokens: np.ndarray | None = None, n: int = 0, least: int | None = None, ends: str | None = None):
        self.depth, self.tokens, self.n, self.least, self.ends = depth, tokens, n, least, ends
        self.children = self.leaves = self.saved = 0
        self.edges: list[tuple] = []
        self.refs: list[tuple[int, int]] = []

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n += n
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)
        self.children += children
        self.leaves += leaves
        self.saved += saved


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Turns that two paths share at their start."""
    m = min(len(a), len(b))
    differ = a[:m] != b[:m]
    return (int(differ.argmax()) if differ.any() else m) // 2


class Path:
    """The stack of open points above ``floor``; closed edges go to ``done`` when the point above them is settled."""

    def __init__(self, floor: Point):
        self.floor, self.stack = floor, []
        self.done: list[tuple] = []
        self.found: list[tuple] = []

    def close(self, p: Point, above: Point) -> None:
        """The edge from ``above`` to p is complete, and so are the edges below p."""
        if not p.children:
            p.leaves = 1
        saved = p.saved + (p.n - 1) * int(p.tokens.sum())
        above.add(p.n, p.least, 1, p.leaves, saved)
        above.edges.append((p.least, above.depth, p.depth, p.n, p.children, p.leaves, p.saved, p.ends or NOBODY, p.tokens))
        self.settle(p)

    def settle(self, p: Point) -> None:
        self.done += [(p.least, None, None, e) for e in p.edges]
        self.found += [(part, place, p.least) for part, place in p.refs]

    def rise(self, depth: int) -> None:
        """Closes what lies deeper than ``depth`` and leaves a point there, unless the floor lies deeper."""
        while self.stack and self.stack[-1].depth > depth:
            p = self.stack.pop()
            above = self.stack[-1] if self.stack else self.floor
            if above.depth < depth:
                branch = Point(depth, p.tokens[: depth - above.depth])
                p.tokens = p.tokens[depth - above.depth :]
                self.stack.append(branch)
                above = branch
            self.close(p, above)

    def top(self) -> Point:
        return self.stack[-1] if self.stack else self.floor


def _nodes(edges: list[tuple]) -> pa.RecordBatch:
    """All nodes of complete edges (parent's id or part and place of it, edge): the lowest is a point, the others have one child each."""
    parent, part, place, rows = zip(*edges)
    least, low, high, n, children, leaves, saved, ends, tokens = zip(*rows)
    low, high, n = (np.array(x, np.int64) for x in (low, high, n))
    size = high - low
    last = np.cumsum(size)
    flat = np.concatenate(tokens).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(flat)])
    rep = lambda x: np.repeat(np.array(x, np.int64), size)
    within = np.arange(last[-1]) - np.repeat(last - size, size)
    below = np.repeat(total[last], size) - total[np.arange(last[-1])]  # tokens from a node to its edge's lower end
    point = np.zeros(last[-1], bool)
    point[last - 1] = True
    top = last - size
    up = rep(least)
    up[top] = [0 if x is None else x for x in parent]
    unknown = np.zeros(last[-1], bool)
    unknown[top] = [x is None for x in parent]
    hashes = np.full(last[-1], NOBODY, object)
    hashes[last - 1] = ends
    refs = [np.zeros(last[-1], np.int32) for _ in range(2)]
    for a, values in zip(refs, (part, place)):
        a[top] = [x or 0 for x in values]
    columns = {
        "kind": np.full(last[-1], NODE, np.int32), "conv_id": rep(least), "depth": rep(low) + within + 1, "parent_conv_id": pa.array(up, mask=unknown), "n_convs": rep(n),
        "n_children": np.where(point, rep(children), 1), "n_leaves": rep(leaves), "saved_tokens": rep(saved) + (rep(n) - 1) * below, "ends_sha256": pa.array(hashes, pa.string()),
        "part": pa.array(refs[0], mask=~unknown), "place": pa.array(refs[1], mask=~unknown),
    }
    return _batch(columns, int(last[-1]))


def _batch(columns: dict, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _ARROW], schema=_ARROW)


def _flush(path: Path, least: int) -> Iterator[pa.RecordBatch]:
    if len(path.done) > least:
        yield _nodes(path.done)
        path.done = []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one partition of sorted sequences, and the rows of its border."""
    part = TaskContext.get().partitionId()
    path, before, border = None, None, []

    def attach(p: Point) -> None:
        border.append({"kind": ATTACH, "conv_id": p.least, "depth": p.depth, "n_convs": p.n, "n_children": p.children, "n_leaves": p.leaves, "saved_tokens": p.saved})
        path.done += [(None, part, len(border) - 1, e) for e in p.edges]

    for b in batches:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        keys, key_at = col["path"].flatten().to_numpy(), np.concatenate([[0], np.cumsum(col["path"].value_lengths().to_numpy())]).tolist()
        words, word_at = col["tokens"].flatten().to_numpy(), np.concatenate([[0], np.cumsum(col["tokens"].value_lengths().to_numpy())]).tolist()
        for i, (conv, n, sha) in enumerate(zip(*(col[x].to_pylist() for x in ("conv_id", "n", "sha")))):
            mine, tokens = keys[key_at[i] : key_at[i + 1]], words[word_at[i] : word_at[i + 1]]
            if path is None:  # all of the first sequence's path may belong to other partitions too
                path = Path(Point(len(tokens)))
                border.append({"kind": FIRST, "conv_id": conv, "depth": len(tokens), "n_convs": n, "ends_sha256": sha, "tokens": tokens, "path": mine})
            else:
                shared = common(before, mine)
                path.rise(shared)
                if not path.stack and path.floor.depth > shared:
                    if path.floor.children:
                        attach(path.floor)
                    path.floor = Point(shared)
                path.stack.append(Point(len(tokens), tokens[shared:], n, conv, sha))
            before = mine
        if path:
            yield from _flush(path, 10_000)
    if path is None:
        return
    attach(path.floor)
    for p in path.stack:
        border.append({"kind": OPEN, "conv_id": p.least, "depth": p.depth, "n_convs": p.n, "n_children": p.children, "n_leaves": p.leaves, "saved_tokens": p.saved, "ends_sha256": p.ends, "tokens": p.tokens})
        path.done += [(None, part, len(border) - 1, e) for e in p.edges]
    border.append({"kind": LAST, "path": before})
    yield from _flush(path, 0)
    columns = {f.name: [x.get(f.name) for x in border] for f in _ARROW} | {"part": [part] * len(border), "place": list(range(len(border)))}
    yield _batch(columns, len(border))


def _bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The border rows of all partitions, in order, through one stack: their nodes, and the id of each place that edges hang from."""
    path, before = Path(Point(0, np.empty(0, np.int32))), np.empty(0, np.int64)
    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == LAST:
                before = np.array(r["path"], np.int64)
                continue
            if r["kind"] == FIRST:
                shared = common(before, np.array(r["path"], np.int64))
                path.rise(shared)
                if r["depth"]:
                    path.stack.append(Point(r["depth"], np.array(r["tokens"][shared:], np.int32), r["n_convs"], r["conv_id"], r["ends_sha256"]))
                else:  # conversations without turns end at the root
                    path.floor.add(r["n_convs"], r["conv_id"], 0, 0, 0)
                    path.floor.ends = r["ends_sha256"]
                continue
            if r["kind"] == ATTACH:
                path.rise(r["depth"])
                path.top().add(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"])
            else:
                p = Point(r["depth"], np.array(r["tokens"], np.int32), r["n_convs"], r["conv_id"], r["ends_sha256"])
                p.add(0, None, r["n_children"], r["n_leaves"], r["saved_tokens"])
                path.stack.append(p)
            path.top().refs.append((r["part"], r["place"]))
        yield from _flush(path, 10_000)
        if path.found:
            yield _places(path)
    path.rise(0)
    root = path.floor
    if not root.n:
        return
    path.settle(root)
    yield from _flush(path, 0)
    if path.found:
        yield _places(path)
    yield _batch({"kind": [NODE], "conv_id": [root.least], "depth": [0], "n_convs": [root.n], "n_children": [root.children], "n_leaves": [root.leaves or 1], "saved_tokens": [root.saved], "ends_sha256": [root.ends or NOBODY]}, 1)


def _places(path: Path) -> pa.RecordBatch:
    part, place, conv = zip(*path.found)
    path.found = []
    return _batch({"kind": [FOUND] * len(part), "conv_id": conv, "part": part, "place": place}, len(part))


def prefix_trie(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``parts`` is the number of ranges of sorted sequences; by default it follows the size of the table.
    """
    parts = parts or max(4, scan_bytes(conversations) // PART_BYTES)
    built = cut(rebuilt(conversations))
    seq = built.select(F.xxhash64(F.lit(1), "path").alias("s1"), F.xxhash64(F.lit(2), "path").alias("s2"), "conv_id")
    ends = seq.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "conv_id").mapInArrow(_ends, "conv_id long, n long, sha string")
    distinct = ends.join(built, "conv_id").select("path", "tokens", "conv_id", "n", "sha")
    local = cut(distinct.repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(_scan, _SCHEMA))
    border = local.filter(F.col("kind").between(FIRST, LAST)).repartition(1).sortWithinPartitions("part", "place")
    bridge = cut(border.mapInArrow(_bridge, _SCHEMA))
    release(built)
    nodes = local.filter(F.col("kind") == NODE)
    known = nodes.filter("place is null").unionByName(bridge.filter(F.col("kind") == NODE))
    found = bridge.filter(F.col("kind") == FOUND).select("part", "place", F.col("conv_id").alias("above"))
    hung = nodes.filter("place is not null").join(found, ["part", "place"]).withColumn("parent_conv_id", F.col("above"))
    return known.select(RESULT).unionByName(hung.select(RESULT))
