"""Best-fit packing of documents into training sequences of several permitted lengths.

A text longer than the largest length is cut into pieces of that length and a rest. Pieces are packed in
descending size into the open bin that they fill best. Where none fits, every permitted length is tried: what
is still to come is put into it, largest first, and the length that after downsizing would waste the least
per token is opened. At the end each bin is downsized to the smallest permitted length that holds its
contents. The work is dealt into shards of about SHARD_TOKENS tokens by a hash of the row, so bins never
span tasks and only a shard's last few bins stay open; nothing is dropped. A text without words (null and
empty ones too) has a single piece of length 0 in no bin (bin_id null). Each row is packed on its own, so
repeated rows, and rows that share an id or have none, get places of their own. Bin ids are names only: they
depend on how Spark splits the table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Chunk, count_in, cut, map_texts

#: Permitted sequence lengths.
LENGTHS = (512, 1024, 2048, 4096)
SHARD_TOKENS = 2_000_000
SCHEMA = "doc_id long, piece int, n_tokens int, bin_id string, capacity int, offset int"


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens: words of each text."""

    def make():
        def kernel(cols):
            c = Chunk(cols["text"])
            solid = np.zeros(len(c.data) + 1, bool)
            solid[1:] = ~SPACE[c.data]
            return {"doc_id": cols["doc_id"], "n_tokens": count_in(c, solid[1:] & ~solid[:-1], c.start, c.end)}

        return kernel

    return map_texts(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long")


def best_fit(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, its offset, capacity of each bin) for sizes in descending order, none above the largest length.

    Open bins are kept by room left, as sorted keys; an item goes to the least room that holds it.
    """
    lengths = tuple(sorted(lengths))
    falling = [-s for s in sizes]
    rooms: list[tuple[int, int]] = []
    place, offset, fill, cap = [], [], [], []
    for i, s in enumerate(sizes):
        at = bisect_left(rooms, (s, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            b, room = len(fill), opened(falling, i, lengths)
            fill.append(0)
            cap.append(room)
        place.append(b)
        offset.append(fill[b])
        fill[b] += s
        if room > s:
            insort(rooms, (room - s, b))
    return place, offset, [next(c for c in lengths if c >= f) for f in fill]


def opened(falling: list[int], i: int, lengths: tuple[int, ...]) -> int:
    """The length to open for item i: least expected waste per token, the larger of equals. ``falling`` has the negated sizes."""
    s = -falling[i]
    best, choice = None, 0
    for c in lengths:
        if c < s:
            continue
        used, at = s, i + 1
        while used < c:
            at = bisect_left(falling, used - c, at)  # the largest item still to come that fits
            if at == len(falling):
                break
            used -= falling[at]
            at += 1
        cost = (next(x for x in lengths if x >= used) - used) / used
        if best is None or cost <= best:
            best, choice = cost, c
    return choice


def _placed(counts: DataFrame, lengths: tuple[int, ...], shard_tokens: int) -> DataFrame:
    """SCHEMA and row, from counts (row, doc_id, n_tokens)."""
    most = max(lengths)
    total = counts.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    # a text alone may exceed a shard: its full pieces are whole bins wherever they are made, and only rests need packing
    size = F.col("n_tokens")
    pieces = counts.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(size / most) - 1, F.lit(0)).cast("int"))))
    pieces = pieces.withColumn("n_tokens", F.least(size - F.col("piece") * most, F.lit(most)).cast("int"))
    whole = pieces.filter((F.col("n_tokens") == most) | (F.col("n_tokens") == 0))
    own = F.concat(F.lit("own-"), F.col("row").cast("string"), F.lit("-"), F.col("piece"))
    whole = whole.select("row", "doc_id", "piece", "n_tokens", F.when(size > 0, own).alias("bin_id"), F.when(size > 0, F.lit(most)).alias("capacity"), F.when(size > 0, F.lit(0)).alias("offset"))
    rest = pieces.filter((F.col("n_tokens") < most) & (F.col("n_tokens") > 0)).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(int(shards))).cast("int"))

    def fill(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        row, ids, piece, n = (table.column(c).to_pylist() for c in ("row", "doc_id", "piece", "n_tokens"))
        order = sorted(range(len(n)), key=lambda i: (-n[i], ids[i] is None, ids[i] or 0, piece[i], row[i]))
        place, offset, cap = best_fit([n[i] for i in order], lengths)
        return pa.table({
            "row": pa.array([row[i] for i in order], pa.int64()), "doc_id": pa.array([ids[i] for i in order], pa.int64()), "piece": pa.array([piece[i] for i in order], pa.int32()), "n_tokens": pa.array([n[i] for i in order], pa.int32()),
            "bin_id": [f"{shard}-{b}" for b in place], "capacity": pa.array([cap[b] for b in place], pa.int32()), "offset": pa.array(offset, pa.int32()),
        })

    return rest.groupBy("shard").applyInArrow(fill, f"row long, {SCHEMA}").unionByName(whole)


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bin_id, capacity (the bin's final length), offset in the bin."""
    counts = cut(token_counts(docs).withColumn("row", F.monotonically_increasing_id()))
    return _placed(counts, lengths, shard_tokens).drop("row")


def pack_ids(encoded: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The packed sequences of encoded documents (doc_id, ids): bin_id, capacity, ids, and the documents and starts of its pieces."""
    rows = cut(encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).withColumn("row", F.monotonically_increasing_id()))
    placed = _placed(rows.select("row", "doc_id", F.size("ids").cast("long").alias("n_tokens")), lengths, shard_tokens).filter("bin_id is not null")
    part = F.slice("ids", F.col("piece") * max(lengths) + 1, F.col("n_tokens"))
    pieces = placed.join(rows.select("row", "ids"), "row").select("bin_id", "capacity", F.struct("offset", "doc_id", part.alias("ids")).alias("p"))
    held = pieces.groupBy("bin_id", "capacity").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return held.select("bin_id", "capacity", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
