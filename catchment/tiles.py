"""Rasters as square tiles, and fixed points on them by rounds of local relaxation and border exchange.

A tile is one row: tr, tc, and each field's values as bytes. The tiles, each padded by a cell of its neighbours'
values, are written once. A round keeps borders alone: what each tile last heard from its neighbours and last
told them. A tile that hears something new is read again and solved from its start values with what it has heard, and
tells what changed on its border; the rounds end when nothing does, and a last pass gives the cells. So the raster is
written twice in all, and a round reads the tiles that heard something and writes borders. The number of rounds is the number
of tiles that a path crosses; ``borders`` has a way for problems that can be contracted instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .checkpoints import materialize, release
from .grid import DIRECTIONS, GridMeta

SIZE = 512
#: Cells that one numpy step works on: so many small tiles of equal shape are solved at once, a larger tile alone.
STACK = 1 << 15
#: Edge in cells of what one task cuts into tiles, unless a tile is larger.
CUT = 128
#: Bytes and rows of an Arrow batch that leaves a task, about, and bytes of one that enters it.
BATCH_BYTES, BATCH_CELLS, BATCH_IN = 4 << 20, 1 << 16, 8 << 20


@dataclass(frozen=True)
class Field:
    dtype: str
    fill: float | int
    planes: int = 0  # 0: one value a cell

    def blank(self, h: int, w: int) -> np.ndarray:
        return np.full(((self.planes,) if self.planes else ()) + (h, w), self.fill, self.dtype)

    def read(self, b: bytes, h: int, w: int) -> np.ndarray:
        """The array of h x w cells; of one padded by a cell all around, its inside."""
        a, planes = np.frombuffer(b, self.dtype), max(1, self.planes)
        if len(a) != planes * h * w:
            a = a.reshape(planes, h + 2, w + 2)[:, 1:-1, 1:-1]
        return a.reshape(((self.planes,) if self.planes else ()) + (h, w))


def shape(meta: GridMeta, tr: int, tc: int, size: int) -> tuple[int, int]:
    return min(size, meta.height - tr * size), min(size, meta.width - tc * size)


def _lean(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python batches of BATCH_IN bytes from now on: else a worker would hold 64 MB of tiles beside the one it works on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_IN)
    return df


def to_tiles(cells: DataFrame, meta: GridMeta, fields: dict[str, Field], size: int = SIZE) -> DataFrame:
    """Tiles of ``cells`` (r, c and a column for each field; NULL takes the field's fill)."""

    edge = max(1, CUT // size) * size

    def build(table: pa.Table) -> pa.Table:
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        r0, c0 = int(r[0]) // edge * edge, int(c[0]) // edge * edge
        h, w = min(edge, meta.height - r0), min(edge, meta.width - c0)
        at = (r - r0, c - c0)
        whole = {}
        for name, f in fields.items():
            whole[name] = a = f.blank(h, w)
            col = table.column(name).combine_chunks()
            if f.planes:
                a[(slice(None), *at)] = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, f.planes).T
            else:
                a[at] = pc.fill_null(col, pa.scalar(f.fill, col.type)).to_numpy(zero_copy_only=False)
        tiles = np.unique(np.stack([r // size, c // size]), axis=1)
        out = {"tr": tiles[0], "tc": tiles[1]}
        for name, a in whole.items():
            out[name] = [a[..., i * size - r0 : (i + 1) * size - r0, j * size - c0 : (j + 1) * size - c0].tobytes() for i, j in tiles.T.tolist()]
        return pa.table(out, schema=pa.schema([("tr", pa.int32()), ("tc", pa.int32())] + [(n, pa.binary()) for n in fields]))

    keyed = cells.select("r", "c", *fields, (F.col("r") / edge).cast("int").alias("gr"), (F.col("c") / edge).cast("int").alias("gc"))
    return _lean(keyed).groupBy("gr", "gc").applyInArrow(build, "tr int, tc int, " + ", ".join(f"{n} binary" for n in fields))


def from_tiles(tiles: DataFrame, meta: GridMeta, fields: dict[str, tuple[Field, str]], size: int = SIZE) -> DataFrame:
    """One row per cell; fields: the field and its SQL type."""
    schema = "r int, c int, " + ", ".join(f"{n} {t}" for n, (_, t) in fields.items())

    def joined(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["r", "c", *fields])

    def run(batches):
        held, count = [], 0
        for b in batches:
            for i in range(b.num_rows):
                tr, tc = b.column("tr")[i].as_py(), b.column("tc")[i].as_py()
                h, w = shape(meta, tr, tc, size)
                values = [f.read(b.column(b.schema.get_field_index(n))[i].as_py(), h, w).ravel() for n, (f, _) in fields.items()]
                held.append([np.repeat(np.arange(h, dtype=np.int32) + tr * size, w), np.tile(np.arange(w, dtype=np.int32) + tc * size, h), *values])
                count += h * w
                if count >= BATCH_CELLS:
                    yield joined(held)
                    held, count = [], 0
        if held:
            yield joined(held)

    return _lean(tiles).select("tr", "tc", *fields).mapInArrow(run, schema)


def many(meta: GridMeta, size: int) -> bool:
    """Whether a raster has more than one tile."""
    return size < meta.height or size < meta.width


def _mapped(tiles: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """The rows of ``schema`` that ``work`` makes of the rows, as dicts, of a task; small ones leave together."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        rows = ({n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)} for b in batches for i in range(b.num_rows))
        held, weight = [], 0
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in held], f.type) for f in arrow], schema=arrow)
        for row in work(rows):
            held.append(row)
            weight += sum(len(v) if isinstance(v, bytes) else 256 * len(v) for v in row.values() if isinstance(v, (bytes, list)))
            if weight >= BATCH_BYTES or len(held) == 256:
                yield packed()
                held, weight = [], 0
        if held:
            yield packed()

    return _lean(tiles).mapInArrow(run, schema)


def each_tile(tiles: DataFrame, work: Callable[[dict], dict], schema: str) -> DataFrame:
    """``work`` applied to each row, as a dict, of ``tiles``; it returns the row of ``schema``. One large tile, or a few MB of small ones, is held."""
    return _mapped(tiles, lambda rows: map(work, rows), schema)


def each_stack(tiles: DataFrame, work: Callable[[list[dict]], list[dict]], schema: str, meta: GridMeta, size: int) -> DataFrame:
    """``work`` applied to lists of rows whose tiles have one shape and at most STACK cells together (a larger tile alone)."""
    most = max(1, STACK // (size + 2) ** 2)

    def stacks(rows: Iterator[dict]) -> Iterator[dict]:
        held: dict[tuple[int, int], list[dict]] = {}
        for row in rows:
            same = held.setdefault(shape(meta, row["tr"], row["tc"], size), [])
            same.append(row)
            if len(same) == most:
                yield from work(same)
                same.clear()
        for same in held.values():
            if same:
                yield from work(same)

    return _mapped(tiles, stacks, schema)


def _strip(a: np.ndarray, dr: int, dc: int) -> np.ndarray:
    pick = lambda d: slice(None) if d == 0 else slice(0, 1) if d < 0 else slice(-1, None)
    return a[..., pick(dr), pick(dc)]


def shifted(padded: np.ndarray, k: int) -> np.ndarray:
    """The neighbours in direction k of a tile's cells, from its padded array."""
    dr, dc = DIRECTIONS[k]
    h, w = padded.shape[-2] - 2, padded.shape[-1] - 2
    return padded[..., 1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w]


def _place(d: int, n: int) -> slice:
    return slice(1, n + 1) if d == 0 else slice(0, 1) if d < 0 else slice(n + 1, n + 2)


def _strips(arrays: list[np.ndarray]) -> list[bytes]:
    """What a tile's neighbours see of it, by the direction in which they lie."""
    return [b"".join(np.ascontiguousarray(_strip(a, dr, dc)).tobytes() for a in arrays) for dr, dc in DIRECTIONS]


def _paste(padded: dict[str, np.ndarray], side: int, blob: bytes, fields: dict[str, Field], names: list[str], h: int, w: int) -> None:
    """Puts a neighbour's border around the padded arrays."""
    dr, dc = DIRECTIONS[side]
    sh, sw = (h if dr == 0 else 1), (w if dc == 0 else 1)
    at = 0
    for n in names:
        f = fields[n]
        count = sh * sw * max(1, f.planes)
        padded[n][..., _place(dr, h), _place(dc, w)] = np.frombuffer(blob, f.dtype, count, at).reshape(((f.planes,) if f.planes else ()) + (sh, sw))
        at += count * np.dtype(f.dtype).itemsize


def _told(rows: DataFrame, meta: GridMeta, size: int) -> DataFrame:
    """tr, tc, news (side, strip): the strips that are not null, gathered by the tile that they are for."""
    step = lambda i: F.element_at(F.array(*[F.lit(d[i]) for d in DIRECTIONS]), F.col("k") + 1)
    sent = rows.select("tr", "tc", F.posexplode("strips").alias("k", "strip")).filter("strip is not null")
    to = sent.select((F.col("tr") + step(0)).alias("tr"), (F.col("tc") + step(1)).alias("tc"), F.struct(((F.col("k") + 4) % 8).alias("side"), "strip").alias("news"))
    last = (meta.height - 1) // size, (meta.width - 1) // size
    return to.filter(F.col("tr").between(0, last[0]) & F.col("tc").between(0, last[1])).groupBy("tr", "tc").agg(F.collect_list("news").alias("news"))


def padded(tiles: DataFrame, meta: GridMeta, fields: dict[str, Field], size: int = SIZE) -> DataFrame:
    """tr, tc, and each field padded by a cell of the neighbours' values (its fill outside the raster)."""
    schema = "tr int, tc int, " + ", ".join(f"{n} binary" for n in fields)

    def show(row: dict) -> dict:
        h, w = shape(meta, row["tr"], row["tc"], size)
        return {"tr": row["tr"], "tc": row["tc"], "strips": _strips([f.read(row[n], h, w) for n, f in fields.items()])}

    def surround(row: dict) -> dict:
        h, w = shape(meta, row["tr"], row["tc"], size)
        out = {n: f.blank(h + 2, w + 2) for n, f in fields.items()}
        for n, f in fields.items():
            out[n][..., 1:-1, 1:-1] = f.read(row[n], h, w)
        for x in row.get("news") or []:
            _paste(out, x["side"], x["strip"], fields, list(fields), h, w)
        return {"tr": row["tr"], "tc": row["tc"]} | {n: a.tobytes() for n, a in out.items()}

    only = tiles.select("tr", "tc", *fields)
    if not many(meta, size):
        return each_tile(only, surround, schema)
    return each_tile(only.join(_told(each_tile(only, show, "tr int, tc int, strips array<binary>"), meta, size), ["tr", "tc"], "left"), surround, schema)


def relax(tiles: DataFrame, meta: GridMeta, fields: dict[str, Field], state: str, solve: Callable[[dict[str, np.ndarray]], np.ndarray], size: int = SIZE, once: bool = False) -> DataFrame:
    """Rounds of ``solve`` until nothing changes (or one round): the tiles with tr, tc and all fields.

    ``solve`` gets each field of some tiles of one shape, each padded by one cell of its neighbours' values, with rows and columns as the
    last two axes and tiles before them, and returns the tiles' new state; it must be monotone, so that any order of rounds meets the same fixed point.
    """
    names = ["tr", "tc", *fields]
    whole = "tr int, tc int, " + ", ".join(f"{n} binary" for n in fields)
    heard = "tr int, tc int, ring array<binary>, shown array<binary>, strips array<binary>"

    def solved(rows: list[dict], rings: list[list]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        h, w = shape(meta, rows[0]["tr"], rows[0]["tc"], size)
        arrays = {n: np.stack([f.read(row[n], h + 2, w + 2) for row in rows], axis=-3) for n, f in fields.items()}
        for i, ring in enumerate(rings):
            for side, strip in enumerate(ring):
                if strip is not None:
                    _paste({state: arrays[state][..., i, :, :]}, side, strip, fields, [state], h, w)
        return arrays, solve(arrays).astype(fields[state].dtype, copy=False)

    def listen(rows: list[dict]) -> list[dict]:
        """Tiles with what they have heard so far (ring), what they have shown, and in ``strips`` what they show anew."""
        rings = [row.get("ring") or [None] * 8 for row in rows]
        for row, ring in zip(rows, rings):
            for x in row.get("news") or []:
                ring[x["side"]] = x["strip"]
        new, out = solved(rows, rings)[1], []
        for i, (row, ring) in enumerate(zip(rows, rings)):
            show, old = _strips([new[..., i, :, :]]), row.get("shown") or [None] * 8
            out.append({"tr": row["tr"], "tc": row["tc"], "ring": ring, "shown": show, "strips": [s if s != o else None for s, o in zip(show, old)]})
        return out

    def finish(rows: list[dict]) -> list[dict]:
        arrays, new = solved(rows, [row.get("ring") or [] for row in rows])
        inside = {n: new if n == state else a[..., 1:-1, 1:-1] for n, a in arrays.items()}
        return [{"tr": row["tr"], "tc": row["tc"]} | {n: a[..., i, :, :].tobytes() for n, a in inside.items()} for i, row in enumerate(rows)]

    def step(df: DataFrame, work: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
        return materialize(each_stack(df, work, schema, meta, size))

    if not many(meta, size):
        return step(padded(tiles, meta, fields, size), finish, whole)
    tiles = materialize(tiles.select(names))
    base = materialize(padded(tiles, meta, fields, size))
    release(tiles)
    if once:
        return step(base, finish, whole)
    now = step(base, listen, heard)
    news = materialize(_told(now, meta, size))
    while news.take(1):
        mine = news.join(now.select("tr", "tc", "ring", "shown"), ["tr", "tc"])
        stepped = each_stack(base.join(mine, ["tr", "tc"]), listen, heard, meta, size)
        quiet = now.join(news.select("tr", "tc"), ["tr", "tc"], "left_anti").withColumn("strips", F.array_repeat(F.lit(None).cast("binary"), 8))
        after = materialize(stepped.unionByName(quiet))
        release(now, news)
        now, news = after, materialize(_told(after, meta, size))
    done = step(base.join(now.select("tr", "tc", "ring"), ["tr", "tc"], "left"), finish, whole)
    release(base, now, news)
    return done
