"""Removal of near-repeated lines by an exact set-similarity join, in DataFrame functions alone.

A line is the set of its distinct words; a line goes if an earlier line (by id, then place in the text;
removed or not) has Jaccard similarity of at least PERCENT percent. Words are ordered by rarity: corpus
counts of 2**CLASS_BITS hash classes of words give each class a rank, and a word's token holds rank and
hash, so sorting tokens sorts by rarity. Equal sets are one class, led by its first line; only leads join:

* prefix filter: similar sets share a token among the rarest n - ceil(t n) + 1 of each;
* of a pair the larger set looks for the smaller one, whose prefix is shorter then: n - ceil(2t / (1 + t) n) + 1;
* length filter: t times the larger set is at most the smaller; the key of the join holds the larger one's band of
  sizes, and the smaller set's prefix is shorter for bands above its own: n - ceil(t / (1 + t) (n + least size of the band)) + 1;
* positional filter: the tokens behind the shared one must suffice;
* parity filter: a token flips one of 64 bits of its line (128 where both lines have more than WIDE words),
  so the bits in which two lines differ are at most the tokens in which they differ.

The join goes in rounds of hubs. In a round of share k the earlier line of a pair is one of those leads
whose hash falls into one of k parts; the later line is any lead not yet known to repeat one. So a crowd of near copies ends with its first few hubs instead of meeting pair by pair
(they share one of the FEW rarest tokens, and what does not is left to the last round), and the last round (share 1) leaves no pair untested: nothing is capped.
That round goes by bands, in PARTS joins, so that the shuffle files of one are gone before the next. What passes the filters is verified
on the words themselves, first for each later line the partner that differs in the fewest bits, then the
other partners of lines still open. A token that very many lines share is one key of an inner join, which Spark splits.

Lines without a word stay. A null text stays null. A null id sorts below all others, rows of equal id
are ordered by text, and rows equal in both are one document. All columns are kept.
"""

from __future__ import annotations

import functools
import math
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import materialize
from .common import keyed, marks, release, seen_in

cut = functools.partial(materialize, lean=True)

PERCENT = 80
CLASS_BITS = 16
#: Parts of the leads of which one serves as hubs in each round; about the size of the largest crowd of near copies is a good first number.
SHARES = (80, 1)
#: Tokens of a line that seek a hub in the rounds before the last.
FEW = 4
#: Sizes of a band differ by less than this factor.
BAND = 1.25
#: Joins of the last round.
PARTS = 3
#: Lines of more words have 128 parity bits.
WIDE = 96
#: Two numbers below 2**31 in one long.
_HALF = 1 << 31


def _spaced(text: Column) -> Column:
    """A text whose lines have their words parted by spaces alone."""
    odd = F.lit(False)
    for c in "\t\v\f\r":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.translate(text, "\t\v\f\r", "    ")).otherwise(text)


def _lines_of(text: Column) -> Column:
    return F.split(_spaced(text), "\n")


def _ranks(docs: DataFrame) -> Column:
    """The rarity rank of each hash class of words, as an array of fixed size, from counts over all texts."""
    words = docs.select(F.explode(F.split(F.replace(_spaced(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counted = words.groupBy(F.shiftrightunsigned(F.xxhash64("w"), 64 - CLASS_BITS).alias("c")).count().toArrow()
    n, each = np.zeros(1 << CLASS_BITS, np.int64), np.arange(1 << CLASS_BITS, dtype=np.int64)
    n[counted["c"].to_numpy()] = counted["count"].to_numpy()
    rank = np.empty_like(each)
    rank[np.argsort(n, kind="stable")] = each
    # what turns the class in a hash's top bits into its rank, lowest rank first in the order of signed numbers
    flip = (rank ^ each ^ (1 << (CLASS_BITS - 1))) << (64 - CLASS_BITS)
    return F.split(F.lit(",".join(map(str, flip.tolist()))), ",").cast("array<bigint>")


def _hashes(line: Column) -> Column:
    """The hashes of a line's distinct words; of the empty word too where spaces stand together or at an end."""
    return F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))


def _sorted(hashes: str, ranks: Column) -> Column:
    """The tokens of hashes, the rarest first."""
    flip = lambda h: F.coalesce(F.get(ranks, F.shiftrightunsigned(h, 64 - CLASS_BITS).cast("int")), F.lit(0).cast("long"))
    return F.sort_array(F.transform(hashes, lambda h: h.bitwiseXOR(flip(h))))


def _lines(docs: DataFrame, percent: int) -> DataFrame:
    """doc, place (number of the line, then twin), n, d1, d2 (digest of the set), parity, upper (of the parity, the part of tokens with bit 6 set; 0 in short lines), rare (the tokens of the prefix)."""
    ranks = _ranks(docs)
    place = (F.col("no").cast("long") * _HALF + F.col("twin")).alias("place")
    lines = docs.select("doc", "twin", F.posexplode(_lines_of(F.col("text"))).alias("no", "line")).filter(F.trim("line") != "")
    gaps = F.contains("line", F.lit("  ")) | F.startswith("line", F.lit(" ")) | F.endswith("line", F.lit(" "))
    # in steps: an array function inside another one's lambda or argument is interpreted, over boxed numbers; alone it is compiled
    hashed = lines.select("doc", place, gaps.alias("gaps"), _hashes(F.col("line")).alias("h"))
    clean = hashed.select("doc", "place", F.when(F.col("gaps"), F.array_remove("h", F.xxhash64(F.lit("")))).otherwise(F.col("h")).alias("h"))
    lines = clean.select("doc", "place", F.size("h").alias("n"), _sorted("h", ranks).alias("t"))
    n = F.col("n")
    parity = lambda ts: F.aggregate(ts, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(bit(t)))
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    return lines.select(
        "doc", "place", "n", F.xxhash64("t").alias("d1"), F.xxhash64(F.lit(1), "t").alias("d2"),
        parity(F.col("t")).alias("parity"), F.when(n > WIDE, parity(F.filter("t", lambda t: t.bitwiseAND(F.lit(64)) != 0))).otherwise(0).cast("long").alias("upper"),
        F.slice("t", F.lit(1), _prefix(n, percent / 100)).alias("rare"),
    )


def _prefix(n: Column, share: float) -> Column:
    """How many of the rarest of n tokens must hold one of those shared with a set that has at least this share of them."""
    return n - F.ceil(n * share - 1e-9).cast("int") + 1


def _band(n: Column) -> Column:
    """The band of a size; it never falls as sizes grow."""
    return F.floor(F.log(n) / math.log(BAND)).cast("int")


def _index(leads: DataFrame, low: Column | None = None, high: Column | None = None, share: float | None = None, most: int | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """A row for each token of each prefix (for ``share`` if given, of ``most`` tokens at most), in each band of sizes from low to high (else the line's own).

    With ``share`` the other set has no fewer tokens and lies in the band. Only bands of ``part`` (number, of how many) are taken.
    tok holds band and 31 bits of the token; size_rest holds n, the tokens from this one on, and shut (1 for a line known to repeat one).
    """
    n, band = F.col("n"), F.col("band")
    size_rest = (n.cast("long") * _HALF + n - F.col("at")) * 2 + F.col("shut")
    bands = _band(n).alias("band") if low is None else F.explode(F.sequence(_band(low), _band(high))).alias("band")
    rows = leads.select("doc", "place", "n", "parity", "upper", "shut", "rare", bands)
    rows = rows.filter(band % part[1] == part[0]) if part[1] > 1 else rows
    if share is not None:
        least = F.ceil(F.pow(F.lit(BAND), band) * (1 - 1e-9)).cast("int")
        rows = rows.withColumn("rare", F.slice("rare", F.lit(1), n - F.ceil((n + F.greatest(n, least)) * (share / 2) - 1e-9).cast("int") + 1))
    if most is not None:
        rows = rows.withColumn("rare", F.slice("rare", 1, most))
    rows = rows.select("doc", "place", "n", "parity", "upper", "shut", "band", F.posexplode("rare").alias("at", "tok"))
    tok = band.cast("long") * _HALF + F.col("tok").bitwiseAND(F.lit(_HALF - 1))
    return rows.select(tok.alias("tok"), "doc", "place", size_rest.alias("size_rest"), "parity", "upper")


def repeated_lines(docs: DataFrame, percent: int = PERCENT, shares: tuple[int, ...] = SHARES, one_each: bool = False) -> DataFrame:
    """doc, twin, no of every line to remove; ``docs`` has doc, twin, text (see ``keyed``), ``one_each``: each key once. The last share must be 1."""
    if not one_each and docs.groupBy("doc", "twin").count().filter("count > 1").take(1):
        docs = docs.dropDuplicates(["doc", "twin"])
    lines = cut(_lines(docs, percent))
    # of a class only its first line joins; one number orders as (doc, place), so that hashes group it, without a sort
    order = F.col("doc").cast("decimal(19,0)") * F.lit(Decimal(1 << 62)) + F.col("place")
    first = cut(lines.groupBy("d1", "d2").agg(F.min(order).alias("first")))  # cut, so that Spark can split a very common line's rows
    copy = order != F.col("first")
    classes = cut(lines.join(first.hint("shuffle_hash"), ["d1", "d2"]).select("doc", "place", "n", "parity", "upper", F.when(~copy, F.col("rare")).alias("rare"), copy.alias("copy")))
    copies = cut(classes.filter("copy").select("doc", "place"))
    release(lines, first)
    n, hn = F.shiftright("l_size_rest", 32), F.shiftright("h_size_rest", 32)
    rest, hrest = (F.shiftright(x, 1).bitwiseAND(F.lit(_HALF - 1)) for x in ("l_size_rest", "h_size_rest"))
    later = (F.col("l_doc") > F.col("h_doc")) | ((F.col("l_doc") == F.col("h_doc")) & (F.col("l_place") > F.col("h_place")))
    # a later line that is shut differs in more bits than there are
    shut = F.when(later, F.col("l_size_rest")).otherwise(F.col("h_size_rest")).bitwiseAND(F.lit(1)) * _HALF
    all_, upper = F.col("l_parity").bitwiseXOR(F.col("h_parity")), F.col("l_upper").bitwiseXOR(F.col("h_upper"))
    off = F.when(F.least(n, hn) > WIDE, F.bit_count(all_.bitwiseXOR(upper)) + F.bit_count(upper)).otherwise(F.bit_count(all_))
    # whole numbers alone: a shared count k suffices if k (100 + percent) >= percent (n + hn)
    fits = (
        (100 * F.least(n, hn) >= percent * F.greatest(n, hn)) & ((100 + percent) * F.least(rest, hrest) >= percent * (n + hn))
        & ((100 + percent) * F.shiftright(n + hn - off - shut, 1) >= percent * (n + hn))
    )
    side = lambda index, k: index.toDF("tok", *[f"{k}_{c}" for c in ("doc", "place", "size_rest", "parity", "upper")])
    line = lambda k: F.struct(F.col(f"{k}_doc").alias("doc"), F.col(f"{k}_place").alias("place"))
    gone = None
    for share in shares:
        leads = classes.filter(~F.col("copy")).select("doc", "place", "n", "parity", "upper", "rare")
        if gone is None:
            leads = leads.withColumn("shut", F.lit(0))
        else:
            leads = leads.join(gone.withColumn("gone", F.lit(True)), ["doc", "place"], "left").withColumn("shut", F.col("gone").isNotNull().cast("int"))
        size = F.col("n")
        largest = (size * 100 / percent + 1e-9).cast("int")
        found = []
        for part in [(0, 1)] if share > 1 else [(k, PARTS) for k in range(PARTS)]:
            if share > 1:  # most tokens belong to no hub: their rows need no shuffle
                hub = _index(leads.filter(F.pmod(F.xxhash64("doc", "place"), F.lit(share)) == 0), F.ceil(size * percent / 100 - 1e-9), largest, most=FEW)
                open_ = seen_in(_index(leads.filter("shut = 0"), most=FEW), marks(hub, "tok"), "tok")
                once = later
            else:  # of each pair the larger set (of equal ones the later line) looks for the smaller, whose share is larger, so fewer tokens do
                hub = _index(leads, size, largest, 2 * percent / (100 + percent), part=part)
                open_ = _index(leads, part=part)
                once = (n > hn) | ((n == hn) & later)
            met = side(open_, "l").join(side(hub, "h"), "tok").filter(fits & once)
            a, b = F.when(later, line("h")).otherwise(line("l")), F.when(later, line("l")).otherwise(line("h"))
            # a pair meets in one band alone, so the parts have no pair in common
            found.append(cut(met.select(a.alias("a"), b.alias("b"), (n + hn).alias("n"), off.alias("off")).distinct()))
        pairs = functools.reduce(DataFrame.union, found)
        if share == 1:
            release(classes)
        new, used = _verified(docs, pairs, percent)
        whole = cut(new if gone is None else gone.union(new))
        release(*found, gone, *used)
        gone = whole
    removed = cut(copies.union(gone))
    release(copies, gone)
    return removed.select("doc", F.col("place").bitwiseAND(F.lit(_HALF - 1)).cast("int").alias("twin"), F.shiftright("place", 31).cast("int").alias("no"))


def _verified(docs: DataFrame, pairs: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc, place of the later line of each pair (a, b) whose word sets are similar, each once; and what may be released afterwards."""
    wanted = pairs.select("a.doc", "a.place").union(pairs.select("b.doc", "b.place")).distinct()
    # only texts that may hold a wanted line are split, and only lines that may be wanted are shuffled
    texts = seen_in(docs, marks(wanted, "doc"), "doc")
    place = (F.col("no").cast("long") * _HALF + F.col("twin")).alias("place")
    lines = texts.select("doc", "twin", F.posexplode(_lines_of(F.col("text"))).alias("no", "line")).select("doc", place, "line")
    lines = seen_in(lines, marks(wanted, "doc", "place"), "doc", "place").join(wanted, ["doc", "place"], "left_semi")
    lines = cut(lines.select(F.struct("doc", "place").alias("id"), "line"))
    both = F.size(F.array_remove(F.array_intersect(F.split("la", " "), F.split("lb", " ")), ""))
    # |A and B| over |A or B|, so written that the words are compared once
    same = both * (100 + percent) >= percent * F.col("n")
    similar = lambda some: some.join(lines.toDF("a", "la"), "a").join(lines.toDF("b", "lb"), "b").filter(same).select("b").distinct()
    sure = cut(similar(pairs.groupBy("b").agg(F.min(F.struct("off", "a", "n")).alias("best")).select("best.a", "b", "best.n")))
    rest = similar(pairs.select("a", "b", "n").join(sure, "b", "left_anti"))
    return sure.union(rest).select("b.doc", "b.place"), [lines, sure]


def drop_repeated_lines(docs: DataFrame, percent: int = PERCENT, counts: bool = False, shares: tuple[int, ...] = SHARES) -> DataFrame:
    """``docs`` with repeated lines removed from text; ``counts`` adds n_lines and n_removed."""
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    rest = [c for c in names if c not in ("doc_id", "text")]
    base = keyed(docs, F.struct("doc_id", *rest).alias("row"))
    gone = repeated_lines(base.select("doc", "twin", "text"), percent, shares, getattr(base, "one_each", False)).groupBy("doc", "twin").agg(F.collect_set("no").alias("gone"))
    rows = base.join(gone, ["doc", "twin"], "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    done = rows.select("row", text.alias("text"), F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
    out = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return done.select(*out, F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.greatest("n_removed", F.lit(0)).cast("long").alias("n_removed")) if counts else done.select(*out)
