"""Mixing of sources to target weights by Pfair scheduling.

Each source's documents form blocks. A source of weight w has block j (from 0) released at slot floor(j / w)
and due by slot ceil((j + 1) / w); at every slot the released block with the earliest deadline runs, ties
broken by which window overlaps its successor and then by name. Weights are taken as the exact fractions that they
are written as, brought to whole units without a common divisor; releases and deadlines are whole-number
arithmetic on these. There is one endless schedule for given weights: a source that has run out leaves its slots empty, and the
others keep theirs. It repeats after as many slots as there are units. If they are at most PERIOD, one period
of it, made on the driver, is all that is needed, however many documents there are; else the driver goes through the same
schedule up to the last slot that a document needs. Weights that are multiples of a millionth of their sum have a period of at most
a million. A document's slot follows from its block number. Until a source runs out, the share of any source
in any prefix differs from its target by less than one block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction
from numbers import Rational

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free, materialize, small

#: Units for callers of to_units that want weights rounded to a fixed total.
UNITS = 1000
#: Slots of the longest period; its table has a row a slot and is broadcast.
PERIOD = 1_000_000
#: Documents in a block.
BLOCK = 16
#: Documents that one group should hold while documents are numbered, and groups of a source at most (they grow beyond).
GROUP, GROUPS = 64, 100_000
#: Equal rows beyond this are numbered in as many parts as SALT, by their places in the input.
HOT, SALT = 4096, 1024


def to_units(weights: Mapping[str, float], units: int | None = None) -> dict[str, int]:
    """Weights as the smallest whole units of exactly their proportions; with units, rounded to that total, at least one each, by largest remainders."""
    if units is None:
        exact = {s: Fraction(w) if isinstance(w, Rational) else Fraction(str(w)) for s, w in weights.items()}
        if not exact or min(exact.values()) <= 0:
            raise ValueError("positive weights are needed")
        scale = math.lcm(*(w.denominator for w in exact.values()))
        whole = {s: int(w * scale) for s, w in exact.items()}
        common = math.gcd(*whole.values())
        return {s: n // common for s, n in whole.items()}
    if not weights or len(weights) > units or min(weights.values()) <= 0:
        raise ValueError(f"1 to {units} sources with positive weights are needed")
    total, spare = sum(weights.values()), units - len(weights)
    exact = {s: 1 + spare * w / total for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: units - sum(out.values())]:
        out[s] += 1
    return out


def period(units: Mapping[str, int], blocks: Mapping[str, int] | None = None) -> dict[str, list[int]]:
    """For each source the slots of its blocks in the endless schedule, by earliest deadline among released blocks.

    Without blocks, those of one period. With blocks, so many of each source: the schedule is gone through until all have their slots, and
    slots that only a source which has run out would fill are not counted, so the order is that of the endless schedule.
    """
    total, blocks = sum(units.values()), units if blocks is None else blocks
    slots: dict[str, list[int]] = {s: [] for s in units}
    waiting, released, slot, place, left = [(0, s, 0) for s in sorted(units)], [], 0, 0, sum(blocks[s] for s in units)
    heapq.heapify(waiting)
    while left:
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            deadline = -(-(j + 1) * total // units[s])
            overlaps = (j + 1) * total % units[s] != 0
            heapq.heappush(released, (deadline, not overlaps, s, j))
        _, _, s, j = heapq.heappop(released)  # the weights add up to one, so some block is released
        if j < blocks[s]:
            slots[s].append(place)
            place, left = place + 1, left - 1
        slot += 1
        heapq.heappush(waiting, ((j + 1) * total // units[s], s, j + 1))
    return slots


def _hashable(docs: DataFrame) -> list[str]:
    return [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]


def numbered(docs: DataFrame, number: str, name: str, sizes: Mapping[str, int], hot_rows: int | None = None) -> DataFrame:
    """docs with `number`, from 0 within each source (its name in column `name`, its rows in sizes) in order of a hash of the row.

    A source's rows are numbered in as many groups by leading hash digits as its size asks for, with the counts of
    all groups before, so no source has to fit one task. Only the hash is ordered, so columns that the caller does
    not use are not shuffled.
    """
    spark = docs.sparkSession
    code, group, groups, rank, before, same, salt = free(docs, "_hash", "_group", "_groups", "_rank", "_before", "_same", "_salt")
    plan = spark.createDataFrame([(s, max(1, min(GROUPS, n // GROUP))) for s, n in sizes.items()], f"{name} string, {groups} long")
    keyed = docs.withColumn(code, F.xxhash64(*[F.col(f"`{c}`") for c in _hashable(docs) if c != name]))
    keyed = keyed.join(small(plan), name).withColumn(group, F.floor(F.shiftrightunsigned(code, 24) * F.col(groups) / (1 << 40)).cast("int")).drop(groups)
    by = [name, group]
    counts = materialize(keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "mixing-counts")
    hot = _repeated(keyed, counts, name, group, code, hot_rows or HOT)
    if hot is not None:
        # Rows that repeat very often come after the others of their group, in parts by their places, which are written so that they stay.
        keyed = keyed.join(small(hot.withColumn(same, F.col(code))), [*by, code], "left")
        keyed = materialize(keyed.withColumn(salt, F.when(F.col(same).isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALT)))), "mixing-rows")
        keyed = keyed.withColumns({same: F.coalesce(F.col(same), F.lit(-(1 << 63))), salt: F.coalesce(F.col(salt), F.lit(-1))})
        by = [name, group, same, salt]
        counts = materialize(keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "mixing-counts")
    earlier = F.sum("_n").over(Window.partitionBy(name).orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, F.coalesce(earlier, F.lit(0)).alias(before))
    inner = F.row_number().over(Window.partitionBy(*by).orderBy(code))
    out = keyed.withColumn(rank, inner).join(small(counts), by)
    return out.withColumn(number, F.col(rank) - 1 + F.col(before)).drop(code, group, before, rank, same, salt)


def _repeated(keyed: DataFrame, counts: DataFrame, name: str, group: str, code: str, most: int) -> DataFrame | None:
    """(name, group, code) of rows that occur more than `most` times; None if there are none. Only groups of more rows are looked at."""
    large = counts.where(F.col("_n") > most).select(name, group)
    if large.isEmpty():
        return None
    each = keyed.select(name, group, code).join(small(large), [name, group], "left_semi").groupBy(name, group, code).agg(F.count(F.lit(1)).alias("_n"))
    found = materialize(each.where(F.col("_n") > most).drop("_n"), "mixing-repeated")
    return None if found.isEmpty() else found


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, names: tuple[str, str] = ("slot", "place")) -> DataFrame:
    """docs (source and any others) with `slot` and `place` (or other names), to be ordered by both.

    weights: target weight for each source; by default all sources weigh the same. Every document is kept:
    after a source has run out, the others go on in their proportions, in the slots that they have anyway. A null source is a source of its
    own (in weights: None). Sources without a weight get the smallest one; a row a source, and its weight, are on the driver. Rows that
    repeat are numbered each; equal ones beyond HOT are dealt to parts by their places in the input. An
    empty table gives an empty result. All other columns are kept, whatever their names; those that docs already
    has under the two new names are replaced.
    """
    docs = docs.drop(*names)
    counts = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}  # a row a source, as the target weights
    found = sorted(counts, key=lambda s: (s is not None, s))
    given = dict(weights or {})
    least = min(given.values(), default=1.0)
    share = {s: given.get(s, least) for s in found}
    if not share:
        return docs.withColumns({n: F.lit(0).cast("long") for n in names})
    label = lambda s: "0" if s is None else f"1{s}"
    own = to_units({label(s): w for s, w in share.items()})
    whole = sum(own.values()) <= PERIOD
    sizes = {label(s): n for s, n in counts.items()}
    name, number, turn, length, at = free(docs, "_name", "_number", "_turn", "_length", "_at")
    rows = docs.withColumn(name, F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source").cast("string"))))
    rows = numbered(rows, number, name, sizes)
    table = period(own, None if whole else {s: -(-n // block) for s, n in sizes.items()})
    slots = docs.sparkSession.createDataFrame([(s, i, x) for s, xs in table.items() for i, x in enumerate(xs)], f"{name} string, {turn} long, {at} long")
    lengths = docs.sparkSession.createDataFrame([(s, own[s]) for s in table], f"{name} string, {length} long")
    j = F.floor(F.col(number) / block)
    if whole:  # a period, again and again
        rows = rows.join(small(lengths), name).withColumn(turn, j % F.col(length)).join(small(slots), [name, turn])
        slot = F.floor(j / F.col(length)) * sum(own.values()) + F.col(at)
    else:
        rows = rows.withColumn(turn, j).join(small(slots), [name, turn])
        slot = F.col(at)
    return rows.withColumns({names[0]: slot.cast("long"), names[1]: (F.col(number) % block).cast("long")}).drop(name, number, turn, length, at)


def mixed_in_order(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """docs in mixed order, with their own columns only: each output partition follows the one before."""
    names = tuple(free(docs, "_slot", "_place"))
    return mix(docs, weights, names=names).orderBy(*names).select(*docs.columns)
