"""Enrichment: one lookup for each distinct value, merged into the attributes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import IPV4, ipv4_digits, ipv4_number
from ..functions.storage import materialize, small
from .rules import ipv6_digits

#: Lookup tables of at most so many ranges are broadcast.
BROADCAST_RANGES = 200_000


def eligible(df: DataFrame, pattern: str) -> DataFrame:
    """One row: whether any attribute value matches; existence in all rows, not in a sample."""
    hit = F.exists(F.map_values("attributes"), lambda v: v.rlike(pattern))
    return df.agg(F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("n")).select((F.col("n") > 0).alias("eligible"))


def address_digits(text: Column) -> Column:
    """32 hex digits of an IPv4 or IPv6 address in any of its forms, else null; IPv4 ones are mapped."""
    t = F.trim(text)
    return F.when(t.rlike(IPV4), ipv4_digits(ipv4_number(t))).otherwise(ipv6_digits(t))


def address_values(df: DataFrame) -> DataFrame:
    """(val): distinct attribute values that are IPv4 or IPv6 addresses; derived keys, which contain a colon, are not looked up."""
    like = lambda v: v.rlike(IPV4) | v.contains(":")
    each = df.select(F.explode(F.map_filter("attributes", lambda k, v: ~k.contains(":") & like(v))).alias("key", "val"))
    distinct = each.select("val").distinct()
    return distinct.where(address_digits(F.col("val")).isNotNull())


def _blocks(columns: Sequence[str]):
    """Ranges (lo, hi: 32 hex digits) as aligned blocks: (prefix, size, columns...). A block is a run of digits that all addresses in it begin with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, prefix, size = [], [], []
            for i, (lo, hi) in enumerate(zip(pdf["lo"], pdf["hi"], strict=True)):
                if not lo or not hi or lo > hi:
                    continue
                a, b = int(lo, 16), int(hi, 16)
                width = f"{b - a:032x}"
                while a <= b:  # the largest aligned block that begins here and does not pass the end
                    digits = 0
                    while digits < 32 and not a & ((1 << 4 * digits + 4) - 1) and a + (1 << 4 * digits + 4) - 1 <= b:
                        digits += 1
                    at.append(i)
                    prefix.append(f"{a:032x}"[: 32 - digits])
                    size.append(width)
                    a += 1 << 4 * digits
            if at:
                yield pdf.iloc[at][list(columns)].assign(prefix=prefix, size=size)

    return run


def ranges_of(values: DataFrame, ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """values (val: addresses) with the columns of the range (lo, hi) that holds them, IPv4 and IPv6 alike.

    lo and hi are numbers of IPv4 addresses, or texts of addresses of either family; a range ends at hi. Of nested ranges the smallest one
    wins; rows without an address are no range. Addresses are 32 hex digits (IPv4 ones in their mapped form). Ranges are cut into aligned
    blocks of digits, at most 30 for each digit that their ends share not, and each value is looked up by its prefixes of only those lengths that
    blocks have: an equi-join whatever the ranges' sizes, broadcast if the blocks are counted to be few.
    """
    v = values.select("val", address_digits(F.col("val")).alias("digits")).where("digits IS NOT NULL")
    of_number = dict(ranges.dtypes)["lo"] != "string"
    digits = (lambda c: ipv4_digits(F.col(c))) if of_number else (lambda c: address_digits(F.col(c)))
    types = dict(ranges.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), "prefix string", "size string"])
    cut = materialize(ranges.select(*columns, digits("lo").alias("lo"), digits("hi").alias("hi")).mapInPandas(_blocks(columns), schema), "address-blocks")
    lengths = [r.n for r in cut.select(F.length("prefix").alias("n")).distinct().collect()]  # 33 at most
    each = v.select("val", F.explode(F.array(*[F.substring("digits", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")).alias("prefix"))
    hit = each.join(small(cut, 4 * BROADCAST_RANGES), "prefix")
    own = F.struct(*columns)
    best = hit.groupBy("val").agg(F.min_by(own, F.struct("size", F.col("prefix"))).alias("b"))
    return best.select("val", "b.*")


def enrichment(df: DataFrame, found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(event_id, made): for each event the derived keys `<key>:<column>` of its values in found (val, columns)."""
    each = df.select("event_id", F.explode(F.map_filter("attributes", lambda k, v: ~k.contains(":"))).alias("key", "val"))
    pairs = F.array(*[F.struct(F.concat_ws(":", "key", F.lit(c)).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])
    hit = each.join(found, "val").select("event_id", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))).alias("p"))
    return hit.groupBy("event_id").agg(F.map_from_entries(F.array_sort(F.collect_set("p"))).alias("made"))


def apply_enrichment(df: DataFrame, made: DataFrame, owned: Sequence[str]) -> DataFrame:
    """Merges derived keys; keys whose last part this enricher owns are stripped first, so nothing stale is left."""
    last = lambda k: F.element_at(F.split(k, ":"), -1)
    mine: Column = F.map_filter("attributes", lambda k, v: ~(k.contains(":") & last(k).isin(*owned)))
    out = df.join(made, "event_id", "left")
    return out.withColumn("attributes", F.when(F.col("made").isNull(), mine).otherwise(F.map_concat(mine, "made"))).drop("made")
