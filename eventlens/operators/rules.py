"""Detection rules: selection maps with a condition, compiled to columns and run in one pass."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import TEXT_COLUMNS, number, resolve, search_blob
from ..functions.normalize import IPV4, ipv4_number
from ..functions.storage import materialize, small
from ..plans.filters import glob_like, java_regex

MODIFIERS = frozenset("contains startswith endswith cased re i m s cidr lt lte gt gte exists all".split())


def ipv6_digits(text: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, a dotted end included; null for all else."""
    # A dotted end is written as two groups of digits.
    dotted = F.regexp_extract(text, r":(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    octet = lambda i: F.lpad(F.lower(F.hex(F.get(F.split(dotted, r"\."), i).cast("long"))), 2, "0")
    plain = F.when(dotted.rlike(IPV4), F.concat(F.regexp_replace(text, r"[\d.]+$", ""), octet(0), octet(1), F.lit(":"), octet(2), octet(3))).otherwise(text)
    sides = F.split(plain, "::")
    groups = lambda side: F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda x: x != "")
    left, right = groups(F.get(sides, 0)), groups(F.get(sides, 1))
    gap = F.array_repeat(F.lit("0"), F.when(F.size(sides) == 2, F.greatest(8 - F.size(left) - F.size(right), F.lit(0))).otherwise(0))
    every = F.concat(left, gap, right)
    good = plain.contains(":") & (F.size(sides) <= 2) & (F.size(every) == 8) & F.forall(every, lambda x: x.rlike("^[0-9a-fA-F]{1,4}$"))
    return F.when(good, F.array_join(F.transform(every, lambda x: F.lpad(F.lower(x), 4, "0")), ""))


def in_network(text: Column, network: str) -> Column:
    """An address inside a network of its kind, of any prefix length; false for all else."""
    net = ipaddress.ip_network(network, strict=False)
    if net.version == 4:
        lo, hi = int(net.network_address), int(net.broadcast_address)
        return F.coalesce(text.rlike(IPV4) & ipv4_number(text).between(lo, hi), F.lit(False))
    # Digits of equal number compare as the addresses do.
    lo, hi = (f"{int(x):032x}" for x in (net.network_address, net.broadcast_address))
    return F.coalesce(text.contains(":") & ipv6_digits(text).between(lo, hi), F.lit(False))


def match(value: Column, want, modifiers: Sequence[str]) -> Column:
    """One wanted value against a field's text."""
    if want is None:
        return value == ""
    if "exists" in modifiers:
        return (value != "") if want else (value == "")
    if "cidr" in modifiers:
        return in_network(value, str(want))
    for name, test in (("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
        if name in modifiers:
            x = number(value)
            return F.coalesce({"<": x < want, "<=": x <= want, ">": x > want, ">=": x >= want}[test], F.lit(False))
    if isinstance(want, bool):
        return F.lower(value) == str(want).lower()
    if isinstance(want, (int, float)):
        return value == str(want)
    if "re" in modifiers:
        flags = "".join(f for f in "ims" if f in modifiers)
        return value.rlike((f"(?{flags})" if flags else "") + java_regex(want))
    pattern = glob_like(want)
    if "contains" in modifiers:
        pattern = f"%{pattern}%"
    elif "startswith" in modifiers:
        pattern = f"{pattern}%"
    elif "endswith" in modifiers:
        pattern = f"%{pattern}"
    return value.like(pattern) if "cased" in modifiers else value.ilike(pattern)


class Columns:
    """Rules as columns: the parts of a condition are boolean columns."""

    def __init__(self, mappings=None):
        self.mappings = mappings

    def keyword(self, text: str) -> Column:
        return search_blob().like(f"%{glob_like(text.lower())}%")

    def test(self, field: str, want, modifiers: Sequence[str]) -> Column:
        return match(resolve(field, self.mappings), want, modifiers)

    def every(self, parts: list[Column]) -> Column:
        return reduce(lambda a, b: a & b, parts)

    def some(self, parts: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, parts)

    def none(self, part: Column) -> Column:
        return ~part


class Cover(NamedTuple):
    """(field, value) pairs one of which an event must have for a condition to hold; None if there are no such pairs. whole: having one is enough."""

    pairs: frozenset[tuple[str, str]] | None
    whole: bool


class Covers:
    """Rules as what they need: only whole values, in any case, can be looked up."""

    def keyword(self, text: str) -> Cover:
        return Cover(None, False)

    def test(self, field: str, want, modifiers: Sequence[str]) -> Cover:
        if "re" in modifiers:
            java_regex(want)
        if "cidr" in modifiers:
            ipaddress.ip_network(str(want), strict=False)
        plain = isinstance(want, (str, int, float)) and not modifiers and (not isinstance(want, str) or (want != "" and not set("*?\\%_") & set(want)))
        return Cover(frozenset({(field, str(want).lower())}), True) if plain else Cover(None, False)

    def every(self, parts: list[Cover]) -> Cover:
        best = min((p for p in parts if p.pairs is not None), key=lambda p: len(p.pairs), default=Cover(None, False))
        return best if len(parts) == 1 else Cover(best.pairs, False)

    def some(self, parts: list[Cover]) -> Cover:
        if any(p.pairs is None for p in parts):
            return Cover(None, False)
        return Cover(frozenset().union(*(p.pairs for p in parts)), all(p.whole for p in parts))

    def none(self, part: Cover) -> Cover:
        return Cover(None, False)


def _selected(spec, how):
    """A map (all of its items), a list of maps (any), or field-less keywords (any, in the lower-cased blob)."""
    if isinstance(spec, str):
        return how.keyword(spec)
    if isinstance(spec, (list, tuple)):
        return how.some([_selected(s, how) for s in spec])
    parts = []
    for key, wanted in spec.items():
        name, *modifiers = key.split("|")
        if unknown := set(modifiers) - MODIFIERS:
            raise ValueError(f"unknown modifiers {sorted(unknown)}")
        tests = [how.test(name, w, modifiers) for w in (wanted if isinstance(wanted, (list, tuple)) else [wanted])]
        parts.append(how.every(tests) if "all" in modifiers else how.some(tests))
    return how.every(parts)


def _built(rule: Mapping, how):
    """A rule's condition put together by `how`: selection names with and, or, not, brackets, `1 of x*`, `all of them`."""
    named = {k: _selected(v, how) for k, v in rule["selections"].items()}
    words = re.findall(r"\(|\)|[^\s()]+", rule["condition"])
    at = 0

    def group(pattern: str, every: bool):
        found = [c for k, c in named.items() if pattern == "them" or re.fullmatch(pattern.replace("*", ".*"), k)]
        if not found:
            raise ValueError(f"nothing named {pattern}")
        return how.every(found) if every else how.some(found)

    def unary():
        nonlocal at
        word = words[at]
        at += 1
        if word == "not":
            return how.none(unary())
        if word == "(":
            out = either()
            at += 1
            return out
        if word in ("1", "all"):
            at += 2
            return group(words[at - 1], word == "all")
        return named[word]

    def both():
        nonlocal at
        parts = [unary()]
        while at < len(words) and words[at] == "and":
            at += 1
            parts.append(unary())
        return how.every(parts)

    def either():
        nonlocal at
        parts = [both()]
        while at < len(words) and words[at] == "or":
            at += 1
            parts.append(both())
        return how.some(parts)

    out = either()
    if at != len(words):
        raise ValueError(f"cannot read {rule['condition']!r}")
    return out


def selection(spec, mappings=None) -> Column:
    return _selected(spec, Columns(mappings))


def condition(rule: Mapping, mappings=None) -> Column:
    return _built(rule, Columns(mappings))


def scan_many(df: DataFrame, rules: Mapping[str, Mapping], mappings=None, batch: int = 64) -> tuple[DataFrame, dict[str, str]]:
    """The hits and errors of scan, for thousands of rules: an index from (field, value) to rules is joined with the events.

    Of a rule that needs one of some whole values only the events that have one are looked at, and it is compiled only if there are such
    events; a rule that needs no more than that is never compiled. Rules without such values are tested on all events, as in scan.
    """
    spark = df.sparkSession
    covers, errors, rest = {}, {}, {}
    for name, rule in rules.items():
        try:
            cover = _built(rule, Covers())
        except Exception as e:  # one bad rule does not stop the others
            errors[name] = str(e)
            continue
        (covers if cover.pairs else rest)[name] = cover
    out, more = scan(df, {n: rules[n] for n in rest}, mappings)
    errors |= more
    if not covers:
        return out, errors
    names = sorted(covers)
    index = spark.createDataFrame([(f, v, i, covers[n].whole) for i, n in enumerate(names) for f, v in sorted(covers[n].pairs)], "field string, val string, no int, whole boolean")
    fields = sorted({f for c in covers.values() for f, _ in c.pairs})
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(resolve(f, mappings)).alias("val")) for f in fields])
    pairs = df.select("event_id", F.explode(F.array_distinct(F.filter(cells, lambda c: c["val"] != ""))).alias("c")).select("event_id", "c.*")
    met = materialize(pairs.join(small(index), ["field", "val"]).select("event_id", "no", "whole").distinct(), "rule-candidates")
    titles = spark.createDataFrame(list(enumerate(names)), "no int, rule string")
    out = out.unionByName(met.where("whole").join(small(titles), "no").select("event_id", "rule"))
    asked = sorted(r.no for r in met.where("NOT whole").select("no").distinct().collect())  # rules, not events
    if not asked:
        return out, errors
    near = met.where("NOT whole").groupBy("event_id").agg(F.collect_set("no").alias("_rules"))
    wide = df.join(near, "event_id")
    wide = materialize(wide, "rule-events") if len(asked) > batch else wide
    for lo in range(0, len(asked), batch):
        part = {n: condition(rules[names[n]], mappings) for n in asked[lo : lo + batch]}
        found = F.array(*[F.when(F.array_contains("_rules", n) & c, F.lit(names[n])) for n, c in part.items()])
        out = out.unionByName(wide.select("event_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule")))
    return out, errors


def raw_fields(rule: Mapping, mappings=None) -> list[str]:
    """Fields that fell through to raw attribute keys."""
    out = set()
    for spec in rule["selections"].values():
        for part in spec if isinstance(spec, (list, tuple)) else [spec]:
            if isinstance(part, Mapping):
                out |= {k.split("|")[0] for k in part}
    return sorted(f for f in out if f not in TEXT_COLUMNS and not f.startswith(("attr:", "time:")) and f not in (mappings or {}))


def scan(df: DataFrame, rules: Mapping[str, Mapping], mappings=None) -> tuple[DataFrame, dict[str, str]]:
    """(event_id, rule) hits of all rules in one pass, and the rules that could not be read, with their errors."""
    tests, errors = {}, {}
    for name, rule in rules.items():
        try:
            tests[name] = condition(rule, mappings)
        except Exception as e:  # one bad rule does not stop the others
            errors[name] = str(e)
    if not tests:
        return df.sparkSession.createDataFrame([], "event_id string, rule string"), errors
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]), lambda x: x.isNotNull())
    return df.select("event_id", F.explode(found).alias("rule")), errors


def status(spark: SparkSession, df: DataFrame, rules: Mapping[str, Mapping], mappings=None) -> DataFrame:
    """(rule, status, n): matched, empty, error, or not_applicable where none of a rule's raw fields occurs."""
    hits, errors = scan(df, rules, mappings)
    counts = hits.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    keys = {r.key for r in df.select(F.explode(F.map_keys("attributes")).alias("key")).where(F.col("key").isin(*{f for r in rules.values() for f in raw_fields(r, mappings)})).distinct().collect()}  # the rules' own fields
    known = []
    for name, rule in rules.items():
        raw = raw_fields(rule, mappings)
        known.append((name, "error" if name in errors else "not_applicable" if raw and not keys & set(raw) else None))
    every = spark.createDataFrame(known, "rule string, fixed string")
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, "rule", "left").select("rule", F.coalesce("fixed", F.when(n > 0, "matched").otherwise("empty")).alias("status"), n.alias("n"))


def annotate(old: DataFrame, hits: DataFrame, ran: Iterable[str] | None = None) -> DataFrame:
    """System annotations (event_id, rule, confirmed) after a new run: confirmed ones stay, others of the rules run are replaced.

    ran: the names of the rules that were run (those that could be read); a rule without hits loses its old ones too. Without it only
    rules with hits count as run.
    """
    spark = old.sparkSession
    rules = spark.createDataFrame([(r,) for r in sorted(set(ran))], "rule string") if ran is not None else hits.select("rule").distinct()
    new = hits.select("event_id", "rule").distinct()
    kept = old.where("confirmed")
    fresh = new.join(kept.select("event_id", "rule"), ["event_id", "rule"], "left_anti").withColumn("confirmed", F.lit(False))
    other = old.where("NOT confirmed").join(small(rules), "rule", "left_anti")
    return kept.unionByName(fresh).unionByName(other.select(*kept.columns))
