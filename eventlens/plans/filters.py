"""EventQuery: one value that describes a filter, and `where`, which turns it into one predicate and id joins."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import SEARCHED, effective_time, resolve, template, text_of

MODES = ("exact", "wildcard", "regex", "empty")
#: Id tables of at most so many rows are broadcast.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Condition:
    """A field and its values (any may match); mode `empty` takes none."""

    field: str
    values: tuple[str, ...] = ()
    mode: str = "exact"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.mode == "regex":
            for v in self.values:
                java_regex(v)


@dataclass(frozen=True)
class TagFilter:
    """Rows with a parser tag, an annotation tag or a rule hit of one of these names, or (annotated) any annotation."""

    names: tuple[str, ...] = ()
    annotated: bool = False
    negate: bool = False


@dataclass(frozen=True)
class EventQuery:
    case_id: str | None = None
    source_ids: tuple[str, ...] | None = None
    text: str | None = None
    text_regex: bool = False
    artifact: str | None = None
    artifacts: tuple[str, ...] = ()
    tag: str | None = None
    tag_not: str | None = None
    start: str | None = None
    end: str | None = None
    include: tuple[Condition, ...] = ()
    exclude: tuple[Condition, ...] = ()
    muted_templates: tuple[str, ...] = ()
    mappings: Mapping[str, Sequence[str]] = field(default_factory=dict)
    offsets: Mapping[str, float] = field(default_factory=dict)
    after: tuple[str | None, str] | None = None
    before: tuple[str | None, str] | None = None


def java_regex(pattern: str) -> str:
    """Named groups in Java's spelling; refuses what is no regular expression."""
    re.compile(pattern)
    return pattern.replace("(?P<", "(?<")


def like_escape(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def glob_like(pattern: str) -> str:
    """`*` and `?` as LIKE wildcards, all else literal."""
    return like_escape(pattern).replace("*", "%").replace("?", "_")


def text_match(text: str, regex: bool = False) -> Column:
    """Substring (case-insensitive) or regular expression in the searched columns, any tag or any attribute value."""
    test = (lambda c: c.rlike(java_regex(text))) if regex else (lambda c: c.ilike(f"%{like_escape(text)}%"))
    columns = reduce(lambda a, b: a | b, [test(text_of(F.col(c))) for c in SEARCHED])
    return columns | F.exists("tags", test) | F.exists(F.map_values("attributes"), test)


def condition(c: Condition, q: EventQuery) -> Column:
    value = resolve(c.field, q.mappings, q.offsets)
    if c.mode == "empty":
        return value == ""
    if c.mode == "exact":
        return value.isin(*c.values)
    tests = [value.ilike(glob_like(v)) if c.mode == "wildcard" else value.rlike(java_regex(v)) for v in c.values]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def cursor(ts: Column, at: tuple[str | None, str], newer: bool) -> Column:
    """Rows behind (or before) a position in the order newest first, undated rows on top, ties by id."""
    when, event_id = at
    if when is None:
        same = ts.isNull()
        return (same & (F.col("event_id") < event_id)) if newer else (ts.isNotNull() | (same & (F.col("event_id") > event_id)))
    t = F.lit(when).cast("timestamp")
    if newer:
        return ts.isNull() | ((ts >= t) & ((ts > t) | (F.col("event_id") < event_id)))
    return (ts <= t) & ((ts < t) | (F.col("event_id") > event_id))


def predicate(q: EventQuery) -> Column:
    """All of a query that one row decides; a plain time bound goes with it, so that scans can skip by it."""
    ts = effective_time(q.offsets)
    parts = [F.lit(True)]
    if q.case_id is not None:
        parts.append(F.col("case_id") == q.case_id)
    if q.source_ids is not None:
        parts.append(F.col("source_id").isin(*q.source_ids))
    if q.text:
        parts.append(text_match(q.text, q.text_regex))
    if kinds := [*([q.artifact] if q.artifact else []), *q.artifacts]:
        parts.append(F.col("artifact").isin(*kinds))
    if q.tag:
        parts.append(F.array_contains("tags", q.tag))
    if q.tag_not:
        parts.append(~F.array_contains("tags", q.tag_not))
    shifts = [0.0, *q.offsets.values()]
    for bound, late in ((q.start, False), (q.end, True)):
        if bound is not None:
            t = F.lit(bound).cast("timestamp")
            parts.append(F.coalesce(ts <= t if late else ts >= t, F.lit(False)))
            if q.offsets:  # widened by the largest shift: the raw column's statistics can be used
                wide = F.timestamp_millis(F.unix_millis(t) - int(1000 * (min(shifts) if late else max(shifts))))
                parts.append(F.col("timestamp") <= wide if late else F.col("timestamp") >= wide)
    parts += [condition(c, q) for c in q.include]
    parts += [~condition(c, q) for c in q.exclude]
    if q.muted_templates:
        parts.append(~template(F.col("message")).isin(*q.muted_templates))
    if q.after:
        parts.append(cursor(ts, q.after, newer=False))
    if q.before:
        parts.append(cursor(ts, q.before, newer=True))
    return reduce(lambda a, b: a & b, parts)


def _ids(ids: DataFrame) -> DataFrame:
    out = ids.select("event_id").distinct()
    return F.broadcast(out) if out.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else out


def where(df: DataFrame, q: EventQuery, ids: DataFrame | None = None, not_ids: DataFrame | None = None, routine: DataFrame | None = None) -> DataFrame:
    """Rows of df that match q, with event_id in ids, not in not_ids, and not members of routine motifs."""
    out = df.where(predicate(q))
    if ids is not None:
        out = out.join(_ids(ids), "event_id", "left_semi")
    for gone in (not_ids, routine):
        if gone is not None:
            out = out.join(_ids(gone), "event_id", "left_anti")
    return out


def by_tags(df: DataFrame, t: TagFilter, annotations: DataFrame, hits: DataFrame) -> DataFrame:
    """annotations: (event_id, kind, value); hits: (event_id, label). Negation takes the rest of the rows."""
    found = annotations.where(F.col("value").isin(*t.names) & (F.col("kind") == "tag")).select("event_id")
    found = found.unionByName(hits.where(F.col("label").isin(*t.names)).select("event_id"))
    if t.annotated:
        found = found.unionByName(annotations.select("event_id"))
    own = F.arrays_overlap("tags", F.array(*map(F.lit, t.names))) if t.names else F.lit(False)
    flagged = df.join(_ids(found).withColumn("_marked", F.lit(True)), "event_id", "left")
    keep = own | F.coalesce("_marked", F.lit(False))
    return flagged.where(~keep if t.negate else keep).drop("_marked")


def annotated_ids(annotations: DataFrame, run: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Ids with a tag or anomaly annotation or in a detector run, intersected with an id list."""
    out = annotations.where(F.col("kind").isin("tag", "anomaly")).select("event_id").union(run.select("event_id")).distinct()
    return out if allowed is None else out.intersect(allowed.select("event_id"))


def collapsed_count(df: DataFrame, routine: DataFrame, muted: Sequence[str]) -> DataFrame:
    """How many events either mechanism hides, each counted once."""
    by_motif = df.join(_ids(routine), "event_id", "left_semi").select("event_id")
    by_template = df.where(template(F.col("message")).isin(*muted)).select("event_id")
    return by_motif.unionByName(by_template).agg(F.countDistinct("event_id").alias("n"))


def motif_count(routine: DataFrame, motifs: Sequence[str], source_ids: Sequence[str] | None = None) -> DataFrame:
    """Distinct member events of the given motifs."""
    own = routine.where(F.col("motif").isin(*motifs))
    if source_ids is not None:
        own = own.where(F.col("source_id").isin(*source_ids))
    return own.agg(F.countDistinct("event_id").alias("n"))
