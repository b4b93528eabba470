"""Counting, paging, field lists and field statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import TIME_FIELDS, effective_time, mapped, number, resolve
from ..functions.storage import materialize, same, small

#: Longest value that a value list may hold; keys and values of one source's statistics.
LONGEST_VALUE, MOST_KEYS, MOST_LISTED_KEYS, MOST_VALUES = 256, 5000, 200, 50


def newest_first(offsets: Mapping[str, float] | None = None, reverse: bool = False) -> list[Column]:
    """Order of the grid: undated rows first, then newest, ties by id."""
    ts = effective_time(offsets)
    return [ts.asc_nulls_last(), F.col("event_id").desc()] if reverse else [ts.desc_nulls_first(), F.col("event_id").asc()]


def page(df: DataFrame, limit: int, offsets: Mapping[str, float] | None = None, backwards: bool = False) -> DataFrame:
    """One page of a filtered table, and whether more rows follow; backwards reads up to a cursor and flips.

    The last page rows are found on thin rows first; only those are then joined back to whole events.
    """
    thin = df.select("event_id", "timestamp", "source_id").orderBy(*newest_first(offsets, backwards)).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*newest_first(offsets, backwards)))  # limit + 1 rows
    thin = thin.withColumn("place", place).withColumn("more", F.max("place").over(Window.partitionBy(F.lit(0))) > limit).where(F.col("place") <= limit)
    out = df.join(F.broadcast(thin.select("event_id", "place", "more")), "event_id")
    return out.orderBy(F.col("place").desc() if backwards else F.col("place"))


def hydrate(keys: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full rows of a few keys; keys whose event is gone are dropped."""
    return df.select("event_id", *columns).join(F.broadcast(keys), "event_id")


def time_range(df: DataFrame, offsets: Mapping[str, float] | None = None) -> DataFrame:
    ms = F.unix_millis(effective_time(offsets))
    return df.agg(F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms")).withColumn("middle_ms", F.floor((F.col("first_ms") + F.col("last_ms")) / 2))


def terms(df: DataFrame, field: str, limit: int = 50, mappings=None) -> DataFrame:
    """The most frequent values of a field, with totals of the full set: rows, distinct values, the rest."""
    counts = df.select(resolve(field, mappings).alias("value")).where("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n_distinct"))
    top = counts.orderBy(F.desc("n"), "value").limit(limit)
    shown = top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown"))
    return top.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(shown)).select("value", "n", "total", "n_distinct", (F.col("total") - F.col("shown")).alias("other"))  # one-row tables


def pairs(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """(source_id, event_id, key, val) of non-blank attributes, of all keys or the given ones."""
    m = F.map_filter("attributes", lambda k, v: (v.isNotNull()) & (v != "") & (k.isin(*keys) if keys is not None else F.lit(True)))
    return df.select("source_id", "event_id", "timestamp", F.explode(m).alias("key", "val"))


def list_fields(df: DataFrame, mappings: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Attribute keys without mapped raw ones, with the canonical fields."""
    raws = [r for v in (mappings or {}).values() for r in v]
    keys = df.select(F.explode(F.map_keys("attributes")).alias("field")).distinct()
    if not mappings:
        return keys
    names = df.sparkSession.createDataFrame([(c,) for c in mappings], "field string")
    return keys.where(~F.col("field").isin(*raws)).union(names).distinct()


def _first_by_hash(df: DataFrame, by: Sequence[str], cap: int) -> DataFrame:
    """(by..., attributes): the `cap` rows of each group whose ids have the smallest hash, ties by id.

    Rows are counted in 4,096 cells of hashes first. All rows of the cells before the one in which the cap is reached stay, only those
    of that cell are ranked, and rows of later cells are never shuffled.
    """
    h = F.coalesce(F.md5("event_id"), F.lit(""))
    rows = df.select(*by, "event_id", "attributes", h.alias("_h"), F.substring(h, 1, 3).alias("_cell"))
    up_to = F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = rows.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_up_to", up_to).where(F.col("_up_to") >= cap)
    edges = cells.groupBy(*by).agg(F.min(F.struct("_cell", (F.lit(cap) - F.col("_up_to") + F.col("_n")).alias("rest"))).alias("_edge"))
    edges = materialize(edges.select(*[F.col(c).alias(f"_e_{c}") for c in by], "_edge"), "sample-edges")
    rows = rows.join(small(edges), same(rows, edges, {c: f"_e_{c}" for c in by}), "left").where(F.col("_edge").isNull() | (F.col("_cell") <= F.col("_edge._cell")))
    rank = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy("_h", "event_id"))
    whole = F.col("_edge").isNull() | (F.col("_cell") < F.col("_edge._cell"))
    return rows.withColumn("_r", rank).where(whole | (F.col("_r") <= F.col("_edge.rest"))).select(*by, "attributes")


def field_coverage(df: DataFrame, cap: int = 10_000, samples: int = 3) -> DataFrame:
    """For each source and key: non-empty values among the source's first `cap` rows of smallest id hash, and samples."""
    each = _first_by_hash(df, ["source_id"], cap).select("source_id", F.explode(F.map_filter("attributes", lambda k, v: v != "")).alias("key", "val"))
    counts = each.groupBy("source_id", "key", "val").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source_id", "key").agg(F.sum("n").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("val")), 1, samples), "|").alias("samples"))


def distinct_tags(df: DataFrame) -> DataFrame:
    return df.select(F.explode("tags").alias("tag")).distinct()


def merged_tags(df: DataFrame, annotations: DataFrame, hits: DataFrame) -> DataFrame:
    """Parser, annotation and rule tags."""
    return distinct_tags(df).union(annotations.where("kind = 'tag'").select("value")).union(hits.select("label")).distinct()


def field_stats(df: DataFrame) -> DataFrame:
    """For each source and key: distinct values, coverage, sample, and the most frequent values as JSON-like text.

    Keys beyond MOST_KEYS by coverage are left out and flagged; value lists are made for MOST_LISTED_KEYS
    keys whose values are all of at most LONGEST_VALUE characters.
    """
    counts = pairs(df).groupBy("source_id", "key", "val").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.groupBy("source_id", "key").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("coverage"), F.max(F.length("val")).alias("longest"), F.min("val").alias("sample"))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("coverage"), "key"))
    keys = keys.withColumn("rank", rank).withColumn("capped", F.max("rank").over(Window.partitionBy("source_id")) > MOST_KEYS).where(F.col("rank") <= MOST_KEYS)
    listed = keys.where((F.col("rank") <= MOST_LISTED_KEYS) & (F.col("longest") <= LONGEST_VALUE)).select("source_id", "key")
    first = F.row_number().over(Window.partitionBy("source_id", "key").orderBy(F.desc("n"), "val"))
    top = counts.join(F.broadcast(listed) if listed.limit(100_001).count() <= 100_000 else listed, ["source_id", "key"]).withColumn("r", first).where(F.col("r") <= MOST_VALUES)
    top = top.groupBy("source_id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "val", "n"))), lambda x: F.concat(x["val"], F.lit("="), x["n"].cast("string"))), "|").alias("top_values"))
    return keys.join(top, ["source_id", "key"], "left").select("source_id", "key", "n_distinct", "coverage", "longest", "sample", "top_values", "capped")


def merge_field_stats(stats: DataFrame) -> DataFrame:
    """Across sources: coverage adds up; distinct is the largest of the sources', a lower bound."""
    return stats.groupBy("key").agg(F.sum("coverage").alias("coverage"), F.max("n_distinct").alias("n_distinct"), F.max("longest").alias("longest"), F.count(F.lit(1)).alias("n_sources"))


def viz_fields(stats: DataFrame) -> DataFrame:
    """Chartable fields: merged statistics by coverage, virtual time fields last."""
    own = merge_field_stats(stats).select(F.col("key").alias("field"), "coverage", "n_distinct", F.lit(0).alias("is_time"))
    times = stats.sparkSession.createDataFrame([(f"time:{t}",) for t in TIME_FIELDS], "field string")
    return own.unionByName(times.select("field", F.lit(0).cast("long").alias("coverage"), F.lit(0).cast("long").alias("n_distinct"), F.lit(1).alias("is_time")))


GUID = r"^\{?[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\}?$"
HASH = r"^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"


def classify_fields(df: DataFrame, sample: int = 2000) -> DataFrame:
    """For each artifact and key what its values are: empty, constant, guid, hash, numeric, id or text.

    A stable sample of rows of each artifact and source is read, by hash of the event id.
    """
    rows = _first_by_hash(df, ["artifact", "source_id"], sample).select("artifact", F.explode("attributes").alias("key", "val"))
    full = F.when(F.col("val") != "", F.col("val"))
    share = lambda p: F.avg(F.when(full.isNotNull(), full.rlike(p).cast("int")))
    stats = rows.groupBy("artifact", "key").agg(
        F.count(full).alias("n"), F.countDistinct(full).alias("n_distinct"), share(GUID).alias("guid"), share(HASH).alias("hash"), F.avg(F.when(full.isNotNull(), number(full).isNotNull().cast("int"))).alias("numeric"), F.avg(F.length(full)).alias("mean_length")
    )
    kind = (
        F.when(F.col("n") == 0, "empty").when(F.col("guid") >= 0.9, "guid").when(F.col("hash") >= 0.9, "hash").when(F.col("n_distinct") == 1, "constant").when(F.col("numeric") >= 0.9, "numeric")
        .when((F.col("n_distinct") >= 0.95 * F.col("n")) & (F.col("mean_length") < 40), "id").otherwise("text")
    )
    return stats.select("artifact", "key", "n", "n_distinct", kind.alias("kind"))


#: Words in a column's name that speak for showing it.
SHOWN_WORDS = ("user", "host", "ip", "status", "action", "method", "path", "uri", "url", "process", "command", "name", "port", "domain", "type", "level", "event")


def column_scores(stats: DataFrame, total: int, sources: int) -> DataFrame:
    """Ranks keys for the grid by breadth over sources (3), fill (2), cardinality (1) and name (1); unfit ones score 0.

    stats: (key, coverage, n_distinct, n_sources, mean_length). Constants, near-unique fields and long text are unfit.
    """
    fill = F.col("coverage") / F.lit(max(total, 1))
    breadth = F.col("n_sources") / F.lit(max(sources, 1))
    ratio = F.col("n_distinct") / F.col("coverage")
    cardinality = F.when(F.col("n_distinct") <= 1, 0.0).otherwise(F.lit(1.0) - ratio)
    named = F.when(F.col("key").rlike(f"(?i)({'|'.join(SHOWN_WORDS)})"), 1.0).otherwise(0.0)
    raw = (3 * breadth + 2 * fill + cardinality + named) / 7
    unfit = (F.col("n_distinct") <= 1) | (ratio >= 0.95) | (F.col("mean_length") > 120)
    score = F.round(F.when(unfit, 0.0).otherwise(raw), 6)
    return stats.select("key", score.alias("score"), (score >= 0.35).alias("shown"))


def describe_field(df: DataFrame, field: str, mappings=None) -> DataFrame:
    """One row about a field: whether it exists, values, distinct ones, numeric summary, a suggested scale."""
    value = resolve(field, mappings)
    x = number(F.col("v"))
    one = df.select(value.alias("v")).agg(
        F.count_if(F.col("v") != "").alias("n"), F.countDistinct(F.when(F.col("v") != "", F.col("v"))).alias("n_distinct"), F.count(x).alias("n_numeric"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.round(F.avg(x), 6).alias("mean")
    )
    numeric = (F.col("n_numeric") >= 0.9 * F.col("n")) & (F.col("n") > 0)
    scale = F.when(F.col("n") == 0, "none").when(numeric & (F.col("n_distinct") > 10), "linear").otherwise("category")
    return one.select((F.col("n") > 0).alias("found"), "n", "n_distinct", "n_numeric", "lo", "hi", "mean", scale.alias("scale"))


def derived_fields(df: DataFrame, mappings: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds canonical fields to attributes and lists those that were derived; stored keys are never overwritten."""
    made = F.array(*[F.struct(F.lit(c).alias("key"), mapped(c, raws).alias("value")) for c, raws in mappings.items()])
    stored = lambda k: attribute_of(k) != ""
    made = F.filter(made, lambda p: (p["value"] != "") & ~stored(p["key"]))
    return df.withColumn("_made", made).withColumns(
        {"derived": F.transform("_made", lambda p: p["key"]), "attributes": F.map_concat(F.map_filter("attributes", lambda k, v: ~F.array_contains(F.transform("_made", lambda p: p["key"]), k)), F.map_from_entries("_made"))}
    ).drop("_made")


def attribute_of(key: Column) -> Column:
    return F.coalesce(F.try_element_at("attributes", key), F.lit(""))


def keys_present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which of the given keys occur at all, by one aggregate."""
    one = df.agg(*[F.count_if(F.map_contains_key("attributes", k)).alias(k) for k in keys])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in keys])).alias("p")).select("p.key", "p.n").where("n > 0")


