"""Similarity of vectors: top-k by cosine, centroids, cohesion and transitive groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, zero, or of another length."""
    n = norm(a) * norm(b)
    return F.when((n > 0) & (F.size(a) == F.size(b)), dot(a, b) / n)


def nearest_to_vector(df: DataFrame, vector: Sequence[float], k: int = 10) -> DataFrame:
    """(vec_id, score): the k rows of df (vec_id, embedding) nearest to a given vector."""
    anchor = F.array(*[F.lit(float(x)) for x in vector])
    scored = df.select("vec_id", F.round(cosine(F.col("embedding"), anchor), 6).alias("score")).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def nearest_to_event(df: DataFrame, vec_id: int, k: int = 10) -> tuple[str, DataFrame | None]:
    """A status and the k rows nearest to one row's vector, itself left out."""
    own = df.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("anchor"))
    first = own.first()
    if first is None:
        return "vector_not_found", None
    if not first.anchor:
        return "not_embedded", None
    return "ok", nearest_to_vector(df.where(F.col("vec_id") != vec_id), first.anchor, k)


def embedding_text(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """(event_id, text): chosen attributes, or all, as key=value, with the tags; keys and tags sorted."""
    entries = F.filter(F.map_entries("attributes"), lambda e: (e["value"] != "") & (e["key"].isin(*fields) if fields else F.lit(True)))
    own = F.transform(F.array_sort(entries), lambda e: F.concat_ws("=", e["key"], e["value"]))
    parts = F.concat(F.array(F.concat(F.lit("message="), "message"), F.concat(F.lit("artifact="), "artifact")), own, F.transform(F.array_sort("tags"), lambda t: F.concat(F.lit("tag="), t)))
    return df.select("event_id", F.array_join(parts, " | ").alias("text"))


def centroids(df: DataFrame, group: str) -> DataFrame:
    """(group, centroid): length-one mean vectors; the means of positions are partial aggregates."""
    each = df.select(group, F.posexplode("embedding").alias("at", "x")).groupBy(group, "at").agg(F.avg("x").alias("x"))
    whole = each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    return whole.withColumn("n", norm(F.col("mean"))).where("n > 0").select(group, F.transform("mean", lambda x: x / F.col("n")).alias("centroid"))


#: Centroids to which all angles are measured first.
PIVOTS = 8


def near_pairs(centers: DataFrame, group: str, least: float) -> DataFrame:
    """(a, b, u, v): pairs of centroids, each once, whose angles to all pivots differ by no more than the angle of cosine `least`.

    By the triangle inequality no other pair can be as near, so only these need a dot product. Centroids meet by an equi-join on bands of the
    angle to the pivot that spreads them most, neighbouring bands too; bands are dealt to blocks, so neither side is broadcast and no band is
    one task's.
    """
    n = F.nullif(norm(F.col("centroid")), F.lit(0.0))
    unit = centers.select(F.col(group).alias("g"), F.transform("centroid", lambda x: x.cast("double") / n).alias("u")).where("u IS NOT NULL AND NOT exists(u, x -> x IS NULL OR isnan(x))")
    pivots = [r.u for r in unit.orderBy(F.xxhash64("g"), "g").limit(PIVOTS).collect()]  # a fixed number of vectors
    if not pivots:
        return unit.select(F.col("g").alias("a"), F.col("g").alias("b"), "u", F.col("u").alias("v")).where("false")
    fixed = centers.sparkSession.createDataFrame([(pivots,)], "pivots array<array<double>>")
    angle = lambda p: F.acos(F.greatest(F.least(dot(F.col("u"), p), F.lit(1.0)), F.lit(-1.0)))
    rows = materialize(unit.crossJoin(F.broadcast(fixed)).select("g", "u", F.transform("pivots", angle).alias("angles")), "pivot-angles")  # one row of pivots
    width = math.acos(max(-1.0, min(1.0, least))) + 1e-7
    count, *spread = rows.agg(F.count(F.lit(1)), *[F.coalesce(F.stddev_pop(F.get("angles", i)), F.lit(0.0)) for i in range(len(pivots))]).first()
    first = max(range(len(pivots)), key=lambda i: spread[i])
    blocks = max(1, int((count / 256) ** 0.5))  # as many pairs of blocks as tasks of 256 x 256 centroids or so ask for
    rows = rows.withColumns({"band": F.floor(F.get("angles", first) / width), "block": F.pmod(F.xxhash64("g"), F.lit(blocks))})
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    a = rows.select(F.col("g").alias("a"), "u", F.col("angles").alias("p"), F.col("block").alias("i"), others.alias("j"), "band")
    b = rows.select(F.col("g").alias("b"), F.col("u").alias("v"), F.col("angles").alias("q"), F.col("block").alias("j"), others.alias("i"), "band")
    b = b.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    met = a.join(b, ["i", "j", "band"]).where(F.col("a") < F.col("b"))
    return met.where(F.forall(F.zip_with("p", "q", lambda x, y: F.abs(x - y) <= width), lambda x: x)).select("a", "b", "u", "v")


def cohesion(centers: DataFrame, group: str) -> DataFrame:
    """One row: the mean cosine of all pairs of centroids (a row a group) and what that says.

    Unit vectors u of n groups have pairs with a sum of cosines of (|sum of u|^2 - n) / 2, so sums of positions are enough, no pairs are made.
    """
    n = F.nullif(norm(F.col("centroid")), F.lit(0.0))
    unit = centers.select(group, F.transform("centroid", lambda x: x.cast("double") / n).alias("u")).where("u IS NOT NULL AND NOT exists(u, x -> x IS NULL OR isnan(x))")
    sums = unit.select(F.posexplode("u").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    square = sums.agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    count = unit.agg(F.count(F.lit(1)).alias("n"))
    pairs = F.expr("n * (n - 1) div 2")
    mean = F.round((F.col("square") - F.col("n")) / (2 * pairs), 6)
    one = square.crossJoin(F.broadcast(count)).select(F.when(pairs > 0, mean).alias("cohesion"), pairs.alias("pairs"))  # one row each
    return one.withColumn("level", F.when(F.col("cohesion") >= 0.7, "strong").when(F.col("cohesion") >= 0.5, "moderate").otherwise("weak"))


def groups(centers: DataFrame, group: str, least: float = 0.6) -> DataFrame:
    """(group, root): transitive groups of centroids with cosine >= least; labels spread until nothing changes.

    In every round each group takes the smallest label of its neighbours, and then that label's own label, so
    chains end in logarithmically many rounds.
    """
    once = near_pairs(centers, group, least).where(cosine(F.col("u"), F.col("v")) >= least).select("a", "b")
    once = materialize(once, "similar-pairs")
    links = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(centers.select(F.col(group).alias("b"), F.col(group).alias("root")), "similar-labels")
    while True:
        near = links.join(labels, "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["b"] == near["a"], "left").select("b", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("was"))
        jump = labels.select(F.col("b").alias("root"), F.col("root").alias("next"))
        new = materialize(lower.join(jump, "root").select("b", F.least("root", "next").alias("root"), "was"), "similar-labels")
        if new.where("root <> was").isEmpty():
            return new.select(F.col("b").alias(group), "root")
        labels = new.select("b", "root")
