"""Detectors: what stands out in values, ranges, characters, shares, rhythm, distributions, volume and order.

Every detector aggregates in one pass over an unpivot of the fields it reads, so the heavy part is a partial
aggregate on executors; tests and ranking run on the much smaller candidate tables. Findings carry the count,
the score and an event id that represents them (the earliest, ties by id); events are attached after ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import number, resolve, template
from ..functions.ranks import cumulative, quantiles
from ..functions.storage import materialize, same, small, stretches, with_rows_before
from ..functions.stats import benjamini_hochberg, chi2_p, g_2x2, ks_p_column, normal_p
from ..plans.windows import AnalysisWindows
from .charts import one_row

RARE, PER_FIELD = 3, 25
LEAST_NUMBERS, LEAST_VALUES, LEAST_LENGTH, MOST_CHARACTERS = 20, 20, 6, 5000
FDR, LEAST_RATIO = 0.05, 2.0
#: Finest pieces of time that busy stretches are cut into, in milliseconds.
CELL_MS = 10
SEPARATOR = "\x1f"


def values(df: DataFrame, fields: Sequence[str], mappings=None, windows: AnalysisWindows | None = None, group: Column | None = None) -> DataFrame:
    """(field, val, event_id, source_id, ts[, grp][, base, labels, label]) of non-blank values: one unpivot for all fields."""
    keep = ["event_id", "source_id", F.col("timestamp").alias("ts")] + ([group.alias("grp")] if group is not None else [])
    if windows:
        ts = F.col("timestamp")
        keep += [windows.baseline.holds(ts).alias("base"), windows.all_labels(ts).alias("labels"), windows.first_label(ts).alias("label")]
        df = df.where(windows.any(ts))
    each = F.array(*[F.struct(F.lit(f).alias("field"), resolve(f, mappings).alias("val")) for f in fields])
    return df.select(*keep, F.explode(F.filter(each, lambda p: p["val"] != "")).alias("p")).select("p.*", "event_id", "source_id", "ts", *(["grp"] if group is not None else []), *(["base", "labels", "label"] if windows else []))


def first_event() -> Column:
    """The earliest event of a group; undated ones last, ties by id."""
    return F.min(F.struct(F.col("ts").isNull().alias("undated"), "ts", "event_id"))["event_id"]


def window_totals(df: DataFrame, windows: AnalysisWindows) -> DataFrame:
    """(label, total, small): dated events of the baseline and of each suspect window; small: under 50."""
    ts = F.col("timestamp")
    labels = F.concat(F.when(windows.baseline.holds(ts), F.array(F.lit(windows.baseline.label))).otherwise(F.array().cast("array<string>")), windows.all_labels(ts))
    counts = df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("total"))
    every = df.sparkSession.createDataFrame([(w.label,) for w in (windows.baseline, *windows.suspects)], "label string")
    return every.join(counts, "label", "left").select("label", F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("total", F.lit(0)) < 50).alias("small"))


def _surprise(n: Column, total: Column) -> Column:
    return F.round(-F.log(n / total), 4) + 0.0


def _per_field(df: DataFrame, most: int = PER_FIELD) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("score"), "value", *(["label"] if "label" in df.columns else [])))
    return df.withColumn("_r", r).where(F.col("_r") <= most).drop("_r")


def _novelty(rows: DataFrame, df: DataFrame, windows: AnalysisWindows | None, most: int) -> DataFrame:
    if windows is None:
        total = one_row(df.agg(F.count(F.lit(1)).alias("total")))
        seen = rows.groupBy("field", "val").agg(F.count(F.lit(1)).alias("n"), first_event().alias("event_id")).where(F.col("n") <= RARE)
        out = seen.crossJoin(total).select("field", F.col("val").alias("value"), "n", _surprise(F.col("n"), F.col("total")).alias("score"), "event_id")
        return _per_field(out, most)
    totals = F.broadcast(window_totals(df, windows))
    known = rows.groupBy("field", "val").agg(F.count_if("base").alias("known")).where("known = 0").select("field", "val")
    inside = rows.where(F.size("labels") > 0).select("field", "val", "event_id", "ts", F.explode("labels").alias("label"))
    seen = inside.groupBy("field", "val", "label").agg(F.count(F.lit(1)).alias("n"), first_event().alias("event_id"))
    out = seen.join(known, ["field", "val"]).join(totals, "label").select("field", F.col("val").alias("value"), "label", "n", _surprise(F.col("n"), F.col("total")).alias("score"), "event_id")
    return _per_field(out, most)


def value_novelty(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None = None, mappings=None, most: int = PER_FIELD) -> DataFrame:
    """Rare values (undated rows count too), or values of a suspect window that the baseline lacks."""
    return _novelty(values(df, fields, mappings, windows), df, windows, most)


def value_combos(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None = None, most: int = PER_FIELD) -> DataFrame:
    """The same over tuples of fields, all of them present."""
    parts = [resolve(f) for f in fields]
    full = df.withColumn("_combo", F.concat_ws(SEPARATOR, *parts))
    for p in parts:
        full = full.where(p != "")
    rows = full.withColumn("attributes", F.create_map(F.lit("_combo"), F.col("_combo"))).drop("_combo")
    rows = values(rows, ["attr:_combo"], None, windows).withColumn("field", F.lit(",".join(fields)))
    return _novelty(rows, df, windows, most)


def _fences(rows: DataFrame, x: str) -> DataFrame:
    """(field, known, lo, hi): Tukey's fences of each field."""
    known = rows.groupBy("field").agg(F.count(x).alias("known"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return known.join(F.broadcast(quantiles(rows, ["field"], x, (0.25, 0.75))), "field").select("field", "known", (q1 - 1.5 * (q3 - q1)).alias("lo"), (q3 + 1.5 * (q3 - q1)).alias("hi"))  # a row a field


def numeric_range(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None = None) -> DataFrame:
    """Numbers beyond Tukey's fences of their field, or beyond the baseline's extremes; score: excess by band width."""
    rows = values(df, fields, None, windows).withColumn("x", number(F.col("val"), finite=False)).where("x IS NOT NULL")
    if windows is None:
        rows = materialize(rows.select("field", "x", "ts", "event_id"), "ranged-numbers")  # read three times
        band = _fences(rows, "x")
        by = ["field", "x"]
    else:
        band = rows.where("base").groupBy("field").agg(F.count(F.lit(1)).alias("known"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        rows, by = rows.where("label IS NOT NULL"), ["field", "x", "label"]
    out = rows.join(F.broadcast(band.where(F.col("known") >= LEAST_NUMBERS)), "field").where("x < lo OR x > hi")  # a row a field
    seen = out.groupBy(*by, "lo", "hi").agg(F.count(F.lit(1)).alias("n"), first_event().alias("event_id"))
    excess = F.greatest(F.col("lo") - F.col("x"), F.col("x") - F.col("hi"))
    return seen.withColumn("score", F.round(excess / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)), 4))


def _characters(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.select(*by, F.explode(F.split("chars", "")).alias("c")).where("c <> ''")


def charset_novelty(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None = None, group: str | None = None) -> DataFrame:
    """Values with characters outside the reference alphabet of their field, or of their group in a field.

    Without windows: characters in at most RARE distinct values are outside; score sums -ln(share). With
    windows: characters that the baseline lacks; each scores ln(n + 1). An alphabet needs LEAST_VALUES distinct
    values and may have MOST_CHARACTERS characters. With a group field every group value has its own alphabet:
    groups with too many characters are left out, those with too few values are measured by a fallback
    alphabet, of the rows outside the suspect windows or of the whole scope. `basis` says which was used.
    """
    return charset_findings(df, fields, charset_basis(df, fields, windows, group), windows, group)


GROUP = ["field", "grp"]


def charset_basis(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None = None, group: str | None = None) -> DataFrame:
    """Distinct values with their counts, written once; all alphabets come from them: (field, grp, key, chars, label, n, known, event_id).

    A value of any length is told by its digest (key) and its distinct characters as text (chars), both made where it is read: values themselves are
    shuffled only where they are findings.
    """
    rows = values(df, fields, None, windows, resolve(group) if group else F.lit(""))
    if windows is None:
        rows = rows.withColumns({"label": F.lit(None).cast("string"), "base": F.lit(True)})
    distinct = F.array_join(F.array_sort(F.array_distinct(F.split("val", ""))), "")
    rows = rows.select(*GROUP, F.sha2("val", 256).alias("key"), distinct.alias("chars"), "label", "base", "ts", "event_id")
    counts = rows.groupBy(*GROUP, "key", "chars", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if("base").alias("known"), first_event().alias("event_id"))
    return materialize(counts, "charset-values")


def _alphabets(basis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, grp, c, n_c) and (field, grp, n_vals, size, state) of the values that alphabets are learnt from."""
    learned = basis.where("known > 0").select(*GROUP, "key", "chars").distinct()
    sizes = learned.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_vals"))
    chars = materialize(_characters(learned, GROUP).groupBy(*GROUP, "c").agg(F.count(F.lit(1)).alias("n_c")), "charset-characters")
    alphabet = chars.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size"))
    state = F.when(F.col("size") > MOST_CHARACTERS, "wide").when(F.col("n_vals") < LEAST_VALUES, "thin").otherwise("own")
    return chars, sizes.join(alphabet, GROUP).withColumn("state", state)


def _fallback(basis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The values that fallback alphabets are learnt from (outside the suspect windows), and how many a field has."""
    outside = basis.where("label IS NULL").select("field", "key", "chars").distinct()
    return outside, outside.groupBy("field").agg(F.count(F.lit(1)).alias("n_back"))


def charset_states(basis: DataFrame, group: str | None = None) -> DataFrame:
    """(field, grp, n_vals, size, state, measured): each group to be measured, its alphabet's state, and by which one it is measured: own, fallback or none."""
    _, ready = _alphabets(basis)
    asked = basis.where("label IS NOT NULL OR known > 0").select(*GROUP).distinct()
    _, n_back = _fallback(basis)
    out = asked.join(ready, GROUP, "left").withColumn("state", F.coalesce("state", F.lit("absent"))).join(n_back, "field", "left")
    back = F.lit(group is not None) & F.col("state").isin("thin", "absent") & (F.coalesce("n_back", F.lit(0)) >= LEAST_VALUES)
    return out.select(*GROUP, "n_vals", "size", "state", F.when(F.col("state") == "own", "own").when(back, "fallback").otherwise("none").alias("measured"))


def _outside(scored: DataFrame, alphabet: DataFrame, by: Sequence[str], rare: bool) -> DataFrame:
    """scored, a row for each character outside the alphabet (by, c, n_c), with its n_c: null if the alphabet lacks it; with rare, those of at most RARE values too."""
    each = scored.withColumn("c", F.explode(F.split("chars", ""))).where("c <> ''").drop("chars")
    # Alphabets are few rows a group, so no value's characters are shuffled; beyond a broadcast they are, without its text.
    return each.join(small(alphabet), [*by, "c"], "left").where(F.col("n_c").isNull() | (F.lit(rare) & (F.col("n_c") <= RARE)))


def charset_findings(df: DataFrame, fields: Sequence[str], basis: DataFrame, windows: AnalysisWindows | None = None, group: str | None = None) -> DataFrame:
    """The findings of charset_novelty from the basis of df; df is read again for the values that are findings."""
    by = GROUP
    chars, ready = _alphabets(basis)
    scored = basis.where("label IS NOT NULL") if windows else basis
    scored = scored.select(*by, "key", "chars", *(["label"] if windows else []), "n", "event_id")
    scored = scored.join(small(ready.select(*by, "n_vals", "state")), by, "left").withColumn("state", F.coalesce("state", F.lit("absent")))
    found = _outside(scored.where("state = 'own'"), chars, by, not windows).withColumn("basis", F.lit("own"))
    if group:
        # Fallback alphabets hold one row for each field and character.
        outside, n_back = _fallback(basis)
        back = materialize(_characters(outside, ["field"]).groupBy("field", "c").agg(F.count(F.lit(1)).alias("n_c")), "charset-fallback")
        rest = scored.where("state IN ('thin', 'absent')").join(F.broadcast(n_back), "field").where(F.col("n_back") >= LEAST_VALUES).withColumn("n_vals", F.col("n_back")).drop("n_back")  # a row a field
        found = found.unionByName(_outside(rest, back, ["field"], True).withColumn("basis", F.lit("fallback")))
    score = F.when(F.col("n_c").isNull(), F.log(F.col("n_vals") + 1)).otherwise(-F.log(F.col("n_c") / F.col("n_vals")))
    keys = [*by, "key", "n", "event_id", "basis", *(["label"] if windows else [])]
    found = materialize(found.groupBy(*keys).agg(F.round(F.sum(score), 4).alias("score"), F.array_join(F.array_sort(F.collect_set("c")), "").alias("chars")), "charset-found")
    own = values(df, fields, None, windows).select("field", F.sha2("val", 256).alias("key"), "event_id", "val")
    # Each finding's value stands in the event that represents it.
    sought = found.select(*[F.col(c).alias(f"_s_{c}") for c in ("field", "key", "event_id")]).distinct()
    own = own.join(small(sought), same(own, sought, {c: f"_s_{c}" for c in ("field", "key", "event_id")}), "left_semi").groupBy("field", "key").agg(F.min("val").alias("val"))
    out = found.join(own, ["field", "key"])
    return out.select(*by, "val", *[c for c in found.columns if c not in (*by, "key")])


def entropy_of_values(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., val, bits): Shannon bits of the characters of distinct values long enough."""
    distinct = rows.select(*by, "val").distinct().where(F.length("val") >= LEAST_LENGTH)
    each = distinct.select(*by, "val", F.explode(F.filter(F.split("val", ""), lambda c: c != "")).alias("c"))
    counts = each.groupBy(*by, "val", "c").agg(F.count(F.lit(1)).alias("k")).withColumn("p", F.col("k") / F.length("val"))
    return counts.groupBy(*by, "val").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 9).alias("bits"))


def entropy_outliers(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None = None) -> DataFrame:
    """Values whose entropy is beyond Tukey's fences of the distinct values of their field (or of its baseline)."""
    return entropy_parts(df, fields, windows)[0]


def entropy_parts(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None = None) -> tuple[DataFrame, DataFrame]:
    """The findings of entropy_outliers, and (field, known): how many values each field's fences rest on."""
    rows = values(df, fields, None, windows)
    bits = materialize(entropy_of_values(rows, ["field"]), "entropy-bits")
    base = bits.join(rows.where("base").select("field", "val").distinct(), ["field", "val"], "left_semi") if windows else bits
    fences = materialize(_fences(base, "bits"), "entropy-fences")
    band = fences.where(F.col("known") >= LEAST_VALUES).drop("known")
    out = bits.join(F.broadcast(band), "field").where("bits < lo OR bits > hi")  # a row a field
    where = rows.where("label IS NOT NULL") if windows else rows
    by = ["field", "val", *(["label"] if windows else [])]
    seen = where.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), first_event().alias("event_id"))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))
    excess = F.greatest(F.col("lo") - F.col("bits"), F.col("bits") - F.col("hi"))
    found = seen.join(out, ["field", "val"]).select(*by, "n", "event_id", F.round("bits", 6).alias("bits"), F.when(F.col("bits") > F.col("hi"), "above").otherwise("below").alias("direction"), F.round(excess / width, 4).alias("score"))
    return found, fences.select("field", "known")


def _label_totals(df: DataFrame, windows: AnalysisWindows) -> tuple[DataFrame, DataFrame]:
    totals = window_totals(df, windows)
    base = totals.where(F.col("label") == windows.baseline.label).select(F.col("total").alias("n_b"))
    return one_row(base), F.broadcast(totals.where(F.col("label") != windows.baseline.label).select("label", F.col("total").alias("n_w")))


def shift_candidates(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows, most: int | None = None) -> DataFrame:
    """(field, val, label, a, n_b, c, n_w, g): shares of baseline values in the baseline and in each window; with most, of a field's most frequent values only."""
    rows = values(df, fields, None, windows)
    counts = rows.groupBy("field", "val").agg(F.count_if("base").alias("a"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("labels", w.label)).alias(f"w{i}") for i, w in enumerate(windows.suspects)]).where("a > 0")
    if most is not None:
        top = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "val"))
        counts = counts.withColumn("_r", top).where(F.col("_r") <= most)
    each = counts.select("field", "val", "a", F.explode(F.array(*[F.struct(F.lit(w.label).alias("label"), F.col(f"w{i}").alias("c")) for i, w in enumerate(windows.suspects)])).alias("p")).select("field", "val", "a", "p.*")
    base, totals = _label_totals(df, windows)
    each = each.crossJoin(base).join(totals, "label").where("n_w > 0")
    return each.withColumn("g", g_2x2(F.col("a"), F.col("n_b"), F.col("c"), F.col("n_w")))


def proportion_shift(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows, fdr: float = FDR, ratio: float = LEAST_RATIO, most: int | None = None) -> DataFrame:
    """Values whose share changed: G-tests, one false-discovery pool, and an effect floor on the ratio of shares. All values are tested, or the `most` frequent of each field."""
    tests = shift_candidates(df, fields, windows, most).withColumn("p", chi2_p(F.col("g"), F.lit(1.0)))
    tests = benjamini_hochberg(tests)
    share_w = F.when(F.col("c") > 0, F.col("c")).otherwise(0.5) / F.col("n_w")
    tests = tests.withColumn("ratio", share_w / (F.col("a") / F.col("n_b")))
    found = tests.where((F.col("q") <= fdr) & ((F.col("ratio") >= ratio) | (F.col("ratio") <= 1 / ratio)))
    return found.select("field", F.col("val").alias("value"), "label", F.col("c").alias("n"), F.round("ratio", 4).alias("ratio"), F.when(F.col("ratio") > 1, "up").otherwise("down").alias("direction"), F.round("g", 4).alias("score"), "q")


def arrival_gaps(df: DataFrame, field: str, windows: AnalysisWindows, medians: bool = True) -> DataFrame:
    """(val, label, n, k, mean, sd, cv, median, span, sum2) of seconds between arrivals in each window; medians, which need all gaps ranked, only if asked for."""
    rows = values(df, [field], None, windows)
    labels = F.concat(F.when(F.col("base"), F.array(F.lit(windows.baseline.label))).otherwise(F.array().cast("array<string>")), "labels")
    rows = rows.select("val", "event_id", F.unix_millis("ts").alias("ms"), F.explode(labels).alias("label"))
    rows = _gaps(rows, ["val", "label"], "ms", "event_id")
    out = rows.groupBy("val", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count("gap").alias("k"), F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("sd"), ((F.max("ms") - F.min("ms")) / 1000).alias("span"), F.sum(F.col("gap") * F.col("gap")).alias("sum2")
    )
    if medians:
        out = out.join(_medians(rows, ["val", "label"]), ["val", "label"], "left")
    return out.withColumn("cv", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")))


def _gaps(rows: DataFrame, by: list[str], ms: str, tie: str) -> DataFrame:
    """rows with `gap`: seconds since the row before in each group. Groups are cut into days, and busy days into parts, that see the row before them."""
    rows = stretches(rows.withColumn("_day", F.floor(F.col(ms) / 86_400_000)), by, "_day", F.floor(F.col(ms) / CELL_MS))
    rows = with_rows_before(rows, by, "_day", [ms, tie], 1)
    gap = (F.col(ms) - F.lag(ms).over(Window.partitionBy(*by, "_day").orderBy(ms, tie))) / 1000
    return materialize(rows.withColumn("gap", gap).where(~F.col("_carried")).drop("_carried", "_day"), "gaps")


def _medians(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., median) of gaps."""
    found = quantiles(rows.where("gap IS NOT NULL"), by, "gap", (0.5,))
    return found.select(*by, F.col("q")[0].alias("median"))


def interval_periodicity(df: DataFrame, field: str, windows: AnalysisWindows, fdr: float = FDR, least_gaps: int = 5, beacon_gaps: int = 10, regular: float = 0.5, irregular: float = 0.8, beacon_cv: float = 0.3, beacon_span: float = 0.5, ratio: float = LEAST_RATIO) -> DataFrame:
    """Arrival rhythm: regular values that went missing or sped up, and new regularity of bursty or sparse ones."""
    gaps = materialize(arrival_gaps(df, field, windows, medians=False), "arrival-gaps")  # read three times
    names = ["n", "k", "mean", "cv", "span", "sum2"]
    base = gaps.where(F.col("label") == windows.baseline.label).select("val", *[F.col(c).alias(f"b_{c}") for c in names])
    seconds = df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(w.label).alias("label"), w.seconds.alias("d_w")) for w in windows.suspects])).alias("p")).select("p.*").withColumn("d_b", windows.baseline.seconds)
    vals = gaps.select("val").distinct().crossJoin(F.broadcast(seconds))  # values x windows
    own = gaps.where(F.col("label") != windows.baseline.label).select("val", "label", *[F.col(c).alias(f"w_{c}") for c in names])
    t = vals.join(own, ["val", "label"], "left").join(base, "val", "left").na.fill(0, ["w_n", "w_k", "b_n", "b_k"])
    steady = (F.col("b_k") >= least_gaps) & (F.col("b_cv") <= regular) & (F.col("b_mean") > 0)
    uneven = (F.col("b_cv") >= irregular) | (F.col("b_k") < least_gaps)
    beacon = ~F.coalesce(steady, F.lit(False)) & F.coalesce(uneven, F.lit(False)) & (F.col("w_k") >= beacon_gaps) & (F.col("w_span") > 0)
    t = t.withColumn("kind", F.when(F.coalesce(steady, F.lit(False)), "cadence").when(beacon, "beacon")).where("kind IS NOT NULL")
    a, c, n, m, total = F.col("b_n"), F.col("w_n"), F.col("d_b"), F.col("d_w"), F.col("b_n") + F.col("w_n")
    term = lambda o, d: F.when(o > 0, o * F.log(o * (n + m) / (total * d))).otherwise(0.0)
    g = F.greatest(2 * (term(a, n) + term(c, m)), F.lit(0.0))
    k, green = F.col("w_k"), F.col("w_sum2") / (F.col("w_span") * F.col("w_span"))
    z = (green - 2 / (k + 1)) / F.sqrt(4 * (k - 1) / (F.pow(k + 1, F.lit(2)) * (k + 2) * (k + 3)))
    t = t.withColumn("stat", F.when(F.col("kind") == "cadence", g).otherwise(z))
    t = t.withColumn("p", F.when(F.col("kind") == "cadence", chi2_p(F.col("stat"), F.lit(1.0))).otherwise(normal_p(-F.col("stat"))))
    t = benjamini_hochberg(t)
    rate = (F.when(c > 0, c).otherwise(0.5) / m) / (a / n)
    t = t.withColumn("ratio", F.when(F.col("kind") == "cadence", rate))
    effect = F.when(F.col("kind") == "cadence", (F.col("ratio") >= ratio) | (F.col("ratio") <= 1 / ratio)).otherwise((F.col("w_cv") <= beacon_cv) & (F.col("w_span") / m >= beacon_span))
    direction = F.when(F.col("kind") == "beacon", "new_regularity").when(F.col("ratio") > 1, "accelerated").otherwise("missed")
    out = t.where((F.col("q") <= fdr) & effect)
    return out.select(F.col("val").alias("value"), "label", c.alias("n"), direction.alias("direction"), F.round("ratio", 4).alias("ratio"), F.round("stat", 4).alias("stat"), F.round(-F.log10(F.greatest("p", F.lit(1e-300))), 4).alias("score"), "q")


def drift_numeric(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows) -> DataFrame:
    """(field, label, n_b, n_w, d, up): two-sample Kolmogorov-Smirnov distances, from counts of distinct values."""
    rows = values(df, fields, None, windows).withColumn("x", number(F.col("val"), finite=False)).where("x IS NOT NULL")
    each = rows.select("field", "x", "base", F.explode(F.when(F.col("base"), F.array(*[F.lit(w.label) for w in windows.suspects])).otherwise(F.col("labels"))).alias("label"))
    counts = each.groupBy("field", "label", "x").agg(F.count_if("base").alias("b"), F.count_if(~F.col("base")).alias("w"))
    up_to = lambda c: (F.col(f"before_{c}") + F.col(c)) / F.nullif(f"total_{c}", F.lit(0))
    cdf = cumulative(counts, ["field", "label"], "x", ["b", "w"]).withColumns({"fb": up_to("b"), "fw": up_to("w")})
    return cdf.groupBy("field", "label").agg(F.sum("b").alias("n_b"), F.sum("w").alias("n_w"), F.round(F.max(F.abs(F.col("fb") - F.col("fw"))), 9).alias("d"), F.round(F.max(F.col("fb") - F.col("fw")), 9).alias("up"))


def drift_categories(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows, top: int = 50) -> DataFrame:
    """(field, label, n_b, n_w, g, df, tvd): 2 x k G-tests of the top categories and the rest."""
    rows = values(df, fields, None, windows)
    counts = rows.groupBy("field", "val").agg(F.count_if("base").alias("b"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("labels", w.label)).alias(f"w{i}") for i, w in enumerate(windows.suspects)])
    counts = materialize(counts, "drift-categories")
    r = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "val"))
    # Only each task's first ones of a field are sent to its ranking; the others are told by what they lack.
    first = F.broadcast(counts.select("field", "val", "n").withColumn("r", r).where(F.col("r") <= top).select("field", "val", F.lit(True).alias("named")))
    counts = counts.join(first, ["field", "val"], "left").withColumn("cat", F.when(F.col("named"), F.col("val")).otherwise("__other__"))
    each = counts.select("field", "cat", "b", F.explode(F.array(*[F.struct(F.lit(w.label).alias("label"), F.col(f"w{i}").alias("w")) for i, w in enumerate(windows.suspects)])).alias("p")).select("field", "cat", "b", "p.*")
    each = each.groupBy("field", "label", "cat").agg(F.sum("b").alias("b"), F.sum("w").alias("w")).where("b + w > 0")
    sums = each.groupBy("field", "label").agg(F.sum("b").alias("n_b"), F.sum("w").alias("n_w"))
    each = each.join(sums, ["field", "label"]).where("n_b > 0 AND n_w > 0")
    col, n = F.col("b") + F.col("w"), F.col("n_b") + F.col("n_w")
    term = lambda o, m: F.when(o > 0, o * F.log(o * n / (m * col))).otherwise(0.0)
    return each.groupBy("field", "label", "n_b", "n_w").agg(
        F.greatest(F.round(2 * F.sum(term(F.col("b"), F.col("n_b")) + term(F.col("w"), F.col("n_w"))), 6), F.lit(0.0)).alias("g"), (F.count(F.lit(1)) - 1).alias("df"), F.round(0.5 * F.sum(F.abs(F.col("b") / F.col("n_b") - F.col("w") / F.col("n_w"))), 9).alias("tvd")
    )


def distribution_drift(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], windows: AnalysisWindows, fdr: float = FDR, least: int = 20) -> DataFrame:
    """Fields whose whole distribution moved: D >= 0.1 or total variation >= 0.05, in one false-discovery pool.

    The Kolmogorov-Smirnov p is the asymptotic one, so it differs slightly from exact ones on small samples.
    """
    a = drift_numeric(df, numeric, windows).where((F.col("n_b") >= least) & (F.col("n_w") >= least))
    a = a.select("field", "label", F.lit("ks").alias("kind"), F.col("d").alias("effect"), ks_p_column(F.col("d"), F.col("n_b"), F.col("n_w")).alias("p"), F.when(F.col("up") >= 0.75 * F.col("d"), "up").when(F.col("up") <= 0.25 * F.col("d"), "down").otherwise("spread").alias("direction"))
    b = drift_categories(df, categorical, windows).where((F.col("n_b") >= least) & (F.col("n_w") >= least) & (F.col("df") > 0))
    b = b.select("field", "label", F.lit("g").alias("kind"), F.col("tvd").alias("effect"), chi2_p(F.col("g"), F.col("df").cast("double")).alias("p"), F.lit("mixed").alias("direction"))
    t = benjamini_hochberg(a.unionByName(b))
    out = t.where((F.col("q") <= fdr) & (F.col("effect") >= F.when(F.col("kind") == "ks", 0.1).otherwise(0.05)))
    return out.select("field", "label", "kind", "direction", F.round("effect", 6).alias("effect"), F.round(-F.log10(F.greatest("p", F.lit(1e-300))), 4).alias("score"), "q")


def drift_contributors(df: DataFrame, field: str, windows: AnalysisWindows, most: int = 5) -> DataFrame:
    """(label, value, delta): the values whose shares moved most in each window."""
    rows = values(df, [field], None, windows)
    counts = rows.groupBy("val").agg(F.count_if("base").alias("b"), *[F.count_if(F.array_contains("labels", w.label)).alias(f"w{i}") for i, w in enumerate(windows.suspects)])
    sums = one_row(counts.agg(F.sum("b").alias("sb"), *[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(windows.suspects))]))
    each = counts.crossJoin(sums).select("val", F.explode(F.array(*[F.struct(F.lit(w.label).alias("label"), F.round(F.col(f"w{i}") / F.col(f"s{i}") - F.col("b") / F.col("sb"), 6).alias("delta")) for i, w in enumerate(windows.suspects)])).alias("p"))
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.abs("delta")), "val"))
    # The field's categories are already grouped; only they are ranked.
    return each.select("val", "p.*").withColumn("r", r).where(F.col("r") <= most).select("label", F.col("val").alias("value"), "delta")


LEAST_BUCKETS, LEAST_SD, Z = 3, 0.5, 2.5


def frequency(df: DataFrame, series: str, interval: int, z: float = Z) -> DataFrame:
    """Buckets of a series that stand out from its other buckets (leave-one-out), empty ones between its ends included.

    All empty buckets of a series have one score, so they are only written out where it stands out.
    """
    rows = df.where("timestamp IS NOT NULL").select(resolve(series).alias("val"), (F.floor(F.unix_millis("timestamp") / (1000 * interval)) * interval).alias("bucket")).where("val <> ''")
    counts = rows.groupBy("val", "bucket").agg(F.count(F.lit(1)).alias("c"))
    spans = counts.groupBy("val").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"), F.count(F.lit(1)).alias("active"), F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("square")).where(F.col("active") >= LEAST_BUCKETS)
    n = (F.col("hi") - F.col("lo")) / interval

    def scored(x: DataFrame) -> DataFrame:
        mean = (F.col("total") - F.col("c")) / n
        var = (F.col("square") - F.col("c") * F.col("c") - n * mean * mean) / (n - 1)
        score = (F.col("c") - mean) / F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(LEAST_SD))
        return x.withColumns({"mean": F.round(mean, 6), "z": F.round(score, 4)}).where(F.abs("z") >= z)

    full = scored(counts.join(spans, "val"))
    empty = scored(spans.where(F.col("active") < n + 1).withColumn("c", F.lit(0).cast("long")))
    empty = empty.withColumn("bucket", F.explode(F.sequence("lo", "hi", F.lit(interval).cast("long")))).join(counts.select("val", "bucket"), ["val", "bucket"], "left_anti")
    keep = [F.col("val").alias("value"), "bucket", F.col("c").alias("n"), "mean", "z"]
    return full.select(*keep).unionByName(empty.select(*keep))


def _whole(w, interval: int) -> Column:
    """Starts of the whole buckets of a window."""
    lo, hi = (F.unix_millis(F.lit(x).cast("timestamp")) for x in (w.start, w.end))
    first, last = F.ceil(lo / (1000 * interval)) * interval, F.floor(hi / (1000 * interval)) * interval - interval
    return F.when(last >= first, F.sequence(first, last, F.lit(interval).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def whole_buckets(spark: SparkSession, windows: AnalysisWindows, interval: int) -> list[int]:
    """How many whole buckets the baseline and each suspect window have."""
    return list(spark.range(1).select(*[F.size(_whole(w, interval)).alias(f"n{i}") for i, w in enumerate((windows.baseline, *windows.suspects))]).first())


def frequency_windowed(df: DataFrame, series: str, interval: int, windows: AnalysisWindows, z: float = Z) -> DataFrame:
    """Whole buckets of suspect windows against the baseline's whole buckets; overlapping windows: the first one wins."""
    ms = 1000 * interval
    zero = F.lit(0).cast("long")
    starts = lambda w: _whole(w, interval)

    def tagged(buckets, i):
        return F.transform(buckets, lambda b: F.struct(b.alias("bucket"), F.lit(i).alias("i")))

    one = df.sparkSession.range(1)
    base = one.select(F.explode(starts(windows.baseline)).alias("bucket"))
    suspects = one.select(F.explode(F.concat(*[tagged(starts(w), i) for i, w in enumerate(windows.suspects)])).alias("p")).select("p.*").groupBy("bucket").agg(F.min("i").alias("i"))
    names = F.array(*[F.lit(w.label) for w in windows.suspects])
    rows = df.where("timestamp IS NOT NULL").select(resolve(series).alias("val"), (F.floor(F.unix_millis("timestamp") / ms) * interval).alias("bucket")).where("val <> ''")
    rows = rows.join(F.broadcast(base.union(suspects.select("bucket")).distinct()), "bucket", "left_semi")
    counts = rows.groupBy("val", "bucket").agg(F.count(F.lit(1)).alias("c"))
    n = one_row(base.agg(F.count(F.lit(1)).alias("n")))
    in_base = counts.join(F.broadcast(base), "bucket", "left_semi").groupBy("val").agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("square"))
    stats = counts.select("val").distinct().join(in_base, "val", "left").na.fill(0).crossJoin(n)
    mean = F.col("total") / F.col("n")
    sd = F.greatest(F.sqrt(F.greatest((F.col("square") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0))), F.lit(LEAST_SD))
    score = F.round((F.col("c") - mean) / sd, 4)
    full = counts.join(F.broadcast(suspects), "bucket").join(stats, "val").withColumn("z", score).where(F.abs("z") >= z)  # suspects: a row a bucket
    # All empty buckets of a series have one score: they are only written out where it stands out.
    empty = stats.withColumn("c", zero).withColumn("z", score).where(F.abs("z") >= z)
    empty = empty.crossJoin(F.broadcast(suspects)).join(counts.select("val", "bucket"), ["val", "bucket"], "left_anti")
    keep = [F.col("val").alias("value"), F.get(names, F.col("i")).alias("label"), "bucket", F.col("c").alias("n"), F.round(mean, 6).alias("mean"), "z"]
    return full.select(*keep).unionByName(empty.select(*keep))


ORDER = ("ts", "byte_offset", "line_number", "event_id")


def ngrams(df: DataFrame, field: str, n: int, windows: AnalysisWindows | None = None, max_gap: float | None = None) -> DataFrame:
    """(source_id, wid, gram, ids, first_ms, last_ms): runs of n values of a field in time order of each source.

    With windows, runs stay inside the baseline (wid -1) or the first suspect window that holds each event;
    with max_gap, no run spans more than so many elapsed seconds between neighbours.
    """
    if not 2 <= n <= 5:
        raise ValueError("n must be 2 to 5")
    ts = F.col("timestamp")
    wid = F.lit(0)
    if windows:
        wid = F.lit(None).cast("int")
        for i in range(len(windows.suspects) - 1, -1, -1):
            wid = F.when(windows.suspects[i].holds(ts), i).otherwise(wid)
        wid = F.when(windows.baseline.holds(ts), -1).otherwise(wid)
    rows = df.where("timestamp IS NOT NULL").select("source_id", "event_id", "byte_offset", "line_number", ts.alias("ts"), F.unix_millis(ts).alias("ms"), resolve(field).alias("val"), wid.alias("wid")).where("val <> '' AND wid IS NOT NULL")
    # A source's rows are cut into hours, busy ones into parts, and each sees the n - 1 rows before it.
    rows = stretches(rows.withColumn("hour", F.floor(F.col("ms") / 3_600_000)), ["source_id", "wid"], "hour", F.floor(F.col("ms") / CELL_MS))
    rows = with_rows_before(rows, ["source_id", "wid"], "hour", list(ORDER), n - 1)
    w = Window.partitionBy("source_id", "wid", "hour").orderBy(*ORDER)
    back = lambda c: [F.lag(c, i).over(w) if i else F.col(c) for i in range(n - 1, -1, -1)]
    rows = rows.select("source_id", "wid", "_carried", F.array(*back("val")).alias("gram"), F.array(*back("event_id")).alias("ids"), F.array(*back("ms")).alias("times"))
    first = F.col("times")[0]
    out = rows.where(~F.col("_carried") & first.isNotNull())
    if max_gap is not None:
        out = out.where(F.forall(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("times", i) - F.get("times", i - 1) <= F.lit(max_gap) * 1000))
    return out.select("source_id", "wid", "gram", "ids", first.alias("first_ms"), F.col("times")[n - 1].alias("last_ms"))


def sequence_novelty(df: DataFrame, field: str, n: int, windows: AnalysisWindows, max_gap: float | None = None) -> DataFrame:
    """N-grams of suspect windows that no source's baseline has."""
    return novel_grams(ngrams(df, field, n, windows, max_gap), windows)


def novel_grams(grams: DataFrame, windows: AnalysisWindows) -> DataFrame:
    """sequence_novelty of n-grams that are made already."""
    known = grams.where("wid = -1").select("gram").distinct()
    names = F.array(*[F.lit(w.label) for w in windows.suspects])
    new = grams.where("wid >= 0")
    totals = F.broadcast(new.groupBy("wid").agg(F.count(F.lit(1)).alias("total")))
    seen = new.join(known, "gram", "left_anti").groupBy("wid", "gram").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"), F.min("first_ms").alias("first_ms"))
    return seen.join(totals, "wid").select(F.get(names, F.col("wid")).alias("label"), F.array_join("gram", " > ").alias("gram"), "n", "sources", "first_ms", _surprise(F.col("n"), F.col("total")).alias("score"))


def sequence_motifs(df: DataFrame, field: str, n: int, support: int = 3, max_gap: float | None = None) -> DataFrame:
    """Recurring n-grams with the cadence of the source where they are most regular; score favours regular ones."""
    grams = ngrams(df, field, n, None, max_gap)
    grams = _gaps(grams.select("source_id", "gram", "first_ms", "last_ms", F.get("ids", 0).alias("id")), ["source_id", "gram"], "first_ms", "id")
    each = grams.groupBy("gram", "source_id").agg(F.count(F.lit(1)).alias("n"), F.count("gap").alias("k"), F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("sd"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    each = each.join(_medians(grams, ["gram", "source_id"]), ["gram", "source_id"], "left")
    cv = F.when(F.col("mean") > 0, F.round(F.col("sd") / F.col("mean"), 4))
    each = each.withColumn("cv", cv)
    best = F.min(F.struct(F.col("cv").isNull().alias("none"), F.coalesce("cv", -F.col("k").cast("double")).alias("rank"), "source_id", "cv", F.round("median", 4).alias("period"))).alias("best")
    out = each.groupBy("gram").agg(F.sum("n").alias("support"), F.count(F.lit(1)).alias("sources"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), best).where(F.col("support") >= support)
    regular = F.coalesce(F.round(F.greatest(F.lit(0.0), 1 - F.col("best.cv")), 4), F.lit(0.0))
    return out.select(F.array_join("gram", " > ").alias("gram"), "support", "sources", "first_ms", "last_ms", F.col("best.source_id").alias("source_id"), F.col("best.cv").alias("cv"), F.col("best.period").alias("period"), F.round(F.log10("support") * (1 + regular), 4).alias("score"))


def motif_occurrences(df: DataFrame, field: str, gram: Sequence[str], cap: int | None = None) -> DataFrame:
    """(event_id, source_id): member events of a motif's occurrences, for hiding routine; with cap, of the earliest ones only."""
    hits = ngrams(df, field, len(gram)).where(F.col("gram") == F.array(*map(F.lit, gram)))
    if cap is not None:
        hits = hits.orderBy("first_ms", "source_id", F.get("ids", 0)).limit(cap)
    return hits.select(F.explode("ids").alias("event_id"), "source_id").distinct()


def log_templates(df: DataFrame, new_since: str | None = None) -> DataFrame:
    """Masked message shapes: count, sources, first and last time, an example; new_since keeps shapes first seen then or later."""
    rows = df.select(template(F.col("message")).alias("template"), "source_id", "message", F.unix_millis("timestamp").alias("ms"))
    out = rows.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"), F.coalesce(F.min("ms"), F.lit(-1)).alias("first_ms"), F.coalesce(F.max("ms"), F.lit(-1)).alias("last_ms"), F.min("message").alias("example"))
    return out if new_since is None else out.where(F.col("first_ms") >= F.unix_millis(F.lit(new_since).cast("timestamp")))


def template_count(df: DataFrame, muted: Sequence[str]) -> DataFrame:
    return df.where(template(F.col("message")).isin(*muted)).agg(F.count(F.lit(1)).alias("n"))


def order_violations(df: DataFrame, least_ms: int = 1000) -> DataFrame:
    """Dated records that are earlier than the record before them in the same source, by at least a second."""
    order = ["byte_offset", "line_number", "event_id"]
    rows = df.where("timestamp IS NOT NULL").select("source_id", *order, F.unix_millis("timestamp").alias("ms"))
    # A source's rows are cut into stretches of bytes, or of lines where offsets are unknown, and each sees the last row before it.
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("byte_offset") / (32 << 20)), F.lit(-1)))
    rows = stretches(rows, ["source_id"], "part", F.coalesce("byte_offset", "line_number"))
    rows = with_rows_before(rows, ["source_id"], "part", order, 1)
    back = F.lag("ms").over(Window.partitionBy("source_id", "part").orderBy(*order)) - F.col("ms")
    rows = rows.withColumn("back_ms", back).where(~F.col("_carried") & (F.col("back_ms") >= least_ms))
    return rows.select("source_id", "event_id", "ms", "back_ms", F.round(F.col("back_ms") / 1000, 3).alias("score"))


def order_totals(df: DataFrame) -> DataFrame:
    return order_violations(df).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("back_ms").alias("worst_ms"))


def field_inventory(df: DataFrame, fields: Sequence[str] | None = None, mappings=None) -> DataFrame:
    """(field, coverage, n_distinct, n_numeric, total) of attribute keys, or of the given fields."""
    from .explore import pairs

    total = one_row(df.agg(F.count(F.lit(1)).alias("total")))
    rows = values(df, fields, mappings).select("field", "val") if fields else pairs(df).select(F.col("key").alias("field"), "val")
    counts = rows.groupBy("field", "val").agg(F.count(F.lit(1)).alias("n"))
    numeric = number(F.col("val"), finite=False).isNotNull()
    return counts.groupBy("field").agg(F.sum("n").alias("coverage"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.when(numeric, F.col("n")).otherwise(0)).alias("n_numeric")).crossJoin(total)


def recommend_novelty(df: DataFrame) -> DataFrame:
    """What each field is good for: constant, sparse, identifier or categorical; the last are recommended."""
    f = field_inventory(df)
    kind = F.when(F.col("n_distinct") <= 1, "constant").when(F.col("coverage") < 0.05 * F.col("total"), "sparse").when(F.col("n_distinct") >= 0.9 * F.col("coverage"), "identifier").otherwise("categorical")
    return f.select("field", "coverage", "n_distinct", kind.alias("kind"), (kind == "categorical").alias("recommended"))


def recommend_numeric(df: DataFrame, most: int = 15) -> DataFrame:
    f = field_inventory(df).where("n_numeric >= 0.9 * coverage AND coverage >= 0.05 * total AND n_distinct > 1")
    return f.orderBy(F.desc("coverage"), "field").limit(most).select("field", "coverage", "n_distinct")


def recommend_strings(df: DataFrame, most: int = 15, reserve: int = 5) -> DataFrame:
    """Fields for character and entropy checks: slots are reserved for identifiers, and unused ones refilled."""
    f = field_inventory(df).where("n_distinct > 1 AND n_numeric < 0.9 * coverage").withColumn("identifier", F.col("n_distinct") >= 0.9 * F.col("coverage"))
    r = F.row_number().over(Window.partitionBy("identifier").orderBy(F.desc("coverage"), "field"))
    f = f.withColumn("r", r)  # a row a field
    first = F.when(F.col("identifier"), F.col("r") <= reserve).otherwise(F.col("r") <= most - reserve)
    place = F.row_number().over(Window.orderBy(F.desc(first.cast("int")), F.desc("coverage"), "field"))
    return f.withColumn("place", place).where(F.col("place") <= most).select("field", "coverage", "identifier")


def suppress(findings: DataFrame, allowed: DataFrame, excluded: DataFrame) -> DataFrame:
    """Without allowed (field, value) pairs and without findings that excluded events represent."""
    return findings.join(small(allowed.select("field", "value").distinct()), ["field", "value"], "left_anti").join(small(excluded.select("event_id").distinct()), "event_id", "left_anti")


def rank_findings(findings: DataFrame, df: DataFrame, limit: int = 100, columns: Sequence[str] = ("message", "artifact")) -> DataFrame:
    """The best findings with their representative events, which are joined only after the cut."""
    top = findings.orderBy(F.desc("score"), "field", "value", "event_id").limit(limit)
    return df.select("event_id", *columns).join(F.broadcast(top), "event_id", "right")
