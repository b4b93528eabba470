"""What a detector's result rests on: a status, and warnings by name, beside its findings.

A status is `no_data` (nothing in scope), `insufficient_data` (nothing that a baseline could be learnt from) or `ok`;
an empty result with `ok` means that nothing stands out. Totals, and for each field the rows of the baseline and
of every window, are observed while the findings are written, so they cost no scan of their own. Warnings are rows
(detector, kind, field, name, label, n): windows, fields and groups that were too small, too wide or left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import number, resolve
from ..functions.storage import materialize, observed
from ..plans.windows import AnalysisWindows
from . import detect

WARNINGS = "detector string, kind string, field string, name string, label string, n long"
SMALL = 50

#: What a warning of each kind says; n, field, name and label are filled in.
SAYS = {
    "no_baseline": "The baseline window contains no events.",
    "no_baseline_sequences": "The baseline window contains no complete sequences.",
    "small_window": "Window {label} has only {n} events: scores over fewer than 50 are unstable.",
    "small_sequences": "Window {label} has only {n} sequences: scores over fewer than 50 are unstable.",
    "thin_field": "Field {field} was not evaluated: it has {n} usable values in its baseline.",
    "absent_field": "Field {field} has no values in scope.",
    "skipped_test": "Field {field}, window {label}: too few values on one side ({n}), not in the pool of tests.",
    "candidate_cap": "Field {field}: only its {n} most frequent values were tested.",
    "few_buckets": "The baseline spans {n} whole buckets, too few for a distribution.",
    "short_window": "Window {label} is shorter than a bucket and was not scored.",
    "thin_series": "Series {name} has {n} active buckets, too few to be scored.",
    "thin_group": "Group {name} of {field} has {n} distinct values of its own and was measured by the fallback alphabet.",
    "absent_group": "Group {name} of {field} is not in the baseline and was measured by the fallback alphabet.",
    "wide_group": "Group {name} of {field} was left out: its alphabet has {n} characters.",
    "unmeasured_group": "Group {name} of {field} was not evaluated: its values and the fallback's are too few.",
}


@dataclass(frozen=True)
class Outcome:
    """A detector's findings (written), status, sizes of its scope and baseline, and warnings."""

    detector: str
    status: str
    total: int
    baseline: int
    findings: DataFrame | None
    warnings: DataFrame

    def summary(self) -> DataFrame:
        """One row: detector, status, total, baseline, findings, warnings."""
        found = self.findings.count() if self.findings is not None else 0
        row = (self.detector, self.status, self.total, self.baseline, found, self.warnings.count())
        return self.warnings.sparkSession.createDataFrame([row], "detector string, status string, total long, baseline long, findings long, warnings long")


def messages(warnings: DataFrame) -> DataFrame:
    """warnings with what they say, as text."""
    text = F.lit(None).cast("string")
    for kind, says in SAYS.items():
        said: Column = F.lit(says)
        for c in ("field", "name", "label", "n"):
            said = F.replace(said, F.lit(f"{{{c}}}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
        text = F.when(F.col("kind") == kind, said).otherwise(text)
    return warnings.withColumn("message", text)


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, WARNINGS)


def _seen(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None, value: Callable[[str], Column]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """df that counts, while it is read, its rows, those of each window, and each field's rows with a value in them; and how to get the counts afterwards."""
    ts = F.col("timestamp")
    spans = {"baseline": windows.baseline.holds(ts), **{f"w{i}": w.holds(ts) for i, w in enumerate(windows.suspects)}} if windows else {}
    counts = {"total": F.lit(True), "dated": ts.isNotNull(), **spans}
    for i, f in enumerate(fields):
        has = value(f)
        counts[f"f{i}"] = has
        counts |= {f"f{i}_{k}": has & c for k, c in spans.items()}
    seen, metrics = Observation(), [F.count_if(c).alias(n) for n, c in counts.items()]

    return df.observe(seen, *metrics), lambda: observed(seen, lambda: df.agg(*metrics))


def _text(field: str) -> Column:
    return F.coalesce(resolve(field) != "", F.lit(False))


def _number(field: str) -> Column:
    return number(resolve(field), finite=False).isNotNull()


def outcome(
    detector: str,
    df: DataFrame,
    find: Callable[[DataFrame], DataFrame],
    fields: Sequence[str] = (),
    windows: AnalysisWindows | None = None,
    value: Callable[[str], Column] = _text,
    least: int = 1,
    warn: Callable[[dict[str, int]], list[tuple]] | None = None,
    extra: DataFrame | None = None,
) -> Outcome:
    """Runs a detector and says what its findings rest on.

    A field with fewer than `least` values (in the baseline, if there are windows) is not evaluated; with no field left
    the status is `insufficient_data`. warn makes further warnings from the observed counts; extra holds further ones.
    """
    spark = df.sparkSession
    if df.isEmpty():
        return Outcome(detector, "no_data", 0, 0, None, _table(spark, []))
    seen_df, seen = _seen(df, fields, windows, value)
    findings = materialize(find(seen_df), "findings")
    n = seen()
    rows, status = [], "ok"
    if windows:
        rows += [(detector, "small_window", None, None, w.label, n[f"w{i}"]) for i, w in enumerate(windows.suspects) if n[f"w{i}"] < SMALL]
        if not n["baseline"]:
            rows.append((detector, "no_baseline", None, None, windows.baseline.label, 0))
            status = "insufficient_data"
    basis = {f: n[f"f{i}_baseline"] if windows else n[f"f{i}"] for i, f in enumerate(fields)}
    rows += [(detector, "thin_field" if k or least > 1 else "absent_field", f, None, None, k) for f, k in basis.items() if k < least]
    if fields and all(k < least for k in basis.values()):
        status = "insufficient_data"
    rows += warn(n) if warn else []
    warnings = _table(spark, rows)
    if extra is not None:
        warnings = warnings.unionByName(extra)
    return Outcome(detector, status, n["total"], n["baseline"] if windows else n["total"], findings, warnings)


def value_novelty(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None = None) -> Outcome:
    return outcome("value_novelty", df, lambda d: detect.value_novelty(d, fields, windows), fields, None if windows is None else windows)


def value_combos(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None = None) -> Outcome:
    """At least two fields are needed."""
    if len(fields) < 2:
        return Outcome("value_combo", "no_data" if df.isEmpty() else "insufficient_data", 0, 0, None, _table(df.sparkSession, []))
    return outcome("value_combo", df, lambda d: detect.value_combos(d, fields, windows), fields, windows)


def numeric_range(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None = None) -> Outcome:
    return outcome("numeric_range", df, lambda d: detect.numeric_range(d, fields, windows), fields, windows, _number, detect.LEAST_NUMBERS)


def charset(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None = None, group: str | None = None) -> Outcome:
    """Groups (or whole fields, with an empty name) that had no alphabet of their own are named, with what was done with them."""
    if df.isEmpty():
        return Outcome("charset", "no_data", 0, 0, None, _table(df.sparkSession, []))
    seen_df, seen = _seen(df, fields, windows, _text)
    basis = detect.charset_basis(seen_df, fields, windows, group)
    findings = materialize(detect.charset_findings(df, fields, basis, windows, group), "findings")
    n, states = seen(), detect.charset_states(basis, group)
    kind = F.when(F.col("state") == "wide", "wide_group").when(F.col("measured") == "none", "unmeasured_group").when(F.col("state") == "thin", "thin_group").when(F.col("state") == "absent", "absent_group")
    size = F.when(F.col("state") == "wide", F.col("size")).otherwise(F.coalesce("n_vals", F.lit(0)))
    named = states.withColumn("kind", kind).where("kind IS NOT NULL").select(F.lit("charset").alias("detector"), "kind", "field", F.col("grp").alias("name"), F.lit(None).cast("string").alias("label"), size.cast("long").alias("n"))
    rows = [("charset", "small_window", None, None, w.label, n[f"w{i}"]) for i, w in enumerate(windows.suspects) if n[f"w{i}"] < SMALL] if windows else []
    status = "insufficient_data" if states.where("measured <> 'none'").isEmpty() else "ok"
    return Outcome("charset", status, n["total"], n["baseline"] if windows else n["total"], findings, _table(df.sparkSession, rows).unionByName(named))


def entropy(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows | None = None) -> Outcome:
    """A field needs LEAST_VALUES distinct values of some length in its baseline."""
    if df.isEmpty():
        return Outcome("entropy", "no_data", 0, 0, None, _table(df.sparkSession, []))
    spark = df.sparkSession
    seen_df, seen = _seen(df, fields, windows, _text)
    found, known = detect.entropy_parts(seen_df, fields, windows)
    findings = materialize(found, "findings")
    n, sizes = seen(), {r.field: r.known for r in known.collect()}  # a row a field
    rows = [("entropy", "thin_field", f, None, None, sizes.get(f, 0)) for f in fields if sizes.get(f, 0) < detect.LEAST_VALUES]
    rows += [("entropy", "small_window", None, None, w.label, n[f"w{i}"]) for i, w in enumerate(windows.suspects) if n[f"w{i}"] < SMALL] if windows else []
    status = "insufficient_data" if all(sizes.get(f, 0) < detect.LEAST_VALUES for f in fields) else "ok"
    return Outcome("entropy", status, n["total"], n["baseline"] if windows else n["total"], findings, _table(spark, rows))


def proportion_shift(df: DataFrame, fields: Sequence[str], windows: AnalysisWindows, most: int | None = None) -> Outcome:
    def warn(n):
        capped = [f for i, f in enumerate(fields) if most is not None and n[f"f{i}"] >= most]
        return [("proportion_shift", "candidate_cap", f, None, None, most) for f in capped]

    return outcome("proportion_shift", df, lambda d: detect.proportion_shift(d, fields, windows, most=most), fields, windows, warn=warn)


def interval(df: DataFrame, field: str, windows: AnalysisWindows) -> Outcome:
    return outcome("interval_periodicity", df, lambda d: detect.interval_periodicity(d, field, windows), [field], windows)


def drift(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], windows: AnalysisWindows, least: int = 20) -> Outcome:
    """A field's test of a window is skipped where either side has fewer than `least` values; without any test there is too little data."""
    fields = [*numeric, *categorical]
    kinds = {f: _number for f in numeric}
    skipped: list[tuple] = []

    def warn(n):
        for i, f in enumerate(fields):
            for k, w in enumerate(windows.suspects):
                sides = n[f"f{i}_baseline"], n[f"f{i}_w{k}"]
                if min(sides) < least and sum(sides):
                    skipped.append(("distribution_drift", "skipped_test", f, None, w.label, min(sides)))
        return skipped

    out = outcome("distribution_drift", df, lambda d: detect.distribution_drift(d, numeric, categorical, windows, least=least), fields, windows, lambda f: kinds.get(f, _text)(f), warn=warn)
    tests = len(fields) * len(windows.suspects)
    return out if len(skipped) < tests or out.status == "no_data" else Outcome(out.detector, "insufficient_data", out.total, out.baseline, out.findings, out.warnings)


def frequency(df: DataFrame, series: str, every: int) -> Outcome:
    """Series with fewer than LEAST_BUCKETS active buckets are named."""
    dated = df.where("timestamp IS NOT NULL")
    counts = dated.select(resolve(series).alias("name"), F.floor(F.unix_millis("timestamp") / (1000 * every)).alias("bucket")).where("name <> ''").groupBy("name", "bucket").count()
    active = materialize(counts.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "active-buckets")
    thin = active.where(F.col("n") < detect.LEAST_BUCKETS).select(F.lit("frequency").alias("detector"), F.lit("thin_series").alias("kind"), F.lit(None).cast("string").alias("field"), "name", F.lit(None).cast("string").alias("label"), "n")
    out = outcome("frequency", dated, lambda d: detect.frequency(d, series, every), [series], extra=thin)
    few = out.status == "ok" and active.where(F.col("n") >= detect.LEAST_BUCKETS).isEmpty()
    return Outcome(out.detector, "insufficient_data", out.total, out.baseline, out.findings, out.warnings) if few else out


def frequency_windowed(df: DataFrame, series: str, every: int, windows: AnalysisWindows) -> Outcome:
    """The baseline needs LEAST_BUCKETS whole buckets; suspect windows without a whole one are named."""
    whole = {w.label: n for w, n in zip((windows.baseline, *windows.suspects), detect.whole_buckets(df.sparkSession, windows, every), strict=True)}

    def warn(n):
        rows = [("frequency_windowed", "short_window", None, None, w.label, 0) for w in windows.suspects if not whole[w.label]]
        few = whole[windows.baseline.label]
        return rows + ([("frequency_windowed", "few_buckets", None, None, windows.baseline.label, few)] if few < detect.LEAST_BUCKETS else [])

    out = outcome("frequency_windowed", df, lambda d: detect.frequency_windowed(d, series, every, windows), [series], windows, warn=warn)
    few = out.status == "ok" and whole[windows.baseline.label] < detect.LEAST_BUCKETS
    return Outcome(out.detector, "insufficient_data", out.total, out.baseline, None, out.warnings) if few else out


def sequence_novelty(df: DataFrame, field: str, n: int, windows: AnalysisWindows, max_gap: float | None = None) -> Outcome:
    """The baseline needs a whole n-gram; windows with few are named."""
    sizes: dict[int, int] = {}

    def find(d: DataFrame) -> DataFrame:
        grams = materialize(detect.ngrams(d, field, n, windows, max_gap).select("source_id", "wid", "gram", "first_ms"), "ngrams")
        sizes.update({r.wid: r["count"] for r in grams.groupBy("wid").count().collect()})  # a row a window
        return detect.novel_grams(grams, windows)

    def warn(_):
        rows = [("sequence_novelty", "small_sequences", None, None, w.label, sizes.get(i, 0)) for i, w in enumerate(windows.suspects) if sizes.get(i, 0) < SMALL]
        return rows + ([] if sizes.get(-1) else [("sequence_novelty", "no_baseline_sequences", None, None, windows.baseline.label, 0)])

    out = outcome("sequence_novelty", df, find, [field], windows, warn=warn)
    return out if out.status != "ok" or sizes.get(-1) else Outcome(out.detector, "insufficient_data", out.total, out.baseline, out.findings, out.warnings)


def sequence_motifs(df: DataFrame, field: str, n: int, support: int = 3, max_gap: float | None = None) -> Outcome:
    return outcome("sequence_motif", df, lambda d: detect.sequence_motifs(d, field, n, support, max_gap), [field])


def timestamp_order(df: DataFrame) -> Outcome:
    """Only dated records have an order."""
    return outcome("timestamp_order", df.where("timestamp IS NOT NULL"), detect.order_violations)
