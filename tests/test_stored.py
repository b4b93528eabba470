"""The stored table, one-pass counters, the rule index, kept summaries, ranks by both ways and detector outcomes."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens import fixtures as X
from eventlens.functions import ranks
from eventlens.operators import detect, diagnose, rules, summaries
from eventlens.plans import filters
from eventlens.plans.windows import AnalysisWindows, Window
from eventlens.sources import exchange, store, text


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """20,000 events of two sources in row groups of a few hundred rows."""
    path = str(tmp_path_factory.mktemp("store") / "events")
    n = F.col("id")
    stamp = F.timestamp_seconds(F.lit(1704067200) + n * 10)
    df = spark.range(20_000).select(
        F.md5(n.cast("string")).alias("event_id"), F.lit("c").alias("case_id"), F.concat(F.lit("s/"), n % 2).alias("source_id"), F.when(n % 50 != 0, stamp).alias("timestamp"),
        F.concat(F.lit("message of some length "), F.sha2(n.cast("string"), 512)).alias("message"), F.lit("a").alias("artifact"), F.array().cast("array<string>").alias("tags"), F.create_map(F.lit("n"), n.cast("string")).alias("attributes"),
    )
    store.write_store(df, path, group_bytes=50_000)
    return path, df


def scanned(df):
    """Rows that the scans of an executed plan have read."""
    plan = df._jdf.queryExecution().executedPlan()
    work, total = [plan], 0
    while work:
        node = work.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            work.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            work.append(node.plan())
        elif name == "FileSourceScanExec":
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        work += [children.apply(i) for i in range(children.size())]
    return total


def run(df):
    rows = df.collect()
    return rows, scanned(df)


def test_pages_read_few_rows_whole(spark, table):
    path, df = table
    everything = df.where("timestamp IS NOT NULL").orderBy(F.desc("timestamp")).limit(20).select("event_id").collect()
    q = filters.EventQuery(start="2024-01-01", end="2025-01-01")
    found = store.page(spark, path, q, 20)
    got, read = run(found)
    assert len(got) == 20 and got[0].more and [r.place for r in got] == list(range(1, 21))
    assert [r.event_id for r in got] == [r.event_id for r in everything]
    assert read < 4000  # of 20,000
    undated = store.page(spark, path, filters.EventQuery(), 5).collect()
    assert len(undated) == 5 and all(r.timestamp is None for r in undated)
    assert store.page(spark, path, filters.EventQuery(artifact="none"), 5).count() == 0


def test_ids_skip_row_groups(spark, table):
    path, df = table
    ids = [r.event_id for r in df.where("attributes['n'] IN ('7', '8', '19999')").collect()]
    got, read = run(store.by_ids(spark, path, [*ids, "missing"]))
    assert sorted(r.event_id for r in got) == sorted(ids) and read < 6000
    assert store.by_ids(spark, path, []).count() == 0


def files(path):
    from pathlib import Path

    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_deleting_a_source_touches_no_other_and_can_be_repeated(spark, table, tmp_path):
    import shutil

    path = str(tmp_path / "events")
    shutil.copytree(table[0], path)
    before = files(path)
    kept = {k: v for k, v in before.items() if "s%2F0" in k}
    assert 0 < len(kept) < len(before)
    # A delete that was killed after its first step: readers see nothing of the source, and the next call ends it.
    shutil.move(f"{path}/case_id=c/source_id=s%2F1", f"{path}/case_id=c/_deleted-s%2F1")
    assert {r.source_id for r in spark.read.parquet(path).select("source_id").distinct().collect()} == {"s/0"}
    assert store.delete_source(spark, path, "c", "s/1") and files(path) == kept
    assert not store.delete_source(spark, path, "c", "s/1") and files(path) == kept
    assert store.delete_source(spark, path, "c", "s/0") and files(path) == {}


def test_lines_and_counters_in_one_pass(spark, tmp_path):
    ev = X.events(spark, "/root/testdata/sf0.001")
    notes = spark.createDataFrame([("1", "tag", "x"), ("1", "comment", "y")], "event_id string, kind string, value string")
    exchange.write_jsonl(ev, notes, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == ev.count()
    assert f'"written":{ev.count()}' in spark.read.text(str(tmp_path / "j-trailer")).first().value
    exchange.write_jsonl(ev.where("false"), notes, str(tmp_path / "none"))
    with pytest.raises(RuntimeError):  # an event that two annotations tables' rows would double
        exchange.write_jsonl(ev, _Doubling(notes), str(tmp_path / "k"))
    rows = spark.createDataFrame([(True, "2024-01-02"), (True, "2024-02-02"), (None, None), (True, None)], "ok boolean, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert text.write_bounded(rows, str(tmp_path / "b"), "2024-01-01", "2024-02-01") == {"parsed": 1, "malformed": 1, "out_of_range": 2}
    assert text.write_bounded(rows.where("false"), str(tmp_path / "e")) == {"parsed": 0, "malformed": 0, "out_of_range": 0}


class _Doubling:
    """Annotations whose grouping gives two rows for an event."""

    def __init__(self, notes):
        self.notes = notes

    def groupBy(self, *_):
        return self

    def agg(self, *_):
        one = self.notes.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value"))).alias("annotations"))
        return one.unionByName(one)


SHAPES = [
    {"selections": {"a": {"user": "3"}}, "condition": "a"},
    {"selections": {"a": {"user": ["3", 5]}, "b": {"action": "READ"}}, "condition": "a and b"},
    {"selections": {"a": {"user": "3"}, "b": {"action": "exfil"}}, "condition": "a or b"},
    {"selections": {"a": {"action": "read"}, "b": {"user": "7"}}, "condition": "a and not b"},
    {"selections": {"a": {"action": "read"}}, "condition": "not a"},
    {"selections": {"a": {"ua|contains": "agent/3"}}, "condition": "a"},
    {"selections": {"a1": {"user": "1"}, "a2": {"user": "2", "bytes|gt": 5000}}, "condition": "1 of a*"},
    {"selections": {"a": [{"user": "1", "action": "read"}, {"user": "2"}]}, "condition": "a"},
    {"selections": {"a": {"user|all": ["1", "1"]}, "b": {"session": "sess-*"}}, "condition": "all of them"},
    {"selections": {"a": "exfil"}, "condition": "a"},
    {"selections": {"a": {"user": None}}, "condition": "a"},
    {"selections": {"a": {"user": ""}}, "condition": "a"},
    {"selections": {"a": {"nonsense|bad": 1}}, "condition": "a"},
    {"selections": {"a": {"user": "1"}}, "condition": "a b"},
    {"selections": {"a": {"user": "99999"}, "b": {"k|lt": 3}}, "condition": "a and b"},
    {"selections": {"a": {"client_ip": "10.0.1.1"}, "b": {"artifact": "click"}}, "condition": "(a or b) and not (a and b)"},
]


@pytest.mark.parametrize("batch", [64, 2])
def test_the_rule_index_gives_the_hits_of_a_scan(spark, batch):
    ev = X.events(spark, "/root/testdata/sf0.001")
    named = {f"r{i}": r for i, r in enumerate(SHAPES)}
    want, bad = rules.scan(ev, named, X.MAPPINGS)
    got, errors = rules.scan_many(ev, named, X.MAPPINGS, batch)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert errors.keys() == bad.keys() == {"r12", "r13"}


def test_rules_that_nothing_meets_are_not_compiled(spark, monkeypatch):
    ev = X.events(spark, "/root/testdata/sf0.001").limit(50)
    built = []
    plain = rules.condition
    monkeypatch.setattr(rules, "condition", lambda rule, mappings=None: built.append(rule) or plain(rule, mappings))
    many = {f"n{i}": {"selections": {"a": {"user": f"no-{i}"}, "b": {"k|lt": 3}}, "condition": "a and b"} for i in range(2000)}
    assert rules.scan_many(ev, many)[0].count() == 0 and built == []


# Kept summaries.
def test_merged_summaries_hold_the_true_counts(spark):
    rng = random.Random(4)
    rows = [(f"s{i % 3}", f"e{i}", datetime(2024, 1, 1), {"few": f"v{rng.randrange(5)}", "many": f"w{int(rng.paretovariate(0.6)) % 400}", "x": str(rng.gauss(0, 1)), "long": "y" * (300 if i == 7 else 3)}) for i in range(3000)]
    df = spark.createDataFrame(rows, "source_id string, event_id string, timestamp timestamp, attributes map<string,string>")
    kept = summaries.value_summaries(df, most=20)
    true = {}
    for _, _, _, a in rows:
        for k, v in a.items():
            true.setdefault(k, {}).setdefault(v, 0)
            true[k][v] += 1
    for r in summaries.merged_fields(kept).collect():
        assert r.coverage == 3000 and abs(r.n_distinct - len(true[r.key])) <= 0.03 * len(true[r.key]) + 1
        assert r.samples == sorted(true[r.key])[:3] and r.listed == (r.key != "long") and r.exact == (r.key in ("few", "long"))
    merged = summaries.merged_values(kept, 10).collect()
    assert "long" not in {r.key for r in merged}
    for r in merged:
        assert r.n <= true[r.key][r.value] <= r.most and r.total == 3000
    assert {r.value: r.n for r in merged if r.key == "few"} == true["few"]


def test_quantiles_of_merged_sketches_are_near_their_ranks(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=20_000), rng.exponential(size=20_000), np.full(5000, 0.25)])
    rows = [(f"s{i % 5}", f"e{i}", {"x": repr(float(v))}) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "source_id string, event_id string, attributes map<string,string>").withColumn("timestamp", F.lit(None).cast("timestamp"))
    kept = summaries.number_summaries(df)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1  # one scan
    shares = (0.01, 0.25, 0.5, 0.9, 0.99)
    for part in (kept, kept.where("source_id IN ('s0', 's3')")):
        chosen = x if part is kept else x[[i for i in range(len(x)) if i % 5 in (0, 3)]]
        r = summaries.merged_numbers(part, shares).first()
        assert (r.n, r.lo, r.hi) == (len(chosen), chosen.min(), chosen.max()) and r.mean == pytest.approx(chosen.mean(), abs=1e-5) and r.sd == pytest.approx(chosen.std(), abs=1e-4)
        for p, q in zip(shares, r.q, strict=True):
            assert (chosen < q).mean() - 0.01 <= p <= (chosen <= q).mean() + 0.01


# Ranks: few counts are sorted by a window, many in ranges.
@pytest.mark.parametrize("bound", [0, 200_000])
def test_ranks_are_the_same_by_windows_and_by_ranges(spark, monkeypatch, bound):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", bound)
    rng = np.random.default_rng(4)
    x, g = np.round(rng.normal(size=900), 1), rng.integers(0, 3, 900)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x, strict=True)], "g int, x double")
    got = {r.g: r.q for r in ranks.quantiles(df, ["g"], "x", (0.0, 0.1, 0.5, 0.93, 1.0)).collect()}
    for k in range(3):
        assert got[k] == pytest.approx(np.quantile(x[g == k], (0, 0.1, 0.5, 0.93, 1)))
    p = np.round(rng.random(300) ** 3, 3)
    tests = spark.createDataFrame([(i, i % 2, float(v)) for i, v in enumerate(p)] + [(900, 0, None)], "i int, pool int, p double")
    for pool in ((), ("pool",)):
        found = {r.i: r.q for r in ranks.q_values(tests, "p", "q", pool).collect()}
        for k in range(2) if pool else (None,):
            idx = [i for i in range(300) if k is None or i % 2 == k]
            own = p[idx]
            want = [min(1.0, min(v * len(own) / (own <= v).sum() for v in own[own >= u])) for u in own]
            assert [found[i] for i in idx] == pytest.approx(want)
        assert found[900] is None


# Outcomes of detectors.
W = AnalysisWindows(Window("base", "2024-01-01", "2024-01-11"), (Window("w1", "2024-01-11", "2024-01-12"),))


def ev(spark, rows):
    return spark.createDataFrame([(f"e{i:04d}", s, datetime(2024, 1, 1) + timedelta(hours=h) if h is not None else None, a, i) for i, (s, h, a) in enumerate(rows)], "event_id string, source_id string, timestamp timestamp, attributes map<string,string>, byte_offset long").withColumns({"line_number": F.col("byte_offset"), "message": F.lit("m"), "artifact": F.lit("a"), "display_name": F.lit("d"), "tags": F.array().cast("array<string>")})


def said(o):
    return {(r.kind, r.field, r.name, r.label, r.n) for r in o.warnings.collect()}


def test_outcomes_of_empty_thin_and_whole_scopes(spark):
    rng = random.Random(0)
    rows = [("s", i % 260, {"x": str(rng.randrange(50)), "k": f"v{i % 7}", "g": "a" if i % 3 else "b"}) for i in range(600)]
    whole = ev(spark, rows)
    thin = whole.where("event_id < 'e0010'")
    nothing = whole.where("false")
    for make in (
        lambda d: diagnose.value_novelty(d, ["k"], W), lambda d: diagnose.numeric_range(d, ["x"], W), lambda d: diagnose.charset(d, ["k"], W), lambda d: diagnose.entropy(d, ["k"], W), lambda d: diagnose.proportion_shift(d, ["k"], W),
        lambda d: diagnose.interval(d, "k", W), lambda d: diagnose.drift(d, ["x"], ["k"], W), lambda d: diagnose.frequency(d, "k", 3600), lambda d: diagnose.frequency_windowed(d, "k", 3600, W), lambda d: diagnose.sequence_novelty(d, "k", 2, W),
        lambda d: diagnose.sequence_motifs(d, "k", 2), diagnose.timestamp_order, lambda d: diagnose.value_combos(d, ["k", "g"], W),
    ):
        assert make(nothing).status == "no_data"
    assert diagnose.value_combos(whole, ["k"]).status == "insufficient_data"
    o = diagnose.numeric_range(thin, ["x"], W)
    assert o.status == "insufficient_data" and (o.total, o.baseline) == (10, 10) and said(o) == {("small_window", None, None, "w1", 0), ("thin_field", "x", None, None, 10)}
    assert "Field x was not evaluated: it has 10" in diagnose.messages(o.warnings).where("kind = 'thin_field'").first().message
    o = diagnose.numeric_range(whole, ["x"], W)
    assert o.status == "ok" and o.findings.count() == detect.numeric_range(whole, ["x"], W).count() and o.total == 600
    late = whole.where("timestamp >= '2024-01-11'")
    o = diagnose.proportion_shift(late, ["k"], W)
    assert o.status == "insufficient_data" and ("no_baseline", None, None, "base", 0) in said(o)
    o = diagnose.drift(thin, ["x"], ["k"], W)
    assert o.status == "insufficient_data" and {("skipped_test", "x", None, "w1", 0), ("skipped_test", "k", None, "w1", 0)} <= said(o)
    o = diagnose.frequency(thin, "k", 86400)
    assert o.status == "insufficient_data" and ("thin_series", None, "v0", None, 1) in said(o)
    o = diagnose.frequency_windowed(whole, "k", 5 * 86400, W)
    assert o.status == "insufficient_data" and {("few_buckets", None, None, "base", 1), ("short_window", None, None, "w1", 0)} <= said(o)
    o = diagnose.sequence_novelty(late, "k", 2, W)
    assert o.status == "insufficient_data" and ("no_baseline_sequences", None, None, "base", 0) in said(o)
    assert diagnose.sequence_novelty(whole, "k", 2, W).status == "ok" and diagnose.timestamp_order(whole).status == "ok"


def test_groups_are_named_with_what_was_done_with_them(spark, monkeypatch):
    monkeypatch.setattr(detect, "MOST_CHARACTERS", 60)
    wide = "".join(chr(0x4E00 + i) for i in range(80))
    rows = [("s", i % 200, {"k": f"v{i}", "g": "own"}) for i in range(40)] + [("s", i % 200, {"k": f"t{i}", "g": "thin"}) for i in range(3)]
    rows += [("s", i, {"k": wide[i : i + 40] + str(i), "g": "wide"}) for i in range(40)]
    rows += [("s", 241, {"k": "n~1", "g": "new"}), ("s", 241, {"k": "t~", "g": "thin"}), ("s", 242, {"k": "v~", "g": "own"}), ("s", 242, {"k": "w", "g": "wide"})]
    o = diagnose.charset(ev(spark, rows), ["k"], W, "g")
    assert o.status == "ok"
    assert {x[:4] for x in said(o)} == {("small_window", None, None, "w1"), ("thin_group", "k", "thin", None), ("absent_group", "k", "new", None), ("wide_group", "k", "wide", None)}
    assert sorted((r.grp, r.basis) for r in o.findings.collect()) == [("new", "fallback"), ("own", "own"), ("thin", "fallback")]
    alone = diagnose.charset(ev(spark, rows[40:43] + [("s", 241, {"k": "q", "g": "thin"})]), ["k"], W, "g")
    assert alone.status == "insufficient_data" and {x[0] for x in said(alone)} == {"small_window", "unmeasured_group"}


def test_busy_stretches_are_cut(spark, monkeypatch):
    """Most rows fall into one minute, others have no offset: results are those of whole sorts, and no stretch is large."""
    from eventlens.functions import storage

    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        at = start + timedelta(milliseconds=rng.randrange(60_000) if i % 10 else rng.randrange(10_000_000))
        rows.append((f"e{i:04d}", "s", at, {"k": f"v{i % 4}"}, None if i % 3 else i * 100, i))
    df = spark.createDataFrame(rows, "event_id string, source_id string, timestamp timestamp, attributes map<string,string>, byte_offset long, line_number long").withColumns({"message": F.lit("m"), "artifact": F.lit("a"), "display_name": F.lit("d")})
    monkeypatch.setattr(storage, "STRETCH", 50)
    cut = storage.stretches(df.withColumns({"ms": F.unix_millis("timestamp"), "hour": F.lit(0)}), ["source_id"], "hour", F.floor(F.col("ms") / 10))
    sizes = [r["count"] for r in cut.groupBy("hour").count().collect()]
    assert sum(sizes) == 1500 and max(sizes) <= 60 and len(sizes) >= 25
    plan = [lambda: sorted((tuple(r.gram), tuple(r.ids)) for r in detect.ngrams(df, "k", 3).collect()), lambda: sorted((r.event_id, r.back_ms) for r in detect.order_violations(df, 1).collect())]
    small = [f() for f in plan]
    monkeypatch.setattr(storage, "STRETCH", 1_000_000)
    assert small == [f() for f in plan]
    ordered = sorted(rows, key=lambda r: (r[2], r[4] is not None, r[4] or 0, r[5], r[0]))
    assert small[0] == sorted((tuple(x[3]["k"] for x in w), tuple(x[0] for x in w)) for w in zip(ordered, ordered[1:], ordered[2:]))


@pytest.mark.parametrize("least", [0.95, 0.6, -0.2])
def test_groups_of_centroids_without_all_pairs(spark, least):
    from eventlens.operators import similarity

    rng = np.random.default_rng(3)
    mid = rng.normal(size=(12, 16))
    v = mid[rng.integers(0, 12, 240)] + 0.15 * rng.normal(size=(240, 16))
    rows = [(f"g{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("zero", [0.0] * 16), ("none", None)]
    centers = spark.createDataFrame(rows, "label string, centroid array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    root = list(range(240))
    for _ in range(240):
        new = [min(root[j] for j in range(240) if near[i, j]) for i in range(240)]
        if new == root:
            break
        root = new
    want = {f"g{i:03d}": f"g{r:03d}" for i, r in enumerate(root)} | {"zero": "zero", "none": "none"}
    assert {r.label: r.root for r in similarity.groups(centers, "label", least).collect()} == want
    pairs = {(r.a, r.b) for r in similarity.near_pairs(centers, "label", least).select("a", "b").collect()}
    assert {(f"g{i:03d}", f"g{j:03d}") for i, j in zip(*np.nonzero(near)) if i < j} <= pairs
    assert len(pairs) == similarity.near_pairs(centers, "label", least).count()  # each once
    if least == 0.95:
        assert len(pairs) < 0.25 * 240 * 239 / 2
    c = similarity.cohesion(centers, "label").first()
    assert c.pairs == 240 * 239 // 2 and c.cohesion == pytest.approx((unit @ unit.T)[np.triu_indices(240, 1)].mean(), abs=1e-6)
