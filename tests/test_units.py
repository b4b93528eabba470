"""Semantics that SQL cannot express, on hand-made rows."""

import hashlib
import ipaddress
import math
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.functions import fields, normalize, ranks, stats
from eventlens.operators import charts, detect, enrich, explore, rules, similarity, verdicts
from eventlens.plans import filters as P
from eventlens.plans.windows import AnalysisWindows, Window
from eventlens.sources import logs, text, timelines

EVENT = "event_id string, source_id string, byte_offset long, line_number long, timestamp timestamp, message string, artifact string, tags array<string>, attributes map<string,string>"


def ev(spark, rows):
    full = []
    for i, r in enumerate(rows):
        ts, attributes = r[0], r[1]
        full.append((f"e{i:04d}", r[2] if len(r) > 2 else "s1", i * 10, i, ts and datetime.fromisoformat(ts), "m", "a", [], attributes))
    return spark.createDataFrame(full, EVENT)


def test_p_values():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert stats.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert stats.chi2_sf(0, 3) == 1
    assert stats.normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-14)
    assert 2 * stats.t_sf(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert stats.r_p(0.5, 30) == pytest.approx(0.004904, abs=1e-5)
    assert stats.r_p(1.0, 10) == 0 and stats.r_p(0.3, 2) is None
    assert stats.ks_p(0.0, 50, 50) == 1 and stats.ks_p(0.5, 200, 200) < 1e-10


def test_shapiro():
    w, p = stats.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.001)
    assert stats.shapiro_wilk(np.ones(10)) is None and stats.shapiro_wilk(np.array([1.0, 2.0])) is None
    w, p = stats.shapiro_wilk(np.array([stats.normal_quantile((i + 0.5) / 200) for i in range(200)]))
    assert w > 0.99 and p > 0.9


def test_kendall():
    rng = np.random.default_rng(1)
    for _ in range(5):
        x, y = rng.integers(0, 8, 60), rng.integers(0, 8, 60)
        dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        want = (dx * dy).sum() / math.sqrt((dx * dx).sum() * (dy * dy).sum())
        assert stats.kendall(x, y)[0] == pytest.approx(want, abs=1e-12)
    assert stats.kendall(np.ones(5), np.arange(5)) is None


def test_fdr(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "i int, p double")
    got = {r.i: r.q for r in stats.benjamini_hochberg(df).collect()}
    assert [round(got[i], 6) for i in range(4)] == [0.02, 0.04, 0.04, 0.02]


def test_uuid5(spark):
    names = ["", "a", "né\nb", "x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", normalize.uuid5(F.col("n")).alias("u"))
    assert {r.n: r.u for r in df.collect()} == {n: str(uuid.uuid5(normalize.NAMESPACE, n)) for n in names}


def test_addresses(spark):
    values = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "FE80:0:0::1", "::ffff:1.2.3.4", "x", "", None, "1::2::3"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", normalize.normalize_ip(F.col("v")).alias("ip"))

    def want(v):
        try:
            return str(ipaddress.ip_address(v)) if v else ""
        except ValueError:
            return ""

    assert {r.v: r.ip for r in df.collect()} == {v: want(v) for v in values}


def test_times(spark):
    cases = {
        "2024-03-01T10:00:00Z": "2024-03-01 10:00:00", "2024-03-01T10:00:00+02:00": "2024-03-01 08:00:00", "2024-03-01 10:00:00.25": "2024-03-01 10:00:00.250", "1709287200": "2024-03-01 10:00:00",
        "1709287200123": "2024-03-01 10:00:00.123", "1709287200123456": "2024-03-01 10:00:00.123", "01/Mar/2024:10:00:00 +0000": "2024-03-01 10:00:00", "no": None, "": None, "12": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.unix_millis(normalize.parse_time(F.col("t"))).alias("ms"))
    got = {r.t: r.ms for r in df.collect()}
    assert got == {k: v and int(datetime.fromisoformat(v + "+00:00").timestamp() * 1000) for k, v in cases.items()}


def test_numbers(spark):
    df = spark.createDataFrame([(v,) for v in ["1", "-2.5", "1e3", "12f", "0x1", "", "nan", "1e400", " 7 "]], "v string")
    got = {r.v: r.x for r in df.select("v", fields.number(F.col("v")).alias("x")).collect()}
    assert got == {"1": 1, "-2.5": -2.5, "1e3": 1000, "12f": None, "0x1": None, "": None, "nan": None, "1e400": None, " 7 ": 7}


def test_windows_are_checked():
    base = Window("b", "2024-01-01", "2024-01-10")
    with pytest.raises(ValueError):
        AnalysisWindows(base, ())
    with pytest.raises(ValueError):
        AnalysisWindows(base, (Window("w", "2024-01-09", "2024-01-12"),))
    with pytest.raises(ValueError):
        AnalysisWindows(base, tuple(Window(f"w{i}", "2024-02-01", "2024-02-02") for i in range(11)))
    with pytest.raises(ValueError):
        AnalysisWindows(base, (Window("w", "2024-02-02", "2024-02-02"),))


def test_mappings_are_checked():
    for bad in ({"time:x": ["a"]}, {"a": []}, {"a": ["x"], "b": ["x"]}, {"message": ["x"]}, {"a": [f"k{i}" for i in range(17)]}):
        with pytest.raises(ValueError):
            fields.check_mappings(bad)
    fields.check_mappings({"ip": ["src_ip", "ip_addr"]})


def test_empty_filter_partitions_rows(spark):
    df = ev(spark, [(None, {"k": ""}), (None, {"k": " "}), (None, {}), (None, {"k": "v"})])
    c = P.Condition("k", mode="empty")
    inc = {r.event_id for r in P.where(df.withColumns({x: F.lit("") for x in ("artifact_long", "display_name", "source_file", "timestamp_desc", "case_id")}), P.EventQuery(include=(c,))).collect()}
    exc = {r.event_id for r in P.where(df, P.EventQuery(exclude=(c,))).collect()}
    assert inc == {"e0000", "e0002"} and exc == {"e0001", "e0003"}


def test_escaping_and_regex_errors(spark):
    df = ev(spark, [(None, {"k": "100%"}), (None, {"k": "100x"}), (None, {"k": "a_b"}), (None, {"k": "a\\b"})])
    got = lambda pattern: {r.event_id for r in P.where(df, P.EventQuery(include=(P.Condition("k", (pattern,), "wildcard"),))).collect()}
    assert got("100%") == {"e0000"} and got("a_b") == {"e0002"} and got("a\\b") == {"e0003"} and got("?00*") == {"e0000", "e0001"}
    with pytest.raises(Exception):
        P.Condition("k", ("(",), "regex")
    with pytest.raises(ValueError):
        P.Condition("k", ("x",), "fuzzy")


def test_paging_is_complete_at_equal_times(spark):
    times = [None] * 7 + ["2024-01-01 00:00:00"] * 9 + ["2024-01-02 00:00:00"] * 4
    df, seen, at = ev(spark, [(t, {}) for t in times]), [], None
    while True:
        rows = explore.page(P.where(df, P.EventQuery(after=at)), 3).collect()
        seen += [r.event_id for r in rows]
        if not rows or not rows[-1].more:
            break
        last = rows[-1]
        at = (last.timestamp and last.timestamp.isoformat(" "), last.event_id)
    assert len(seen) == len(set(seen)) == 20 and seen[:7] == [f"e{i:04d}" for i in range(7)]
    back = explore.page(P.where(df, P.EventQuery(before=at)), 3, backwards=True).collect()
    assert [r.event_id for r in back] == seen[seen.index(at[1]) - 3 : seen.index(at[1])]


def test_sequence_gap_in_elapsed_time(spark):
    rows = [("2024-01-01 00:00:00.900", {"k": "a"}), ("2024-01-01 00:00:02.100", {"k": "b"}), ("2024-01-01 00:00:03.100", {"k": "c"})]
    grams = lambda gap: {tuple(r.gram) for r in detect.ngrams(ev(spark, rows), "k", 2, max_gap=gap).collect()}
    assert grams(1) == {("b", "c")} and grams(1.2) == {("a", "b"), ("b", "c")} and grams(None) == grams(1.2)


W = AnalysisWindows(Window("baseline", "2024-01-01", "2024-01-11"), (Window("w1", "2024-01-11", "2024-01-16"),))


def _every(value, start, step, times, **more):
    t0 = datetime.fromisoformat(start).timestamp()
    return [(datetime.fromtimestamp(t0 + i * step).isoformat(" "), {"k": value, **more}) for i in range(times)]


def test_rhythm(spark):
    rows = _every("steady", "2024-01-01", 3600, 360) + _every("silent", "2024-01-01", 3600, 240) + _every("beacon", "2024-01-11", 600, 700) + _every("faster", "2024-01-01", 3600, 240) + _every("faster", "2024-01-11", 600, 700)
    got = {r.value: r.direction for r in detect.interval_periodicity(ev(spark, rows), "k", W).collect()}
    assert got == {"silent": "missed", "beacon": "new_regularity", "faster": "accelerated"}


def test_shift_and_drift(spark):
    rows = _every("x", "2024-01-01", 3600, 240, n="1") + _every("y", "2024-01-01 00:30:00", 7200, 120, n="2") + _every("x", "2024-01-11", 7200, 60, n="5") + _every("y", "2024-01-11 00:30:00", 1800, 240, n="6")
    df = ev(spark, rows)
    shift = {r.value: r.direction for r in detect.proportion_shift(df, ["k"], W).collect()}
    assert shift == {"x": "down", "y": "up"}
    drift = {(r.field, r.kind): r.direction for r in detect.distribution_drift(df, ["n"], ["k"], W).collect()}
    assert drift == {("n", "ks"): "up", ("k", "g"): "mixed"}


def test_grouped_alphabets(spark):
    rows = [(f"2024-01-0{1 + i % 9} 00:00:00", {"k": f"v{i}", "g": "full"}) for i in range(60)] + [("2024-01-02 00:00:00", {"k": "q", "g": "thin"})]
    rows += [("2024-01-12 00:00:00", {"k": "v1!", "g": "full"}), ("2024-01-12 00:00:00", {"k": "v2?", "g": "thin"}), ("2024-01-12 00:00:00", {"k": "v3~", "g": "absent"})]
    got = {(r.grp, r.chars, r.basis) for r in detect.charset_novelty(ev(spark, rows), ["k"], W, group="g").collect()}
    assert got == {("full", "!", "own"), ("thin", "?", "fallback"), ("absent", "~", "fallback")}


def test_rules_grammar_and_errors(spark):
    df = ev(spark, [(None, {"a": "1", "b": "x"}), (None, {"a": "2"}), (None, {})])
    run = lambda cond, sel: {r.event_id for r in rules.scan(df, {"r": {"selections": sel, "condition": cond}})[0].collect()}
    sel = {"s1": {"a": "1"}, "s2": {"a": 2}, "t": {"b|exists": True}}
    assert run("1 of s*", sel) == {"e0000", "e0001"} and run("all of them", sel) == set()
    assert run("not (s1 or s2)", sel) == {"e0002"} and run("s1 and t or s2", sel) == {"e0000", "e0001"}
    _, errors = rules.scan(df, {"bad": {"selections": {"a": {"x|what": 1}}, "condition": "a"}, "worse": {"selections": {"a": {"x": 1}}, "condition": "a b"}})
    assert set(errors) == {"bad", "worse"}


def test_ipv6_network(spark):
    df = ev(spark, [(None, {"ip": v}) for v in ("2001:db8::1", "2001:db9::1", "10.0.0.1", "x")])
    got = {r.event_id for r in df.where(rules.in_network(fields.attribute("ip"), "2001:db8::/32")).collect()}
    assert got == {"e0000"}


def test_enrichment_shrinks(spark):
    df = ev(spark, [(None, {"ip": "10.0.0.1", "x": "y"})])
    first = spark.createDataFrame([("10.0.0.1", "Z", "7")], "val string, zone string, asn string")
    once = enrich.apply_enrichment(df, enrich.enrichment(df, first, ["zone", "asn"]), ["zone", "asn"])
    assert once.first().attributes == {"ip": "10.0.0.1", "x": "y", "ip:zone": "Z", "ip:asn": "7"}
    again = enrich.apply_enrichment(once, enrich.enrichment(once, first.select("val", "zone"), ["zone"]), ["zone", "asn"])
    assert again.first().attributes == {"ip": "10.0.0.1", "x": "y", "ip:zone": "Z"}


def test_similarity_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in similarity.nearest_to_vector(df, [1, 0], 5).collect()] == [(1, 1.0), (3, 0.707107)]
    assert similarity.nearest_to_event(df, 9)[0] == "vector_not_found" and similarity.nearest_to_event(df, 4)[0] == "not_embedded"


def test_csv_and_xml(spark, tmp_path):
    (tmp_path / "a.csv").write_text('message|datetime|timestamp|tag|extra\n"two\nlines ""q"""|2024-01-01T00:00:00Z||"a,b"|1\nplain|2024-01-01T00:00:00Z|1704153600000000|["x", "y"]|\n')
    rows = timelines.read_csv(spark, str(tmp_path / "a.csv")).orderBy("message").collect()
    assert [r.message for r in rows] == ["plain", 'two\nlines "q"'] and rows[0].tags == ["x", "y"] and rows[1].tags == ["a", "b"]
    assert rows[0].timestamp == datetime(2024, 1, 2) and rows[1].timestamp is None and rows[1].attributes == {"extra": "1"} and rows[0].attributes == {}
    (tmp_path / "e.xml").write_text("<Events><Event><System><EventID>4624</EventID><TimeCreated SystemTime='2024-01-01T00:00:00.5Z'/><Computer>pc</Computer></System><EventData><Data Name='TargetUserName'>bob</Data><Data Name='Empty'></Data></EventData></Event></Events>")
    r = logs.windows_xml(spark, str(tmp_path / "e.xml")).first()
    assert r.artifact == "windows:4624" and r.message == "Successful logon user=bob" and r.attributes["host"] == "pc" and r.timestamp == datetime(2024, 1, 1, 0, 0, 0, 500000)


def test_json_lines_skip_garbage(spark):
    df = spark.createDataFrame([('{"msg": "a", "n": {"x": 1}}',), ("[1]",), ("{",), ("",), ('{"MESSAGE": "b", "tag": "p|q"}',)], "raw string")
    got = sorted((r.message, tuple(r.tags), tuple(r.attributes.items())) for r in timelines.from_json_lines(df).collect())
    assert got == [("a", (), (("n", '{"x":1}'),)), ("b", ("p", "q"), ())]


def test_offsets_and_reading_twice(spark, tmp_path):
    (tmp_path / "x.log").write_text("één\ntwo\n\nfour\n", encoding="utf-8")
    rows = text.read_with_offsets(spark, str(tmp_path / "x.log")).orderBy("byte_offset").collect()
    assert [(r.byte_offset, r.line_number, r.raw) for r in rows] == [(0, 1, "één"), (6, 2, "two"), (10, 3, ""), (11, 4, "four")]
    one = spark.createDataFrame([("é",)], "raw string").withColumns({"message": F.lit(""), "timestamp": F.lit(None).cast("timestamp"), "timestamp_desc": F.lit(""), "artifact": F.lit(""), "artifact_long": F.lit(""), "display_name": F.lit(""), "tags": F.array().cast("array<string>"), "attributes": F.create_map().cast("map<string,string>")})
    a, b = text.stamp(one, "c", "s", "p"), text.stamp(one, "c", "s", "p")
    assert a.first().event_id == b.first().event_id and a.first().message == "é" and text.new_events(b, a).count() == 0


def test_run_snapshots(spark):
    """Hashes do not depend on the order of rows or keys, and change with what they cover."""
    found = spark.createDataFrame([("ua", "x", 1)], "field string, value string, n int")
    rows = [("ua", "x", "normal"), ("ua", "y", "dismissed"), (None, None, "normal")]
    disp = lambda r: spark.createDataFrame(r, "field string, value string, kind string")
    make = lambda windows, r: verdicts.snapshot(found, "d", {"b": 1, "a": [2]}, windows, disp(r)).first()
    one, two = make({"x": 1, "y": 2}, rows), make({"y": 2, "x": 1}, rows[::-1])
    assert one == two and one.params == '{"a":[2],"b":1}' and (one.detector, one.field, one.n) == ("d", "ua", 1)
    assert one.windows_hash == hashlib.sha256(b'{"x":1,"y":2}').hexdigest()
    assert make({"x": 1, "y": 3}, rows).windows_hash != one.windows_hash and make({"x": 1, "y": 2}, rows[:2]).dispositions_hash != one.dispositions_hash
    assert make({}, rows[:1] * 2).dispositions_hash != make({}, rows[:1]).dispositions_hash and make({}, []).dispositions_hash


def test_q_values_against_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(500) ** 3, 2)  # many ties
    df = spark.createDataFrame([(i, int(i % 2), float(x)) for i, x in enumerate(p)] + [(900, 0, None)], "i int, pool int, p double")
    got = {r.i: r.q for r in stats.benjamini_hochberg(df, pool=["pool"]).collect()}
    for g in (0, 1):
        own = p[g::2]
        order = np.argsort(own, kind="stable")
        q = np.minimum.accumulate((own[order] * len(own) / np.arange(1, len(own) + 1))[::-1])[::-1]
        for at, value in zip(order, q, strict=True):
            assert got[2 * at + g] == pytest.approx(min(1.0, value))
    assert got[900] is None


def test_quantiles_and_ranks_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=700), np.round(rng.normal(size=300), 1), [5.0] * 400])
    g = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x, strict=True)], "g int, x double")
    got = {r.g: r.q for r in ranks.quantiles(df, ["g"], "x", (0.0, 0.1, 0.5, 0.93, 1.0)).collect()}
    for k in range(3):
        assert got[k] == pytest.approx(np.quantile(x[g == k], (0, 0.1, 0.5, 0.93, 1)))
    assert ranks.quantiles(df, [], "x", (0.25,)).first().q == pytest.approx([np.quantile(x, 0.25)])
    assert ranks.quantiles(df.where("false"), ["g"], "x", (0.5,)).count() == 0
    r = {(row.g, row.x): row.r for row in charts.average_ranks(df, "x", "r", ["g"]).collect()}
    for k in range(3):
        own = x[g == k]
        for v in own[:50]:
            assert r[k, v] == (own < v).sum() + ((own == v).sum() + 1) / 2


def test_grams_over_hours(spark):
    """Runs over the borders of hours, with empty hours between, against a plain loop."""
    rng = np.random.default_rng(6)
    at = np.sort(rng.choice(40_000, 160, replace=False)) * 17
    rows = [((datetime(2024, 1, 1) + timedelta(seconds=int(s))).isoformat(), {"k": f"v{i % 7}"}, f"s{rng.integers(0, 2)}") for i, s in enumerate(at)]
    for gap in (None, 3000.0):
        got = sorted((r.source_id, tuple(r.ids)) for r in detect.ngrams(ev(spark, rows), "k", 3, max_gap=gap).collect())
        want = []
        for source in ("s0", "s1"):
            own = [(i, at[i]) for i, r in enumerate(rows) if r[2] == source]
            for a, b, c in zip(own, own[1:], own[2:]):
                if gap is None or (b[1] - a[1] <= gap and c[1] - b[1] <= gap):
                    want.append((source, tuple(f"e{i:04d}" for i, _ in (a, b, c))))
        assert got == sorted(want)


def test_repeated_ids_are_not_multiplied_in_grouped_alphabets(spark):
    rows = [(f"2024-01-0{1 + i % 9} 00:00:00", {"k": f"v{i % 30}", "g": "a"}) for i in range(60)] + [("2024-01-02 00:00:00", {"k": "v~", "g": "a"})]
    df = ev(spark, rows)
    got = detect.charset_novelty(df.unionByName(df), ["k"], group="g").where("val = 'v~'").collect()
    assert [r.n for r in got] == [2]
