"""CSV timelines: headers of their own, stray quotes; file hashes, addresses of both families, cleared annotations."""

import csv
import hashlib
import io
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from eventlens.operators import enrich, rules
from eventlens.sources import text, timelines


def by_file(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.byte_offset):
        out.setdefault(r.source_file.rsplit("/", 1)[-1], []).append(r)
    return out


def test_files_of_a_folder_have_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('message,datetime,user\nfirst,2024-01-01T00:00:00Z,u1\n"with, comma",2024-01-02T00:00:00Z,u2\n')
    (tmp_path / "b.csv").write_text("datetime;host;Message;host\n2024-02-01T00:00:00Z;h1;second;h2\n;;;\n")
    (tmp_path / "c.tsv").write_text("﻿MSG\tx|y\nthird\t1|2\n")
    (tmp_path / "d.csv").write_text("")
    got = by_file(timelines.read_csv(spark, str(tmp_path)))
    assert [(r.message, r.timestamp.year, r.attributes) for r in got["a.csv"]] == [("first", 2024, {"user": "u1"}), ("with, comma", 2024, {"user": "u2"})]
    assert [(r.message, r.timestamp and r.timestamp.month, r.attributes) for r in got["b.csv"]] == [("second", 2, {"host": "h2"}), ("", None, {})]
    assert [(r.message, r.attributes) for r in got["c.tsv"]] == [("third", {"x|y": "1|2"})]
    assert "d.csv" not in got


def test_a_quote_that_is_never_closed_costs_its_own_line(spark, tmp_path):
    lines = ["message,k", 'a 5" disk,1', '"open,2', "plain,3", 'say ""x"",4', "last,5", '"two', 'lines",6', "end,7"]
    (tmp_path / "a.csv").write_text("\n".join(lines[:6]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([lines[0], *lines[6:]]) + "\n")
    got = by_file(timelines.read_csv(spark, str(tmp_path)))
    assert [(r.message, r.attributes.get("k")) for r in got["a.csv"]] == [('a 5" disk', "1"), ("open,2", None), ("plain", "3"), ('say ""x""', "4"), ("last", "5")]
    assert [(r.message, r.attributes["k"]) for r in got["b.csv"]] == [("two\nlines", "6"), ("end", "7")]


def test_an_open_quote_reaches_no_further_than_its_bound(spark, tmp_path):
    lines = ["message,k", '"open,1', *[f"row {i},{i}" for i in range(2, 60)], '"closes",60', '"kept', 'whole",61']
    (tmp_path / "a.csv").write_text("\n".join(lines))
    got = by_file(timelines.read_csv(spark, str(tmp_path), longest=100))["a.csv"]
    assert [r.message for r in got][1:-2] == [f"row {i}" for i in range(2, 60)] and got[-2].message == "closes" and got[-1].message == "kept\nwhole"


def random_cell(rng):
    return "".join(rng.choice(['a', 'b c', ',', '"', '\n', 'é', '']) for _ in range(rng.randrange(5)))


@pytest.mark.parametrize("seed", range(3))
def test_records_are_those_of_the_csv_module(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [[str(i), random_cell(rng), random_cell(rng), "x"] for i in range(300)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "message", "b", "c"], *rows])
    (tmp_path / "t.csv").write_text(out.getvalue())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = timelines.read_csv(spark, str(tmp_path / "t.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.attributes["id"]: (r.message, r.attributes.get("b", "")) for r in got} == {r[0]: (r[1], r[2]) for r in rows}


def test_hashes_of_files_of_any_size(spark, tmp_path):
    big = 3 << 30
    (tmp_path / "small").write_bytes(b"x" * 1000)
    (tmp_path / "middle").write_bytes(bytes(range(256)) * 400)
    with (tmp_path / "big").open("wb") as f:  # 3 GB without a block on disk
        f.truncate(big)
        f.seek(big - 3)
        f.write(b"end")
    want = {}
    for p in tmp_path.iterdir():
        with p.open("rb") as f:
            want[p.name] = hashlib.file_digest(f, "sha256").hexdigest()
    got = {r.source_file.rsplit("/", 1)[-1]: r.file_hash for r in text.file_hashes(spark, str(tmp_path), whole=50_000).collect()}
    assert got == want  # Spark lists no empty files


def test_a_large_file_is_held_in_pieces(tmp_path):
    import resource

    import pandas as pd

    with (tmp_path / "big").open("wb") as f:
        f.truncate(1 << 30)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    next(iter(text._streamed(iter([pd.DataFrame({"source_file": [f"file://{tmp_path}/big"]})]))))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kilobytes


def test_ranges_of_both_families(spark):
    rng = random.Random(3)
    nets = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/25", "192.168.0.0/16", "0.0.0.0/5", "2001:db8::/32", "2001:db8:1::/48", "2001:db8:1:2::/63", "fe80::/10", "::/1", "::1/128")]
    spans = [(str(n.network_address), str(n.broadcast_address), str(n)) for n in nets]
    spans += [("10.9.0.3", "10.9.1.200", "odd4"), ("2001:db9::5", "2001:db9::1:0:77", "odd6"), ("9.0.0.1", "8.0.0.1", "turned"), ("x", "10.0.0.1", "bad"), (None, None, "none")]
    ranges = spark.createDataFrame(spans, "lo string, hi string, zone string")
    values = [str(ipaddress.ip_address(int(n.network_address) + rng.randrange(n.num_addresses))) for n in nets for _ in range(20)]
    values += ["10.9.0.2", "10.9.0.3", "10.9.1.200", "10.9.1.201", "2001:db9::4", "2001:DB9:0::5", "2001:db9::1:0:77", "2001:db9::1:0:78", "::ffff:10.1.2.3", "2001:db8:0:0:0:0:0:1", "11.0.0.1", "nonsense", "1:2", "300.1.1.1", None, ""]
    values = sorted(set(values), key=str)
    number = lambda a: int(a) + (0xFFFF00000000 if a.version == 4 else 0)
    parsed = []
    for lo, hi, zone in spans[: len(nets) + 2]:
        a, b = number(ipaddress.ip_address(lo)), number(ipaddress.ip_address(hi))
        parsed.append((b - a, a, b, zone))
    want = {}
    for v in values:
        try:
            x = number(ipaddress.ip_address(v))
        except ValueError:
            continue
        held = sorted(p for p in parsed if p[1] <= x <= p[2])
        if held:
            want[v] = held[0][3]
    got = enrich.ranges_of(spark.createDataFrame([(v,) for v in values], "val string"), ranges, ["zone"])
    assert {r.val: r.zone for r in got.collect()} == want
    assert enrich.ranges_of(spark.createDataFrame([("10.0.0.1",)], "val string"), ranges.where("false"), ["zone"]).count() == 0


def test_addresses_in_attributes(spark):
    df = spark.createDataFrame([({"a": "10.0.0.1", "b": "::1", "c:zone": "10.0.0.9", "d": "12:30:05", "e": "2001:DB8::A", "f": "text"},)], "attributes map<string,string>")
    assert {r.val for r in enrich.address_values(df).collect()} == {"10.0.0.1", "::1", "2001:DB8::A"}


def test_rules_that_were_run_lose_their_old_hits(spark):
    old = spark.createDataFrame([("1", "r1", False), ("2", "r1", True), ("3", "r2", False), ("4", "r3", False)], "event_id string, rule string, confirmed boolean")
    hits = spark.createDataFrame([("5", "r2"), ("5", "r2"), ("2", "r1x")], "event_id string, rule string")
    got = {tuple(r) for r in rules.annotate(old, hits, ["r1", "r2", "r1x"]).collect()}
    assert got == {("2", "r1", True), ("5", "r2", False), ("2", "r1x", False), ("4", "r3", False)}
    none = hits.where("false")
    assert {tuple(r) for r in rules.annotate(old, none, ["r1"]).collect()} == {("2", "r1", True), ("3", "r2", False), ("4", "r3", False)}
    assert rules.annotate(old, none).count() == 4
