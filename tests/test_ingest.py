"""Reading files: provenance, dirty records, addresses, on data that the test tables lack."""

import csv
import hashlib
import io
import ipaddress

import pytest
from pyspark.sql import functions as F

from eventlens.functions import storage
from eventlens.operators import rules
from eventlens.sources import logs, text, timelines, zeek


def rows(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "raw string")


def test_offsets_and_numbers_of_lines(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        for name, end in (("a.log", b"\n"), ("b.log", b"")):
            (tmp_path / name).write_bytes("\n".join(f"{name} zeile {i} é" + "x" * (i % 60) for i in range(100)).encode() + end)
        (tmp_path / "c.log").write_bytes(b"one\r\ntwo\r\n\r\nfour")
        got = text.read_with_offsets(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("a.log", "b.log", "c.log"):
        raw, at, want = (tmp_path / name).read_bytes(), 0, []
        for n, line in enumerate(raw.split(b"\n"), 1):
            if line or at < len(raw):
                want.append((at, n, line.decode().rstrip("\r")))
            at += len(line) + 1
        assert sorted((r.byte_offset, r.line_number, r.raw) for r in got if r.source_file.endswith(name)) == want


CSV = 'Message;DateTime;tag;ua;ua\n"first\nof ""two"" lines";2024-01-01T00:00:00Z;a,b;x;y\nplain;;;;z\n\n"again\n\nand again";1704067200;;;\n"last";no;"[""q""]";1;2'


def test_csv_records_have_provenance(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    out = text.stamp(timelines.read_csv(spark, str(tmp_path / "t.csv")).withColumn("file_hash", F.lit("f")), "c", "s", "csv")
    got = sorted(out.collect(), key=lambda r: r.byte_offset)
    want = list(csv.reader(io.StringIO(CSV), delimiter=";"))[1:]
    want = [w for w in want if w]
    assert [r.message for r in got] == [w[0] for w in want]
    assert len({r.event_id for r in got}) == 4 and len({r.content_hash for r in got}) == 4
    raw = CSV.encode()
    for r, end in zip(got, [*[r.byte_offset for r in got[1:]], len(raw)], strict=True):
        assert hashlib.sha256(raw[r.byte_offset : end].strip(b"\n")).hexdigest() == r.content_hash
        assert r.line_number == raw[: r.byte_offset].count(b"\n") + 1
    assert got[0].attributes == {"ua": "y"} and got[0].tags == ["a", "b"] and got[3].tags == ["q"]
    assert text.new_events(out.unionByName(out), out.where("false")).count() == 4
    assert text.new_events(out, out).count() == 0


def test_an_empty_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("")
    assert timelines.read_csv(spark, str(tmp_path / "t.csv")).count() == 0
    (tmp_path / "h.csv").write_text("message,datetime\n")
    assert timelines.read_csv(spark, str(tmp_path / "h.csv")).count() == 0


def test_rows_without_provenance_are_refused(spark):
    parsed = timelines.from_json_lines(rows(spark, '{"message":"m"}')).drop("raw")
    with pytest.raises(ValueError):
        text.stamp(parsed, "c", "s", "p")


def test_parquet_keeps_its_own_content_hash(spark, tmp_path):
    row = ("f", "h", 7, "own", "m", None, "", "", "", "", ["t"], {"k": "v"})
    spark.createDataFrame([row], ", ".join(f"{c} {t}" for c, t in timelines.INTERCHANGE.items())).write.parquet(str(tmp_path / "x"))
    got = text.stamp(timelines.read_parquet(spark, str(tmp_path / "x")), "c", "s", "p").collect()
    assert [r.content_hash for r in got] == ["own"]


@pytest.mark.parametrize("raw, want", [('{"a":1,"a":2}', {"a": "2"}), ('{"A":1,"a":2}', {"A": "1", "a": "2"}), ('{"msg":"x","MSG":"y","k":"v"}', {"k": "v"})])
def test_repeated_and_clashing_keys_of_json_lines(spark, raw, want):
    got = timelines.from_json_lines(rows(spark, raw, '{"cut', "[1]", '{"fine":"1"}')).collect()
    assert [r.attributes for r in got] == [want, {"fine": "1"}]
    size = timelines.from_json_lines(rows(spark, raw)).select(F.size("attributes"), F.col("attributes")["a"]).first()
    assert tuple(size) == (len(want), want.get("a"))


def test_flattened_keys_may_clash(spark):
    got = rows(spark, '{"a":{"b":1},"a.b":2}', '{"x":1,"x":2}').select(logs.flat_json(F.col("raw")).alias("m")).collect()
    assert [r.m for r in got] == [{"a.b": "2"}, {"x": "2"}]


@pytest.mark.parametrize("parse, raw", [
    (logs.suricata, '{"event_type":"dns","timestamp":"2024-01-01T00:00:00.000000+0000","dns":{"type":"q"},"dns.type":"r","src_ip":"1.1.1.1","src_ip":"2.2.2.2"}'),
    (logs.cowrie, '{"eventid":"e","timestamp":"2024-01-01T00:00:00Z","geo":{"port":1},"geo.port":"2"}'), (logs.journal, '{"__REALTIME_TIMESTAMP":"1","MESSAGE":"a","MESSAGE":"b","x":"1","x":"2"}'),
    (logs.web_honeypot, '{"timestamp":"2024-01-01T00:00:00Z","method":"GET","headers":{"Host":"a","host":"b"},"url":"/?a=1&a=2"}'), (logs.windows_json, '{"Event":{"System":{"EventID":1},"EventData":{"a":"1","a":"2"}}}'),
])
def test_dirty_records_of_log_families(spark, parse, raw):
    got = parse(rows(spark, raw, "{broken", "")).collect()
    assert len(got) == 3 and sorted(r.ok for r in got) == [False, False, True]


def test_hashes_of_files(spark, tmp_path):
    for name, body in (("a", b"one\n"), ("b", b"two"), ("c", b"one\n")):
        (tmp_path / name).write_bytes(body)
    got = text.file_hashes(spark, str(tmp_path))
    assert {r.source_file.rsplit("/", 1)[-1]: r.file_hash for r in got.collect()} == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    known = spark.createDataFrame([(hashlib.sha256(b"two").hexdigest(),)], "file_hash string")
    assert sorted(r.source_file[-1] for r in text.new_files(got, known).collect()) == ["a"]


ADDRESSES = ["2001:db8::1", "2001:db8:8000::", "2001:DB8:7fff:ffff::", "2001:db8::", "::", "::1", "fe80::1%eth0", "::ffff:10.0.0.1", "::10.0.0.1", "1.2.3.4", "2001:db8", "x::y", "", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "2001::db8::1", "a::", "2001:db8:0:0:0:0:0:1"]


@pytest.mark.parametrize("network", ["2001:db8:8000::/33", "2001:db8::/32", "2001:db8::/34", "::/0", "::/127", "2001:db8::1/128", "fe80::/10", "::ffff:0:0/96", "10.0.0.0/9", "0.0.0.0/0"])
def test_networks_of_any_prefix(spark, network):
    net = ipaddress.ip_network(network)

    def inside(v):
        try:
            return "%" not in v and ipaddress.ip_address(v) in net
        except ValueError:
            return False

    df = spark.createDataFrame([(v,) for v in [*ADDRESSES, None]], "v string")
    got = {r.v: r.hit for r in df.select("v", rules.in_network(F.col("v"), network).alias("hit")).collect()}
    assert got == {v: inside(v) for v in ADDRESSES} | {None: False}


def test_running_sums(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"), F.floor(F.col("id") / 7).alias("b"))
    got = {r.x: r.s for r in storage.running_sums(df, ["g"], "b", ["x"], {"s": F.col("x")}).collect()}
    assert got == {x: sum(y for y in range(x) if y % 3 == x % 3) for x in range(200)}


def test_deep_objects_are_flattened(spark):
    got = rows(spark, '{"a":{"b":{"c":{"d":1,"e":[1,2]}}},"f":"{not json"}').select(logs.flat_json(F.col("raw")).alias("m")).first().m
    assert got == {"a.b.c.d": "1", "a.b.c.e": "[1,2]", "f": "{not json"}


@pytest.mark.parametrize("line, event, attributes", [
    ("sudo: pam_unix(sudo:session): session opened for user root(uid=0) by bob(uid=1000)", "session_opened", {"user": "root"}), ("CRON[1]: pam_unix(cron:session): session closed for user bob", "session_closed", {"user": "bob"}),
    ("su[2]: FAILED SU (to root) bob on pts/1", "su_failed", {"user": "bob", "target_user": "root"}), ("groupadd[3]: new group: name=dev, GID=1001", "group_added", {"group": "dev", "gid": "1001"}),
    ("sshd[4]: Connection closed by invalid user x 10.0.0.1 port 22 [preauth]", "ssh_closed", {"user": "x", "src_ip": "10.0.0.1", "src_port": "22"}), ("systemd[1]: Started Daily job.", "service", {"state": "Started", "service": "Daily job"}), ("passwd[9]: password changed for eve", "password_changed", {"user": "eve"}), ("app: hello", None, {}), ("usermod[5]: add 'bob' to group 'sudo'", "user_changed", {"user": "bob"}),
])
def test_rules_of_syslog_lines(spark, line, event, attributes):
    r = logs.syslog(rows(spark, f"Jan  5 10:00:00 h1 {line}"), 2024).first()
    got = {k: v for k, v in r.attributes.items() if k not in ("host", "program", "pid")}
    assert r.ok and got.pop("event", None) == event and got == attributes


def test_forms_of_network_logs(spark):
    flow = "ts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p"
    lines = ["#path\tssl", f"#fields\t{flow}\tserver_name\tversion", "1\t10.0.0.1\t5\t10.0.0.2\t443\th.example\tTLSv13", "#path\tnotice", "#fields\tts\tnote\tmsg", "2\tScan\tmany ports", "#path\tweird", "#fields\tts\tname\taddl", "3\todd\t-", "4\tshort"]
    df = spark.createDataFrame([("f", i * (9 << 20), x) for i, x in enumerate(lines)], "source_file string, byte_offset long, raw string")
    got = zeek.zeek(df).orderBy("byte_offset").collect()
    assert [(r.message, r.ok) for r in got][:3] == [("tls 10.0.0.1:5 -> 10.0.0.2:443 h.example TLSv13", True), ("notice Scan many ports", True), ("weird odd", True)] and not got[3].ok
