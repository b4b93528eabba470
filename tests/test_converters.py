"""System and network log lines, one program and kind after another, and awkward ones."""

import pytest

from eventlens.sources import logs, zeek


def system(spark, *lines, year=2024):
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    return {r.raw: r for r in logs.syslog(df, year).collect()}


HEADERS = {
    "Jan  5 10:00:00 h1 app[3]: x": "2024-01-05 10:00:00",
    "<13>Jan 15 10:00:00 h1 app: x": "2024-01-15 10:00:00",
    "2024-01-05T12:00:00.123456789+02:00 h1 app: x": "2024-01-05 10:00:00.123456",
    "2024-01-05T12:00:00+0200 h1 app: x": "2024-01-05 10:00:00",
    "<30>2024-01-05 10:00:00Z h1 app: x": "2024-01-05 10:00:00",
    "2024-13-05T12:00:00Z h1 app: x": "None",
}


def test_headers(spark):
    got = system(spark, *HEADERS, "no header", "", None)
    assert {k: str(got[k].timestamp) for k in HEADERS} == HEADERS
    assert all(got[k].ok and got[k].message == "x" for k in HEADERS)
    assert not got["no header"].ok and not got[""].ok and not got[None].ok
    assert system(spark, "Jan  5 10:00:00 h1 app: x", year=None)["Jan  5 10:00:00 h1 app: x"].timestamp is None


LINES = [
    ("sshd: Accepted publickey for bob from 10.0.0.1 port 5 ssh2: RSA SHA256:xyz", "ssh_login", {"method": "publickey", "user": "bob", "src_ip": "10.0.0.1", "src_port": "5", "key_fingerprint": "SHA256:xyz"}),
    ("sshd: Accepted password for bob from ::1 port 5 ssh2", "ssh_login", {"method": "password", "user": "bob", "src_ip": "::1", "src_port": "5"}),
    ("sshd: Failed password for invalid user eve from 10.0.0.1 port 5 ssh2", "ssh_failed", {"method": "password", "user": "eve", "src_ip": "10.0.0.1", "src_port": "5", "invalid_user": "true"}),
    ("sshd: Failed password for bob from 10.0.0.1 port 5 ssh2", "ssh_failed", {"method": "password", "user": "bob", "src_ip": "10.0.0.1", "src_port": "5"}),
    ("sshd: Invalid user eve from 10.0.0.1 port 5", "ssh_invalid_user", {"user": "eve", "src_ip": "10.0.0.1", "src_port": "5"}),
    ("sshd: Received disconnect from 10.0.0.1 port 5:11: bye", "ssh_disconnect", {"src_ip": "10.0.0.1", "src_port": "5"}),
    ("sshd: Disconnected from authenticating user bob 10.0.0.1 port 5 [preauth]", "ssh_disconnect", {"user": "bob", "src_ip": "10.0.0.1", "src_port": "5"}),
    ("sudo: bob : TTY=pts/0 ; PWD=/a;b ; USER=root ; COMMAND=/bin/x ; y", "sudo_command", {"user": "bob", "tty": "pts/0", "cwd": "/a;b", "target_user": "root", "command": "/bin/x ; y"}),
    ("sudo: bob : 3 incorrect password attempts ; TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/x", "sudo_failed", {"user": "bob"}),
    ("sudo: pam_unix(sudo:auth): authentication failure; logname=", "sudo_failed", {}),
    ("su: Successful su for root by bob", "su", {"target_user": "root", "user": "bob"}),
    ("su-l: FAILED su for root by bob", "su_failed", {"target_user": "root", "user": "bob"}),
    ("crond[1]: (root) CMD (a (b) c)", "cron_command", {"user": "root", "command": "a (b) c"}),
    ("useradd: new group: name=dev, GID=5", "group_added", {"group": "dev", "gid": "5"}),
    ("chage: changed password expiry for bob", "user_changed", {"user": "bob"}),
    ("passwd: password for 'bob' changed by 'root'", "password_changed", {"user": "bob"}),
    ("sshd: pam_unix(sshd:session): session opened for user bob(uid=1000) by (uid=0)", "session_opened", {"user": "bob"}),
    ("app: 1.2.3.999 5.6.7.8.9 then 192.0.2.7, 192.0.2.8", None, {"src_ip": "192.0.2.7"}),
    ("app: tricks\x1eevent\x1fssh_login", None, {}),
    ("su: Successful su for x\x1fy by bob\x1euser\x1froot", "su", {"target_user": "x", "user": "bob"}),
]


@pytest.fixture(scope="module")
def found(spark):
    return system(spark, *[f"Jan  5 10:00:00 h1 {line}" for line, _, _ in LINES])


@pytest.mark.parametrize("line, event, attributes", LINES)
def test_lines_of_programs(found, line, event, attributes):
    r = found[f"Jan  5 10:00:00 h1 {line}"]
    got = {k: v for k, v in r.attributes.items() if k not in ("host", "program", "pid")}
    if "\x1f" in line and event:  # separators in a text cannot add names, nor replace what was found
        assert r.ok and got.get("event", event) == event and got.get("user") != "root"
    else:
        assert r.ok and got.pop("event", None) == event and got == attributes


def network(spark, *lines, name="a/b.log"):
    df = spark.createDataFrame([(name, i * (5 << 20), x) for i, x in enumerate(lines)], "source_file string, byte_offset long, raw string")
    return zeek.zeek(df).orderBy("byte_offset").collect()


def test_separators_and_markers(spark):
    got = network(
        spark, "#separator \\x2c", "#unset_field,NA", "#empty_field,none", "#path,smtp", "#fields,ts,mailfrom,rcptto,subject", "1,a@x,NA,none", "2,a|b,c.d,-", "3,too,few",
        "#separator \\x09", "#path\tftp", "#fields\tts\tcommand\targ", "4\tRETR\tf,g", "#close\t2024-01-01-00-00-00", "#fields_of\tx", "5\tSTOR\t(empty)",
    )
    assert [(r.message, r.ok) for r in got if r.ok] == [("mail from a@x", True), ("mail from a|b to c.d", True), ("ftp RETR f,g", True), ("ftp STOR", True)]
    assert [r.ok for r in got] == [True, True, False, True, True]
    assert got[0].artifact == "zeek:smtp" and got[0].timestamp_desc == "SMTP Message Time" and got[0].attributes["event"] == "message"


def test_times_and_kinds_that_are_not_named(spark):
    got = network(spark, "1\tbefore fields", "#fields\tts\tuid", "-\tu1", "#open\t2024-01-01-10-00-00", "-\tu2", "soon\tu3", "1.5\tu4", "", None)
    assert [(r.ok, str(r.timestamp)) for r in got] == [(False, "None"), (True, "None"), (True, "2024-01-01 10:00:00"), (False, "None"), (True, "1970-01-01 00:00:01.500000")]
    assert {r.artifact for r in got} == {"zeek:b.log"} and got[1].attributes == {"uid": "u1", "event": "log", "zeek_log": "b.log"}


def test_flows_and_addresses_of_requests(spark):
    flow = "ts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p"
    got = network(spark, "#path\thttp", f"#fields\t{flow}\tmethod\thost\turi", "1\t10.0.0.1\t5\t10.0.0.2\t80\tGET\th\t/x", "#path\trdp", f"#fields\t{flow}\tcookie\turl", "1\t::1\t5\t::2\t3389\tbob\tu")
    ends = {"src_ip": "10.0.0.1", "src_port": "5", "dst_ip": "10.0.0.2", "dst_port": "80"}
    assert got[0].attributes == {**ends, "method": "GET", "host": "h", "url": "h/x", "event": "request", "zeek_log": "http"}
    assert got[1].message == "rdp ::1:5 -> ::2:3389 bob" and got[1].attributes["url"] == "u"
    assert network(spark) == []
