"""Edge lines of both sensors, with expectations computed by plain Python."""

import hashlib
import ipaddress
import json
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lurelog.functions import addresses, text, times
from lurelog.operators import normalize as nz
from lurelog.sources import logs
from lurelog.workload import catalog

T = "2025-01-02T03:04:05.678901Z"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def one(lines, record, sensor=nz.normalize_cowrie, **options):
    line = record if isinstance(record, str) else json.dumps(record)
    return sensor(lines(line), salt="s", **{"redact_free_text": True} | options).first()


def test_login_line(lines):
    row = one(lines, {"eventid": "cowrie.login.failed", "timestamp": T, "src_ip": "::ffff:192.0.2.7",
                      "src_port": 40000, "session": "s1", "username": "root", "password": "aab"})
    assert (row.event_type, row.src_ip_masked, row.src_port) == ("login_fail", "192.0.2.0/24", 40000)
    assert row.src_ip_hash == sha("s|192.0.2.7")[:16]
    assert row.username_hash == sha("s|u|root")[:16]
    assert row.password_hash == sha("s|p|aab")[:16]
    assert row.pass_len == 3 and abs(row.pass_entropy - 0.9182958340544896) < 1e-12
    assert row.src_ip is None and row.username is None and row.password is None
    key = ["cowrie", "ssh", "login_fail", "cowrie.login.failed", "2025-01-02T03:04:05.678901+00:00",
           row.src_ip_hash, "s1", row.username_hash, row.password_hash, "", "", ""]
    assert row.event_hash == sha("|".join(key))


def test_whole_second_has_no_fraction_in_the_fingerprint(lines):
    row = one(lines, {"timestamp": "2025-01-02 03:04:05"})
    key = ["cowrie", "ssh", "other", "", "2025-01-02T03:04:05+00:00"] + [""] * 7
    assert row.event_hash == sha("|".join(key))


def test_rejected_lines(lines):
    bad = ["not json", "[1]", '{"a":1} x', '{"a":1},{"a":2}', '{"a":1}],[{"a":2}', "5", "null", "'a'",
           "{'timestamp':'%s'}" % T, '{"timestamp":"%s"' % T]
    rows = nz.normalize_cowrie(lines(*bad), salt="s", redact_free_text=True).collect()
    assert {r.reject_reason for r in rows} == {nz.BAD_JSON} and len(rows) == len(bad)
    late = ['{}', '{"timestamp":""}', '{"timestamp":"10:00"}', '{"timestamp":"soon"}', '{"timestamp":1e17}']
    rows = nz.normalize_cowrie(lines(*late), salt="s", redact_free_text=True).collect()
    assert {r.reject_reason for r in rows} == {nz.BAD_TIME} and len(rows) == len(late)


def test_reject_keeps_the_whole_line(lines):
    rejected = nz.rejects(nz.normalize_cowrie(lines("x" * 900), salt="s", redact_free_text=True)).first()
    assert (rejected.reason, len(rejected.raw)) == (nz.BAD_JSON, 900)


def test_redaction_is_the_callers_choice(lines):
    with pytest.raises(TypeError):
        nz.normalize_cowrie(lines("{}"), salt="s")


def test_liberal_times(spark):
    second = datetime(2025, 6, 8, 10, 11, 12)
    cases = {
        "2025-06-08 10:11:12,345": second.replace(microsecond=345000), "Jun  8 10:11:12 2025": second,
        "Sun Jun  8 10:11:12 UTC 2025": second, "June 8, 2025 10:11:12": second,
        "Jun 8 2025 10:11:12.5": second.replace(microsecond=500000), "8 Jun 2025": datetime(2025, 6, 8),
        "06/08/2025 10:11": datetime(2025, 6, 8, 10, 11), "2025.06.08 10:11:12": second, "2025/06/08 10:11:12": second,
        "Sunday, 8 June 2025 10:11:12 GMT": second, "6/8/2025 10:11:12 PM": second.replace(hour=22),
        "20250608T101112Z": second, "10:11:12": None, "soon": None, "Jun": None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i INT, t STRING")
    found = rows.selectExpr("t", f"date_format({times.from_text('t')}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS at").collect()
    assert {r.t: r.at for r in found} == {t: at and at.strftime("%Y-%m-%d %H:%M:%S.%f") for t, at in cases.items()}


def test_times(spark, lines):
    cases = {
        T: datetime(2025, 1, 2, 3, 4, 5, 678901),
        "2025-01-02T03:04:05+02:00": datetime(2025, 1, 2, 1, 4, 5),
        "2025-01-02 03:04:05": datetime(2025, 1, 2, 3, 4, 5),
        1735787045.5: datetime(2025, 1, 2, 3, 4, 5, 500000),
        "Thu, 2 Jan 2025 03:04:05 GMT": datetime(2025, 1, 2, 3, 4, 5),
        "Jun 8 2025 10:11:12": datetime(2025, 6, 8, 10, 11, 12),
    }
    for value, wanted in cases.items():
        frame = nz.normalize_cowrie(lines(json.dumps({"timestamp": value})), salt="s", redact_free_text=True)
        got = frame.select(F.unix_micros("ts_utc")).first()[0]
        assert got == int(wanted.replace(tzinfo=timezone.utc).timestamp() * 1e6 + 0.5), value


def test_falsy_values_fall_through(lines):
    row = one(lines, {"eventid": "", "event_id": 0, "event": "x.login.success", "timestamp": False, "time": T,
                      "src_ip": [], "src_host": {}, "src": None, "ip": "10.0.0.1", "dst_port": 0, "port": " 22 "})
    assert (row.event_type, row.src_ip_masked, row.dst_port) == ("login_success", "10.0.0.0/24", 22)
    text_zero = one(lines, {"timestamp": T, "session": "0", "session_id": "later"})
    assert text_zero.session_id == "0"  # text is truthy whatever it spells
    assert one(lines, {"timestamp": T, "eventid": 7}).event_type == "other"


def test_odd_types_never_fail(lines):
    row = one(lines, {"timestamp": T, "password": 1234, "username": True, "input": {"a": 1}, "src_port": "22.7",
                      "src_ip": 5, "url": ""}, redact_free_text=False, keep_secrets=True)
    assert (row.password, row.pass_len, row.username, row.src_port, row.src_ip) == ("1234", None, "True", None, None)
    assert row.pass_entropy == 2.0 and row.command == '{"a":1}' and row.url == ""
    assert one(lines, {"timestamp": T, "password": ""}).pass_len == 0


def test_duplicate_key_keeps_the_last(lines):
    row = one(lines, '{"timestamp":"%s","username":"a","username":"b"}' % T, keep_secrets=True)
    assert row.username == "b"


def test_commands(lines):
    long = one(lines, {"timestamp": T, "eventid": "cowrie.command.input", "input": " a\x01\tb\x7f " + "c" * 9000})
    assert not long.command_truncated and len(long.command) == 9005 and long.command.startswith("a\tb\x7f ")
    login = {"timestamp": T, "eventid": "cowrie.login.failed", "message": "login attempt [root/x]"}
    assert one(lines, login).command is None
    assert one(lines, login, redact_free_text=False).command == "login attempt [root/x]"


def test_low_interaction_record(lines):
    record = {"utc_time": T, "logtype": "ftp.login_failed", "src_host": "192.0.2.8", "dst_port": 21, "user": None,
              "username": None, "logdata": {"username": "hidden", "user": "u", "password": "p", "dst_port": 1}}
    row = one(lines, record, nz.normalize_opencanary, keep_secrets=True, redact_free_text=False)
    assert (row.service, row.event_type, row.dst_port, row.username, row.password) == ("ftp", "login_fail", 21, None, "p")
    merged = json.loads(row.raw_json)
    assert merged["username"] is None and merged["password"] == "p"
    by_port = one(lines, {"utc_time": T, "logtype": 4002, "dst_port": "3306"}, nz.normalize_opencanary)
    assert (by_port.service, by_port.event_type, by_port.eventid) == ("mysql", "other", "4002")
    no_object = one(lines, {"utc_time": T, "logtype": "x.connection", "logdata": 3}, nz.normalize_opencanary)
    assert (no_object.service, no_object.event_type) == ("unknown", "connect")


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "cowrie.json").write_bytes(b'{"timestamp":1}\r\n\n  \n{"bad":"\xff"}\n')
    (tmp_path / "cowrie.json.2025-01-02").write_bytes(b"nope\n")
    (tmp_path / "other.log").write_bytes(b"zzz\n")
    files = logs.discover_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in files] == ["cowrie.json", "cowrie.json.2025-01-02"]
    rows = logs.read_log_lines(spark, files, numbered=True).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in rows) == [
        ("cowrie.json", 1), ("cowrie.json", 4), ("cowrie.json.2025-01-02", 1)]
    assert any("�" in r.value for r in rows)


def test_missing_logs_are_an_error(spark, tmp_path):
    try:
        logs.discover_files(spark, str(tmp_path))
    except FileNotFoundError:
        return
    raise AssertionError("expected FileNotFoundError")


pieces = st.lists(st.sampled_from(["0", "1", "db8", "ffff", "00ab", "", "g", "12345", "10.0.0.1"]), min_size=1, max_size=9)
addresses_like = st.one_of(
    st.ip_addresses(v=6).map(lambda a: a.exploded), st.ip_addresses(v=6).map(str), st.ip_addresses(v=4).map(str),
    pieces.map(":".join), st.lists(st.sampled_from(["0", "1", "01", "255", "256", ""]), min_size=3, max_size=5).map(".".join),
    st.sampled_from(["::", "::1", "1::", "fe80::1%eth0", "fe80::1%", "1::2::3", ":::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]),
)


@settings(max_examples=4, deadline=None)
@given(st.lists(addresses_like, min_size=150, max_size=150))
def test_addresses_match_the_standard_library(spark, texts):
    def wanted(text):
        text = text.strip().replace("::ffff:", "") if text.startswith("::ffff:") else text.strip()
        try:
            parsed = ipaddress.ip_address(text)
        except ValueError:
            return None, None
        prefix = 24 if parsed.version == 4 else 64
        return str(parsed), str(ipaddress.ip_network(f"{parsed}/{prefix}", strict=False))

    texts = [t for t in texts if getattr(_parsed(t), "ipv4_mapped", None) is None]
    frame = spark.createDataFrame([(t,) for t in texts], "raw STRING")
    rows = frame.withColumn("ip", F.expr(addresses.normalize_ip("raw"))).selectExpr(
        "raw", "ip", f"{addresses.mask_ip('ip')} AS net").collect()
    for row in rows:
        assert (row.ip, row.net) == wanted(row.raw), row.raw


def _parsed(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def test_tokens_and_terms(spark):
    frame = spark.createDataFrame([([" /bin/LS -rf", "a", "", "wget http://x", None],), (None,)], "seq ARRAY<STRING>")
    docs = [r[0] for r in frame.selectExpr(text.command_doc("seq")).collect()]
    assert docs == ["/bin/ls wget", ""]
    terms = spark.createDataFrame([(d,) for d in docs], "d STRING").selectExpr(text.doc_terms("d")).collect()
    assert terms[0][0] == ["bin", "ls", "wget", "bin ls", "ls wget"] and terms[1][0] == []


def test_every_member_is_read_once(lines):
    for make, keys, nested in (
        (nz.normalize_cowrie, nz.INTERACTIVE_KEYS, 0), (nz.normalize_opencanary, nz.LOW_INTERACTION_KEYS, 1),
    ):
        made = make(lines("{}"), salt="s", redact_free_text=True)
        casts = made._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get")
        members = len({key for names in keys.values() for key in names})
        assert casts <= members * (1 + nested)  # a nested member is looked up before


def test_log_lines_are_spelled_without_lambda_functions(spark):
    frame = catalog.lines(catalog.configure(spark), "/root/testdata/sf0.001")["cowrie"]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("to_json") <= 5  # only texts that may need escapes
