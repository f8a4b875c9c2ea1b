"""Registered queries over the test tables and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurelog import schema
from lurelog.functions import addresses, json_values as jv, kinds, pseudonyms, text, times
from lurelog.operators import clusters as cl
from lurelog.operators import dedup, features as fe, forest, ip_windows, labels, metrics
from lurelog.operators import normalize, quantiles, report, sessions, skew, sweeps
from lurelog.operators.kmeans import kmeans
from lurelog.plans import cluster as cluster_plan
from lurelog.plans import detect as detect_plan
from lurelog.plans import increment
from lurelog.plans import ingest as ingest_plan
from lurelog.session import configure
from lurelog.sinks import files, tables
from lurelog.sources import logs
from lurelog.sources.tables import load_table, read_csv_table
from lurelog.staging import new_path, staged
from lurelog.streaming import ingest as streaming_ingest
from lurelog.workload import adapter, expected as ex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY = 1440
CHUNK = 4  # items in a chunk of a session's lists
TERMS = dict(min_df=2, max_df=0.8)
RULE = dict(attempts_ge=10, unique_users_ge=6, unique_passwords_ge=12, max_mean_interarrival_s=5000.0)
GRID = dict(attempts=[5, 10, 15, 60], users=[4, 6, 30], passwords=[4, 8, 40], gaps=[3000.0, 5000.0, -1.0])


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(build(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Types both engines print alike: times and flags as text, six decimals, joined lists."""
    changed = {}
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            changed[field.name] = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            changed[field.name] = F.round(column, 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.BooleanType):
            changed[field.name] = column.cast("int")
        elif isinstance(field.dataType, T.ArrayType):
            changed[field.name] = F.to_json(column)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            changed[field.name] = column.cast("bigint")
    return df.withColumns(changed) if changed else df


# --- inputs ---------------------------------------------------------------


def lines(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "cowrie": adapter.cowrie_lines(spark, sf_dir),
        "opencanary": adapter.opencanary_lines(spark, sf_dir),
    }


def normalized(spark: SparkSession, sf_dir: str, redact_free_text: bool = True, **options) -> DataFrame:
    options |= {"salt": adapter.SALT, "redact_free_text": redact_free_text}
    return ingest_plan.normalize_sensors(lines(spark, sf_dir), **options)


_STORED: dict[tuple[str, str], DataFrame] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deduplicated events, parsed and written once a session, as a curated table would be."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = staged(dedup.dedup_events(normalize.valid_events(normalized(spark, sf_dir))), "events")
    return _STORED[key]


def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(ip_windows.build_ip_windows(events(spark, sf_dir), DAY), "windows")


def day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(fe.engineer_features(day_windows(spark, sf_dir)), "features")


def day_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.baseline_alerts(day_features(spark, sf_dir), **RULE)


def scored_by_entropy(df: DataFrame) -> DataFrame:
    """Alerts with a reproducible stand-in for the forest's score."""
    return df.withColumns(
        {
            "if_score": F.round(F.col("log_attempts") - F.col("pass_entropy_mean") / 2, 9),
            "if_pred": ((F.col("attempts") % 7) == 3).cast("int"),
        }
    )


ALERT_SQL = """((attempts >= 10 AND (unique_users >= 6 OR unique_passwords >= 12 OR mean_interarrival_s <= 5000.0)))"""
SCORED = f"""
sc AS (SELECT *, CAST({ALERT_SQL} AS INTEGER) AS baseline_alert,
              round(log_attempts - pass_entropy_mean / 2, 9) AS if_score,
              CASE WHEN attempts % 7 = 3 THEN 1 ELSE 0 END AS if_pred FROM feat)"""
WINDOW_OUT = f"""{ex.time_text("window_start")} AS window_start, source, service, src_ip_hash, src_ip_masked,
  attempts, success_count, unique_users, unique_passwords, round(pass_entropy_mean, 6) AS pass_entropy_mean,
  round(mean_interarrival_s, 6) AS mean_interarrival_s, round(min_interarrival_s, 6) AS min_interarrival_s"""
FEATURE_OUT = WINDOW_OUT + """, round(users_per_attempt, 6) AS users_per_attempt,
  round(passwords_per_attempt, 6) AS passwords_per_attempt, round(success_rate, 6) AS success_rate,
  round(log_attempts, 6) AS log_attempts, round(log_unique_users, 6) AS log_unique_users,
  round(log_unique_passwords, 6) AS log_unique_passwords"""


# --- scans, parsing, scalar functions --------------------------------------


@query(
    "scan_lines",
    ex.with_tables("""
    l AS (SELECT user_id % 3 AS r, copies FROM src)""")
    + """ SELECT CASE WHEN r = 2 THEN 'opencanary' ELSE 'cowrie' END AS sensor, CAST(sum(copies) AS BIGINT) AS n_lines,
                 CAST(sum(copies) AS BIGINT) AS n_positions, CAST(sum(copies) AS BIGINT) AS last_lines FROM l GROUP BY 1""",
)
def scan_lines(spark, sf_dir):
    """Log text written to files and read back with physical line numbers."""
    found = []
    for sensor, frame in lines(spark, sf_dir).items():
        path = new_path(spark, "log-text")
        frame.select("value").write.text(path)
        read = logs.read_log_lines(spark, path, numbered=True)
        per_file = read.groupBy("file").agg(
            F.count("*").alias("n"), F.count_distinct("line").alias("d"), F.max("line").alias("last")
        )
        found.append(per_file.agg(
            F.sum("n").alias("n_lines"), F.sum("d").alias("n_positions"), F.sum("last").alias("last_lines")
        ).select(F.lit(sensor).alias("sensor"), "*"))
    return dedup.union_sources(*found)


@query(
    "ingest_rejects",
    ex.with_tables()
    + """ SELECT CASE WHEN user_id % 3 = 2 THEN 'opencanary' ELSE 'cowrie' END AS source, reason,
                 CAST(sum(copies) AS BIGINT) AS n FROM src WHERE reason IS NOT NULL GROUP BY ALL""",
)
def ingest_rejects(spark, sf_dir):
    frame = normalized(spark, sf_dir).filter("reject_reason IS NOT NULL")
    return frame.groupBy("source", F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))


@query(
    "ingest_valid",
    ex.with_tables()
    + """ SELECT source, service, event_type, CAST(sum(copies) AS BIGINT) AS n, min(event_hash) AS first_hash
          FROM ev GROUP BY ALL""",
)
def ingest_valid(spark, sf_dir):
    valid = normalize.valid_events(normalized(spark, sf_dir, redact_free_text=False))
    return valid.groupBy("source", "service", "event_type").agg(
        F.count("*").alias("n"), F.min("event_hash").alias("first_hash")
    )


NORMALIZED_OUT = f"""{ex.time_text("ts_utc")} AS ts_utc, source, service, event_type, eventid, src_ip_hash, src_ip_masked,
  CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, session_id, username_hash,
  password_hash, CAST(pass_len AS BIGINT) AS pass_len, round(pass_entropy, 6) AS pass_entropy, command, url,
  filename, event_hash"""
NORMALIZED_COLUMNS = [
    "ts_utc", "source", "service", "event_type", "eventid", "src_ip_hash", "src_ip_masked", "src_port",
    "dst_port", "session_id", "username_hash", "password_hash", "pass_len", "pass_entropy", "command",
    "url", "filename", "event_hash",
]


@query(
    "normalize_cowrie",
    ex.with_tables() + f" SELECT {NORMALIZED_OUT} FROM cowrie, range(copies) AS r(i)",
)
def normalize_cowrie(spark, sf_dir):
    rows = normalize.normalize_cowrie(
        adapter.cowrie_lines(spark, sf_dir), salt=adapter.SALT, redact_free_text=False
    )
    return normalize.valid_events(rows).select(NORMALIZED_COLUMNS)


@query(
    "normalize_opencanary",
    ex.with_tables() + f" SELECT {NORMALIZED_OUT} FROM opencanary, range(copies) AS r(i)",
)
def normalize_opencanary(spark, sf_dir):
    rows = normalize.normalize_opencanary(
        adapter.opencanary_lines(spark, sf_dir), salt=adapter.SALT, redact_free_text=False
    )
    return normalize.valid_events(rows).select(NORMALIZED_COLUMNS)


@query(
    "raw_records",
    ex.with_tables()
    + """ SELECT source, event_hash, raw_json, file_hash, CAST(0 AS BIGINT) AS command_truncated FROM ev, range(copies) AS r(i)""",
)
def raw_records(spark, sf_dir):
    """The whole record of every valid line of both sensors, nested members merged up, and the digests of downloads."""
    rows = normalize.valid_events(normalized(spark, sf_dir, redact_free_text=False))
    return rows.select("source", "event_hash", "raw_json", "file_hash", "command_truncated")


@query(
    "secrets_switch",
    ex.with_tables()
    + """ SELECT source, count(*) AS n, count(src_ip_hash) AS n_src_ip,
                 count(*) FILTER (WHERE source = 'cowrie' OR username_hash IS NOT NULL) AS n_username,
                 count(*) AS n_password, count(*) FILTER (WHERE event_type = 'command') AS n_command
          FROM ev GROUP BY source""",
)
def secrets_switch(spark, sf_dir):
    """Clear-text columns appear only with ``keep_secrets``; free text stays redacted."""
    kept = normalize.valid_events(normalized(spark, sf_dir, keep_secrets=True))
    counts = [F.count(c).alias(f"n_{c}") for c in ("src_ip", "username", "password", "command")]
    return dedup.dedup_events(kept).groupBy("source").agg(F.count("*").alias("n"), *counts)


@query(
    "ip_mask_hash",
    f"""WITH a AS (SELECT event_id, event_id % 6 AS k, user_id % 8 AS u, user_id FROM events),
    b AS (SELECT event_id, CASE k WHEN 0 THEN '10.' || u || '.0.7' WHEN 1 THEN '192.0.2.' || u
                WHEN 2 THEN '2001:db8::' || (u + 1) WHEN 3 THEN 'fe80::' || (u + 1) || ':0:0:1' END AS ip,
                CASE k WHEN 0 THEN '10.' || u || '.0.0/24' WHEN 1 THEN '192.0.2.0/24'
                WHEN 2 THEN '2001:db8::/64' WHEN 3 THEN 'fe80::/64' END AS masked FROM a)
    SELECT event_id, ip, masked, substr(sha256('{adapter.SALT}|' || ip), 1, 16) AS hashed FROM b""",
)
def ip_mask_hash(spark, sf_dir):
    """IPv4 and IPv6 clean-up: mapped prefix, upper case, full form, bad octets, bad text."""
    rows = adapter.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """CASE event_id % 6
             WHEN 0 THEN concat(' ::ffff:10.', user_id % 8, '.0.7 ')
             WHEN 1 THEN concat('192.0.2.', user_id % 8)
             WHEN 2 THEN concat('2001:0DB8:0:0:0:0:0:000', user_id % 8 + 1)
             WHEN 3 THEN concat('FE80::', user_id % 8 + 1, ':0:0:1')
             WHEN 4 THEN concat('10.0.0.', 256 + user_id % 8)
             ELSE concat('1:2::3::', user_id % 8) END AS raw""",
    )
    return rows.withColumn("ip", F.expr(addresses.normalize_ip("raw"))).selectExpr(
        "event_id", "ip", f"{addresses.mask_ip('ip')} AS masked",
        f"{pseudonyms.hash_ip('ip', adapter.SALT)} AS hashed",
    )


_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(8232) || chr(8233)"


@query(
    "command_clean",
    rf"""WITH c AS (SELECT page_id, trim(regexp_replace(html, '[\x00-\x08\x0B-\x1F]', '', 'g'), {_WS}) AS t FROM pages)
    SELECT page_id, length(t) AS n, md5(t) AS digest FROM c""",
)
def command_clean(spark, sf_dir):
    """Control characters out, trimmed; texts of any length stay whole."""
    pages = adapter.table(spark, sf_dir, "pages").withColumn("c", F.expr(text.without_control_chars("html")))
    return pages.select("page_id", F.char_length("c").cast("bigint").alias("n"), F.md5("c").alias("digest"))


@query(
    "password_entropy",
    """WITH p AS (SELECT doc_id, ch, count(*) AS c FROM
           (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents)) GROUP BY ALL),
       n AS (SELECT doc_id, sum(c) AS n FROM p GROUP BY doc_id)
    SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_chars, round(0.0 - sum(c / n * log2(c / n)), 6) AS entropy
    FROM p JOIN n USING (doc_id) GROUP BY doc_id""",
)
def password_entropy(spark, sf_dir):
    """Bits per character over whole texts."""
    docs = adapter.spread(adapter.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.selectExpr(
        "doc_id", f"cast(char_length({jv.strip('text')}) AS BIGINT) AS n_chars",
        f"{text.shannon_entropy('text')} AS entropy",
    )


@query(
    "event_times",
    """SELECT event_id, CASE WHEN event_id % 14 IN (6, 7) THEN NULL WHEN event_id % 14 IN (0, 1, 2) THEN epoch_us(ts)
         WHEN event_id % 14 = 8 THEN epoch_us(date_trunc('millisecond', ts)) WHEN event_id % 14 = 11 THEN epoch_us(date_trunc('day', ts))
         WHEN event_id % 14 = 12 THEN epoch_us(date_trunc('minute', ts)) ELSE epoch_us(date_trunc('second', ts)) END AS us FROM events""",
)
def event_times(spark, sf_dir):
    """Zoned, naive, epoch and textual event times; a bare time and junk are refused."""
    rows = adapter.base_events(spark, sf_dir).selectExpr(
        "event_id", "event_id % 14 <> 2 AS is_string",
        """CASE event_id % 14
             WHEN 0 THEN date_format(ts + INTERVAL 90 MINUTES, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+01:30'")
             WHEN 1 THEN date_format(ts, ' yyyy-MM-dd HH:mm:ss.SSSSSS ')
             WHEN 2 THEN cast(cast(unix_micros(ts) AS DECIMAL(20, 0)) / 1000000 AS STRING)
             WHEN 3 THEN date_format(ts, 'EEE, d MMM yyyy HH:mm:ss \\'GMT\\'')
             WHEN 4 THEN date_format(ts, 'MMM d yyyy HH:mm:ss')
             WHEN 5 THEN date_format(ts, 'yyyy/MM/dd HH:mm:ss')
             WHEN 8 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS')
             WHEN 9 THEN date_format(ts, 'EEE MMM  d HH:mm:ss \\'UTC\\' yyyy')
             WHEN 10 THEN date_format(ts, 'MMMM d, yyyy hh:mm:ss a')
             WHEN 11 THEN date_format(ts, 'd MMM yyyy')
             WHEN 12 THEN date_format(ts, 'MM/dd/yyyy HH:mm')
             WHEN 13 THEN date_format(ts, 'yyyy.MM.dd HH:mm:ss')
             WHEN 6 THEN date_format(ts, 'HH:mm:ss') ELSE 'soon' END AS text""",
    )
    return rows.selectExpr("event_id", f"unix_micros({times.parse_event_time('text', 'is_string')}) AS us")


@query(
    "integer_fields",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN user_id
                                      WHEN 3 THEN 1 END AS n FROM events""",
)
def integer_fields(spark, sf_dir):
    """Whole-number reading of numbers, padded text, booleans, fractions in text, words."""
    record = """concat('{"n":', CASE event_id % 6
        WHEN 0 THEN cast(user_id AS STRING) WHEN 1 THEN concat('" ', user_id, ' "')
        WHEN 2 THEN concat(user_id, '.7') WHEN 3 THEN 'true'
        WHEN 4 THEN concat('"', user_id, '.7"') ELSE '"x"' END, '}')"""
    rows = adapter.table(spark, sf_dir, "events").selectExpr("event_id", f"{record} AS value")
    parsed = normalize.parse_records(rows, ["n"])
    typed = parsed.selectExpr(
        "event_id", f"{jv.as_text('rec.n')} AS t", f"{jv.is_string('rec.n')} AS s"
    )
    return typed.selectExpr("event_id", f"{jv.as_int('t', 's')} AS n")


@query(
    "fallback_fields",
    """SELECT event_id, CASE event_id % 7 WHEN 5 THEN NULL WHEN 6 THEN 'in' ELSE 'b' || user_id END AS picked
       FROM events""",
)
def fallback_fields(spark, sf_dir):
    """Falsy values fall through; a top-level null hides the nested value; nested fills in."""
    record = """concat('{', CASE event_id % 7
        WHEN 0 THEN '"a":"",' WHEN 1 THEN '"a":0,' WHEN 2 THEN '"a":false,' WHEN 3 THEN '"a":[],'
        WHEN 4 THEN '"a":{},' WHEN 5 THEN '"a":null,"b":null,' ELSE '' END,
        CASE WHEN event_id % 7 < 5 THEN concat('"b":"b', user_id, '",') ELSE '' END,
        '"logdata":{"b":"in"}}')"""
    rows = adapter.table(spark, sf_dir, "events").selectExpr("event_id", f"{record} AS value")
    parsed = normalize.parse_records(rows, ["a", "b", "logdata"])
    chosen = parsed.selectExpr("event_id", f"{jv.first_truthy('rec', ['a', 'b'], 'logdata')} AS v")
    return chosen.selectExpr("event_id", f"{jv.as_text('v')} AS picked")


# Ids, log types and ports with the kind, service and login kind expected of them.
KIND_CASES = [
    ("cowrie.login.failed", "login_fail"), ("cowrie.login.success", "login_success"), ("cowrie.command.input", "command"),
    ("cowrie.session.connect", "connect"), ("cowrie.session.closed", "disconnect"), ("cowrie.session.file_download.failed", "download"),
    ("cowrie.client.version", "other"),
]
SERVICE_CASES = [
    ("ftp.login_failed", 1, "ftp", "login_fail"), ("MySQL.Login", 1, "mysql", "login_attempt"), ("rdp.connection", 22, "rdp", "connect"),
    ("ssh.login_success", 1, "ssh", "login_success"), ("smb.session", 1, "smb", "other"), ("HTTP.login", 21, "http", "login_attempt"),
    ("7001", 80, "http", "other"), ("7002", 443, "http", "other"), ("7003", 3389, "rdp", "other"), ("7004", 445, "smb", "other"),
    ("7005", 3306, "mysql", "other"), ("connect", 22, "ssh", "connect"), ("7006", 21, "ftp", "other"), ("7007", 9, "unknown", "other"),
]


def _cases(number: str, values: list) -> str:
    """A CASE over ``number`` modulo the count of ``values``, in either engine's SQL."""
    whens = " ".join(f"WHEN {i} THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {whens} END"


@query(
    "event_kinds",
    f"""SELECT event_id, {_cases("event_id", [k for _, k in KIND_CASES])} AS event_type,
         {_cases("event_id", [s for _, _, s, _ in SERVICE_CASES])} AS service, {_cases("event_id", [k for *_, k in SERVICE_CASES])} AS login_kind FROM events""",
)
def event_kinds(spark, sf_dir):
    """Every event id ending, service word, service port and login word."""
    rows = adapter.table(spark, sf_dir, "events").selectExpr(
        "event_id", f"{_cases('event_id', [i for i, _ in KIND_CASES])} AS eventid",
        f"{_cases('event_id', [t for t, *_ in SERVICE_CASES])} AS logtype", f"{_cases('event_id', [p for _, p, *_ in SERVICE_CASES])} AS port",
    )
    return rows.selectExpr(
        "event_id", f"{kinds.event_type_by_id('eventid', 'true')} AS event_type", f"{kinds.service_by_log_type('logtype', 'port')} AS service",
        f"{kinds.event_type_by_log_type('logtype')} AS login_kind",
    )


# --- curated tables ---------------------------------------------------------


@query(
    "events_dedup",
    ex.with_tables()
    + f""" SELECT event_hash, {ex.time_text("ts_utc")} AS ts_utc, source, service, event_type, src_ip_hash FROM ev""",
)
def events_dedup(spark, sf_dir):
    rows = normalize.valid_events(normalized(spark, sf_dir, redact_free_text=False))
    return dedup.dedup_events(rows).select(
        "event_hash", "ts_utc", "source", "service", "event_type", "src_ip_hash"
    )


@query(
    "events_append_twice",
    ex.with_tables() + " SELECT source, count(*) AS n, CAST(sum(copies) AS BIGINT) AS n_raw FROM ev GROUP BY source",
)
def events_append_twice(spark, sf_dir):
    """A second run over the same logs adds nothing to the partitioned raw table."""
    path = new_path(spark, "events-raw")
    valid = staged(normalize.valid_events(normalized(spark, sf_dir)), "valid")
    tables.append_events(valid, path)
    tables.append_events(valid, path, skip_stored=True)
    raw = tables.read_events(spark, path)
    unique = dedup.dedup_events(raw).groupBy("source").agg(F.count("*").alias("n"))
    return unique.join(raw.groupBy("source").agg(F.count("*").alias("n_raw")), "source")


SESSIONS_SQL = f"""
SELECT session_id, {ex.time_text("min(ts_utc)")} AS start_ts_utc, {ex.time_text("max(ts_utc)")} AS end_ts_utc,
  CAST(epoch_us(max(ts_utc)) // 1000000 - epoch_us(min(ts_utc)) // 1000000 AS BIGINT) AS duration_s,
  arg_min(src_ip_hash, ts_utc) FILTER (WHERE src_ip_hash IS NOT NULL) AS src_ip_hash,
  arg_min(src_ip_masked, ts_utc) FILTER (WHERE src_ip_hash IS NOT NULL) AS src_ip_masked,
  CAST(bool_or(event_type = 'login_success') AS BIGINT) AS has_success,
  count(*) FILTER (WHERE event_type = 'command') AS num_commands,
  count(*) FILTER (WHERE event_type = 'download') AS num_downloads
FROM ev WHERE source = 'cowrie' AND session_id IS NOT NULL GROUP BY session_id"""


@query("sessions", ex.with_tables() + SESSIONS_SQL)
def sessions_query(spark, sf_dir):
    return sessions.build_sessions(events(spark, sf_dir))


ITEMS_SQL = """,
it AS (SELECT session_id, CASE WHEN event_type = 'command' THEN command END AS command, CASE WHEN event_type = 'download' THEN url END AS url,
              row_number() OVER (PARTITION BY session_id ORDER BY ts_utc, event_hash) - 1 AS position
       FROM ev WHERE source = 'cowrie' AND session_id IS NOT NULL
         AND (event_type = 'command' AND command IS NOT NULL OR event_type = 'download' AND url IS NOT NULL))"""


@query("session_items", ex.with_tables() + ITEMS_SQL + " SELECT session_id, position, command, url FROM it")
def session_items(spark, sf_dir):
    """Every command and download of every session, numbered in order."""
    return sessions.session_items(events(spark, sf_dir)).select("session_id", "position", "command", "url")


@query(
    "session_chunks",
    ex.with_tables() + ITEMS_SQL + f""" SELECT session_id, position // {CHUNK} AS chunk,
         CAST(to_json(list(command ORDER BY position) FILTER (WHERE command IS NOT NULL)) AS VARCHAR) AS commands_seq,
         CAST(to_json(list(url ORDER BY position) FILTER (WHERE url IS NOT NULL)) AS VARCHAR) AS download_urls
       FROM it GROUP BY ALL""",
)
def session_chunks(spark, sf_dir):
    items = sessions.session_items(events(spark, sf_dir))
    return sessions.session_chunks(items, CHUNK)


@query("ip_windows_5m", ex.with_tables(ex.windows(5)) + f" SELECT {WINDOW_OUT} FROM win")
def ip_windows_5m(spark, sf_dir):
    return ip_windows.build_ip_windows(events(spark, sf_dir), 5)


@query("ip_windows_1d", ex.with_tables(ex.windows(DAY)) + f" SELECT {WINDOW_OUT} FROM win")
def ip_windows_1d(spark, sf_dir):
    return ip_windows.build_ip_windows(events(spark, sf_dir), DAY)


# --- quality report ---------------------------------------------------------


@query(
    "qc_counts",
    ex.with_tables(ex.windows(5))
    + """ SELECT 'events_raw' AS table_name, CAST(sum(copies) AS BIGINT) AS n FROM ev
          UNION ALL SELECT 'events_dedup', count(*) FROM ev
          UNION ALL SELECT 'cowrie_sessions', count(DISTINCT session_id) FROM ev
          UNION ALL SELECT 'ip_windows_5m', count(*) FROM win""",
)
def qc_counts(spark, sf_dir):
    raw = staged(normalize.valid_events(normalized(spark, sf_dir)), "raw")
    unique = staged(dedup.dedup_events(raw), "events")
    return report.table_counts(
        events_raw=raw, events_dedup=unique, cowrie_sessions=sessions.build_sessions(unique),
        ip_windows_5m=ip_windows.build_ip_windows(unique, 5),
    )


@query(
    "event_facts",
    ex.with_tables()
    + f""" SELECT count(*) AS events_dedup, {ex.time_text("min(ts_utc)")} AS min_ts_utc, {ex.time_text("max(ts_utc)")} AS max_ts_utc,
           count(*) FILTER (WHERE src_ip_hash IS NULL) AS src_ip_hash_null, CAST(0 AS BIGINT) AS ts_null FROM ev""",
)
def event_facts(spark, sf_dir):
    return report.event_facts(events(spark, sf_dir))


@query(
    "top_event_types",
    ex.with_tables()
    + """ SELECT source, service, event_type, count(*) AS c FROM ev GROUP BY ALL
          ORDER BY c DESC, source, service, event_type LIMIT 30""",
)
def top_event_types(spark, sf_dir):
    return report.top_event_types(events(spark, sf_dir))


@query(
    "reject_counts",
    ex.with_tables()
    + """ SELECT CASE WHEN user_id % 3 = 2 THEN 'opencanary' ELSE 'cowrie' END AS source, CAST(0 AS BIGINT) AS bad_json,
             CAST(coalesce(sum(copies) FILTER (WHERE reason = 'bad_ts'), 0) AS BIGINT) AS bad_ts,
             CAST(coalesce(sum(copies) FILTER (WHERE reason <> 'bad_ts'), 0) AS BIGINT) AS other
          FROM src WHERE reason IS NOT NULL GROUP BY ALL""",
)
def reject_counts(spark, sf_dir):
    return report.reject_counts(ingest_rejects(spark, sf_dir))


REPORT_SQL = f"""
 , f AS (SELECT count(*) AS n, regexp_replace({ex.time_text('min(ts_utc)')}, '[.]000000$', '') AS a, regexp_replace({ex.time_text('max(ts_utc)')}, '[.]000000$', '') AS b, count(*) FILTER (WHERE src_ip_hash IS NULL) AS missing FROM ev),
 k AS (SELECT to_json(list({{'source': source, 'service': service, 'event_type': event_type, 'c': c}} ORDER BY c DESC, source, service, event_type)) AS j
       FROM (SELECT source, service, event_type, count(*) AS c FROM ev GROUP BY ALL ORDER BY c DESC, source, service, event_type LIMIT 30)),
 l AS (SELECT to_json(list({{'source': source, 'bad_json': 0, 'bad_ts': bad_ts, 'other': other}} ORDER BY source)) AS j FROM (
       SELECT s.source, coalesce(sum(copies) FILTER (WHERE reason = 'bad_ts'), 0)::BIGINT AS bad_ts,
              coalesce(sum(copies) FILTER (WHERE reason <> 'bad_ts'), 0)::BIGINT AS other
       FROM (VALUES ('cowrie'), ('opencanary')) AS s(source)
       LEFT JOIN src ON (CASE WHEN user_id % 3 = 2 THEN 'opencanary' ELSE 'cowrie' END) = s.source AND reason IS NOT NULL GROUP BY s.source))
 SELECT '{{"counts":{{"events_raw":' || (SELECT CAST(sum(copies) AS BIGINT) FROM ev) || ',"events_dedup":' || n
     || ',"cowrie_sessions":' || (SELECT count(DISTINCT session_id) FROM ev) || ',"ip_windows_5m":' || (SELECT count(*) FROM win)
     || '}},"time_range":{{"min_ts_utc":"' || a || '","max_ts_utc":"' || b || '"}},"top_event_types":' || k.j
     || ',"null_rates":{{"src_ip_hash_null":' || missing || ',"ts_null":0}},"rejects":' || l.j || '}}' AS report
 FROM f, k, l"""


@query("quality_report", ex.with_tables(ex.windows(5)) + REPORT_SQL)
def quality_report(spark, sf_dir):
    rows = staged(normalized(spark, sf_dir), "normalized")
    raw = normalize.valid_events(rows)
    unique = staged(dedup.dedup_events(raw), "events")
    windows = staged(ip_windows.build_ip_windows(unique, 5), "windows")
    bad = rows.filter("reject_reason IS NOT NULL").groupBy("source", F.col("reject_reason").alias("reason"))
    lost = bad.agg(F.count("*").alias("n"))
    made = report.quality_report(raw, unique, sessions.build_sessions(unique), windows, lost)
    # The time of the build is not comparable; everything else is.
    return made.select(F.regexp_replace("report", r'^\{"generated_at_utc":"[^"]*",', "{").alias("report"))


# --- features and rules -----------------------------------------------------


@query("window_features", ex.with_tables(ex.features()) + f" SELECT {FEATURE_OUT} FROM feat")
def window_features(spark, sf_dir):
    return day_features(spark, sf_dir)


@query(
    "baseline_alerts",
    ex.with_tables(ex.features(), SCORED)
    + f" SELECT {ex.time_text('window_start')} AS window_start, source, service, src_ip_hash, attempts,"
    " CAST(baseline_alert AS BIGINT) AS baseline_alert FROM sc",
)
def baseline_alerts(spark, sf_dir):
    return day_alerts(spark, sf_dir).select(
        "window_start", "source", "service", "src_ip_hash", "attempts", "baseline_alert"
    )


@query(
    "default_rule_5m",
    ex.with_tables(ex.features(5))
    + """ SELECT count(*) AS rows_total, CAST(coalesce(sum(CAST(attempts >= 20 AND (unique_users >= 10 OR unique_passwords >= 10
             OR mean_interarrival_s <= 2.0) AS INTEGER)), 0) AS BIGINT) AS alerts_count, CAST(NULL AS BIGINT) AS anomalies_count FROM feat""",
)
def default_rule_5m(spark, sf_dir):
    unique = events(spark, sf_dir)
    windows = staged(ip_windows.build_ip_windows(unique, 5), "windows")
    return fe.alert_summary(fe.baseline_alerts(fe.engineer_features(windows)))


BURST_SQL = """
WITH b AS (SELECT date_trunc('week', ts) + to_seconds(event_id % 290) AS ts, user_id % 8 AS a, user_id, props FROM events),
g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY a ORDER BY ts) AS gap FROM b),
w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, a, count(*) AS attempts, count(DISTINCT user_id) AS users,
        count(DISTINCT props) AS passwords, sum(gap) AS gap_us, count(gap) AS gaps FROM g GROUP BY ALL)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S.%f') AS window_start, 'a' || a AS src_ip_hash, attempts, users AS unique_users, passwords AS unique_passwords,
  CAST(gap_us AS BIGINT) AS gap_us, gaps, CAST(attempts >= 20 AND (users >= 10 OR passwords >= 10 OR gap_us <= 2000000 * gaps) AS BIGINT) AS baseline_alert FROM w"""


@query("default_rule_bursts", BURST_SQL)
def default_rule_bursts(spark, sf_dir):
    """All events of a week squeezed into five minutes: the default rule fires, gaps are whole microseconds."""
    squeezed = adapter.base_events(spark, sf_dir).select(
        (F.date_trunc("week", "ts") + F.make_dt_interval(secs=(F.col("event_id") % 290).cast("decimal(18,6)"))).alias("ts_utc"),
        F.lit("cowrie").alias("source"), F.lit("ssh").alias("service"), F.lit("login_fail").alias("event_type"),
        F.concat(F.lit("a"), F.col("user_id") % 8).alias("src_ip_hash"), F.lit("m").alias("src_ip_masked"),
        F.col("user_id").cast("string").alias("username_hash"), F.col("props").alias("password_hash"), F.lit(1.0).alias("pass_entropy"),
        F.col("event_id").cast("string").alias("event_hash"),
    )
    windows = staged(ip_windows.build_ip_windows(squeezed, 5), "windows")
    alerts = fe.baseline_alerts(fe.engineer_features(windows))
    linked = ip_windows.with_gaps(ip_windows.login_events(squeezed)).withColumn("window_start", F.expr(times.window_start("ts_utc", 5)))
    gaps = linked.groupBy("window_start", "src_ip_hash").agg(F.sum("gap_us").alias("gap_us"), F.count("gap_us").alias("gaps"))
    return alerts.join(gaps, ["window_start", "src_ip_hash"]).select(
        "window_start", "src_ip_hash", "attempts", "unique_users", "unique_passwords", "gap_us", "gaps", "baseline_alert"
    )


@query(
    "top_alerts",
    ex.with_tables(ex.features(), SCORED)
    + f""" SELECT {ex.time_text('window_start')} AS window_start, source, service, src_ip_hash, attempts, unique_users,
             unique_passwords FROM sc WHERE baseline_alert = 1
           ORDER BY attempts DESC, unique_users DESC, unique_passwords DESC, sc.window_start, source, service, src_ip_hash LIMIT 200""",
)
def top_alerts(spark, sf_dir):
    return fe.top_alerts(day_alerts(spark, sf_dir)).select(
        "window_start", "source", "service", "src_ip_hash", "attempts", "unique_users", "unique_passwords"
    )


@query(
    "alert_summary",
    ex.with_tables(ex.features(), SCORED)
    + """ SELECT count(*) AS rows_total, CAST(sum(baseline_alert) AS BIGINT) AS alerts_count,
             CAST(sum(if_pred) AS BIGINT) AS anomalies_count FROM sc""",
)
def alert_summary(spark, sf_dir):
    return fe.alert_summary(scored_by_entropy(day_alerts(spark, sf_dir)))


@query(
    "top_scores",
    ex.with_tables(ex.features(), SCORED)
    + f""" SELECT {ex.time_text('window_start')} AS window_start, source, service, src_ip_hash, round(if_score, 6) AS if_score
           FROM sc ORDER BY sc.if_score, sc.window_start, source, service, src_ip_hash LIMIT 200""",
)
def top_scores(spark, sf_dir):
    scored = scored_by_entropy(day_alerts(spark, sf_dir))
    return fe.top_anomalies(scored).select("window_start", "source", "service", "src_ip_hash", "if_score")


@query(
    "service_filter",
    ex.with_tables(ex.features())
    + " SELECT service, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM feat WHERE service = 'ssh' GROUP BY service",
)
def service_filter(spark, sf_dir):
    chosen = fe.filter_service(day_features(spark, sf_dir), "ssh")
    return chosen.groupBy("service").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query(
    "coerced_numbers",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_quantity END AS BIGINT) AS attempts,
         CASE WHEN l_orderkey % 7 NOT IN (0, 1) THEN round(l_extendedprice, 6) END AS mean_interarrival_s FROM lineitem""",
)
def coerced_numbers(spark, sf_dir):
    """Counts and measures given as text: junk counts become 0, junk and NaN measures NULL."""
    rows = adapter.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "CASE WHEN l_orderkey % 5 = 0 THEN 'many' ELSE cast(l_quantity AS STRING) END AS attempts",
        """CASE l_orderkey % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN'
                ELSE cast(l_extendedprice AS STRING) END AS mean_interarrival_s""",
    )
    return fe.coerce_windows(rows).select("l_orderkey", "l_linenumber", "attempts", "mean_interarrival_s")


@query(
    "group_medians",
    """SELECT l_returnflag, 'l_extendedprice' AS name, round(median(l_extendedprice), 6) AS value FROM lineitem GROUP BY ALL
       UNION ALL SELECT l_returnflag, 'l_quantity', round(median(l_quantity), 6) FROM lineitem GROUP BY ALL""",
)
def group_medians(spark, sf_dir):
    """Exact medians of few huge groups without holding a group in one buffer."""
    rows = adapter.table(spark, sf_dir, "lineitem")
    found = quantiles.exact_quantiles(
        rows, ["l_extendedprice", "l_quantity"], [0.5], by="l_returnflag"
    )
    return found.drop("prob")


# --- labels -----------------------------------------------------------------

_KEY = "strftime(window_start, '%Y-%m-%d %H:%M:%S'), source, service, src_ip_hash"
SAMPLE = f"""
sus AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', {_KEY}, 'draw42'))) AS rn FROM sc WHERE baseline_alert = 1 OR if_pred = 1),
nor AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', {_KEY}, 'draw42'))) AS rn FROM sc WHERE NOT (baseline_alert = 1 OR if_pred = 1)),
smp AS (SELECT * FROM sus WHERE rn <= 40 UNION ALL
        SELECT * FROM nor WHERE rn <= 80 - least(40, (SELECT count(*) FROM sus)))"""
MATCHED = f"""
m AS (SELECT s.window_start, e.* FROM smp s JOIN ev e ON e.source = s.source AND e.service = s.service
      AND e.src_ip_hash = s.src_ip_hash AND e.ts_utc >= s.window_start AND e.ts_utc < s.window_start + INTERVAL {DAY} MINUTE)"""
SAMPLE_KEY = f"{ex.time_text('window_start')} AS window_start, source, service, src_ip_hash"
SAMPLE_TABLES = (ex.features(), SCORED, SAMPLE, MATCHED)


def sample_and_events(spark, sf_dir):
    unique = events(spark, sf_dir)
    windows = staged(ip_windows.build_ip_windows(unique, DAY), "windows")
    alerts = fe.baseline_alerts(fe.engineer_features(windows), **RULE)
    scored = staged(scored_by_entropy(alerts), "scored")
    return staged(labels.stratified_sample(scored), "sample"), unique


@query(
    "label_sample",
    ex.with_tables(*SAMPLE_TABLES)
    + f" SELECT '' AS label, {SAMPLE_KEY}, attempts, CAST(baseline_alert AS BIGINT) AS baseline_alert, CAST(if_pred AS BIGINT) AS if_pred FROM smp",
)
def label_sample(spark, sf_dir):
    scored = staged(scored_by_entropy(day_alerts(spark, sf_dir)), "scored")
    return labels.stratified_sample(scored).select(
        "label", "window_start", "source", "service", "src_ip_hash", "attempts", "baseline_alert", "if_pred"
    )


@query(
    "label_context",
    ex.with_tables(*SAMPLE_TABLES)
    + f""" SELECT {SAMPLE_KEY}, count(*) AS events_in_window,
             count(*) FILTER (WHERE event_type IN ('login_fail', 'login_attempt')) AS login_fail_like,
             count(*) FILTER (WHERE event_type = 'login_success') AS login_success FROM m GROUP BY ALL""",
)
def label_context(spark, sf_dir):
    sample, unique = sample_and_events(spark, sf_dir)
    return labels.context_counts(labels.events_in_windows(sample, unique, DAY))


@query(
    "label_context_by_day",
    ex.with_tables(*SAMPLE_TABLES)
    + f""" SELECT {SAMPLE_KEY}, count(*) AS events_in_window,
             count(*) FILTER (WHERE event_type IN ('login_fail', 'login_attempt')) AS login_fail_like,
             count(*) FILTER (WHERE event_type = 'login_success') AS login_success FROM m GROUP BY ALL""",
)
def label_context_by_day(spark, sf_dir):
    """The same from events in folders by day, of which only the sample's are read."""
    sample, unique = sample_and_events(spark, sf_dir)
    path = new_path(spark, "events-by-day")
    tables.write_events(unique, path)
    return labels.context_counts(labels.events_in_windows(sample, tables.read_events(spark, path, dated=True), DAY))


def _top_sql(column: str, alias: str) -> str:
    return f"""
    SELECT {SAMPLE_KEY}, string_agg({column} || ':' || cnt, ', ' ORDER BY rn) AS {alias}
    FROM (SELECT *, row_number() OVER (PARTITION BY window_start, source, service, src_ip_hash ORDER BY cnt DESC, {column}) AS rn
          FROM (SELECT window_start, source, service, src_ip_hash, {column}, count(*) AS cnt FROM m WHERE {column} IS NOT NULL GROUP BY ALL))
    WHERE rn <= 5 GROUP BY ALL"""


@query(
    "label_top_users",
    ex.with_tables(*SAMPLE_TABLES) + _top_sql("username_hash", "top_usernames"),
)
def label_top_users(spark, sf_dir):
    sample, unique = sample_and_events(spark, sf_dir)
    return labels.top_values(labels.events_in_windows(sample, unique, DAY), "username_hash", "top_usernames")


@query(
    "label_top_passwords",
    ex.with_tables(*SAMPLE_TABLES) + _top_sql("password_hash", "top_passwords"),
)
def label_top_passwords(spark, sf_dir):
    sample, unique = sample_and_events(spark, sf_dir)
    return labels.top_values(labels.events_in_windows(sample, unique, DAY), "password_hash", "top_passwords")


EXAMPLES = f"""
    SELECT {SAMPLE_KEY}, string_agg(line, chr(10) ORDER BY ts_utc) AS example_events FROM (
      SELECT window_start, source, service, src_ip_hash, ts_utc,
        regexp_replace(strftime(ts_utc, '%Y-%m-%d %H:%M:%S.%f'), '\\.000000$', '') || ' | ' || event_type || ' | ' || eventid || ' | '
          || CASE WHEN event_type = 'command' AND command <> '' THEN 'cmd=' || command ELSE 'raw=' END AS line,
        row_number() OVER (PARTITION BY window_start, source, service, src_ip_hash ORDER BY ts_utc) AS rn FROM m)
    WHERE rn <= 3 GROUP BY ALL"""


@query("label_examples", ex.with_tables(*SAMPLE_TABLES) + EXAMPLES)
def label_examples(spark, sf_dir):
    sample, unique = sample_and_events(spark, sf_dir)
    return labels.example_events(labels.events_in_windows(sample, unique, DAY))


@query(
    "label_examples_raw",
    ex.with_tables(*SAMPLE_TABLES)
    + EXAMPLES.replace("event_type = 'command' AND command <> '' THEN 'cmd=' || command ELSE 'raw=' END", "command <> '' THEN 'cmd=' || command ELSE 'raw=' || raw_json END"),
)
def label_examples_raw(spark, sf_dir):
    """Example events of events whose free text is kept: commands of every kind, else the whole record."""
    sample, _ = sample_and_events(spark, sf_dir)
    full = staged(dedup.dedup_events(normalize.valid_events(normalized(spark, sf_dir, redact_free_text=False))), "events-raw")
    return labels.example_events(labels.events_in_windows(sample, full, DAY))


@query(
    "label_context_by_table",
    ex.with_tables(*SAMPLE_TABLES)
    + f""" SELECT {SAMPLE_KEY}, count(*) AS events_in_window,
             count(*) FILTER (WHERE event_type IN ('login_fail', 'login_attempt')) AS login_fail_like,
             count(*) FILTER (WHERE event_type = 'login_success') AS login_success FROM m GROUP BY ALL""",
)
def label_context_by_table(spark, sf_dir):
    """The enriched sample of a run that names its events table instead of passing events."""
    sample, unique = sample_and_events(spark, sf_dir)
    csv, enriched, table = new_path(spark, "sample-csv"), new_path(spark, "enriched-csv"), "curated_events"
    unique.createOrReplaceTempView(table)
    files.write_csv(sample, csv)
    detect_plan.prepare_labels(spark, csv, enriched, events_table=table, minutes=DAY)
    back = labels.parse_window_start(read_csv_table(spark, enriched))
    counts = [F.col(c).cast("bigint").alias(c) for c in ("events_in_window", "login_fail_like", "login_success")]
    return back.select(*schema.WINDOW_KEY, *counts)


ENRICHED = f"""
cn AS (SELECT {SAMPLE_KEY}, count(*) AS events_in_window,
             count(*) FILTER (WHERE event_type IN ('login_fail', 'login_attempt')) AS login_fail_like,
             count(*) FILTER (WHERE event_type = 'login_success') AS login_success FROM m GROUP BY ALL),
us AS ({_top_sql("username_hash", "top_usernames")}),
pw AS ({_top_sql("password_hash", "top_passwords")}),
xs AS ({EXAMPLES}),
sm AS (SELECT {SAMPLE_KEY}, CAST(attempts AS BIGINT) AS attempts, CAST(baseline_alert AS BIGINT) AS baseline_alert, CAST(if_pred AS BIGINT) AS if_pred FROM smp
       UNION ALL SELECT '2001-01-01 00:00:00.000000', 'cowrie', 'ssh', 'nobody', 1, 0, 0)"""


@query(
    "label_csv_round_trip",
    ex.with_tables(*SAMPLE_TABLES, ENRICHED)
    + """ SELECT * REPLACE (coalesce(events_in_window, 0) AS events_in_window, coalesce(login_fail_like, 0) AS login_fail_like,
             coalesce(login_success, 0) AS login_success, coalesce(top_usernames, '') AS top_usernames,
             coalesce(top_passwords, '') AS top_passwords, coalesce(example_events, '') AS example_events)
          FROM sm LEFT JOIN cn USING (window_start, source, service, src_ip_hash) LEFT JOIN us USING (window_start, source, service, src_ip_hash)
          LEFT JOIN pw USING (window_start, source, service, src_ip_hash) LEFT JOIN xs USING (window_start, source, service, src_ip_hash)""",
)
def label_csv_round_trip(spark, sf_dir):
    """The enriched sample written as CSV and read back, line breaks inside fields and a window without events intact."""
    sample, unique = sample_and_events(spark, sf_dir)
    nobody = {"window_start": "timestamp'2001-01-01'", "source": "'cowrie'", "service": "'ssh'", "src_ip_hash": "'nobody'", "attempts": "1L",
              "baseline_alert": "0", "if_pred": "0", "label": "''"}
    extra = spark.range(1).select(*[F.expr(nobody.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in sample.schema.fields])
    sample = sample.unionByName(extra)
    csv, enriched = new_path(spark, "sample-csv"), new_path(spark, "enriched-csv")
    files.write_csv(sample, csv)
    detect_plan.prepare_labels(spark, csv, enriched, events=unique, minutes=DAY)
    back = labels.parse_window_start(read_csv_table(spark, enriched))
    numbers = ("attempts", "baseline_alert", "if_pred", "events_in_window", "login_fail_like", "login_success")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("top_usernames", "top_passwords", "example_events")]
    return back.select("window_start", "source", "service", "src_ip_hash", *[F.col(c).cast("bigint").alias(c) for c in numbers], *texts)


# --- evaluation and sweeps --------------------------------------------------


@query(
    "eval_confusion",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp,
         count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
         count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn FROM labels),
       p AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c)
    SELECT n, tp, tn, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM p""",
)
def eval_confusion(spark, sf_dir):
    rows = adapter.table(spark, sf_dir, "labels").withColumnsRenamed({"quality": "label", "toxic": "if_pred"})
    return metrics.evaluate(rows, "if_pred")


# Windows of three services carry a label that depends on their successes.
LABEL_SQL = "CASE WHEN service <> 'ftp' THEN CAST(success_count >= 3 AS INTEGER) END"


def window_label():
    return F.expr(LABEL_SQL)


def _values(name: str, values) -> str:
    rows = ", ".join(f"({i}, {v})" for i, v in enumerate(values))
    return f"(VALUES {rows}) AS t_{name}(i_{name}, {name})"


GRID_SQL = f"""
grid AS (SELECT ((i_a * {len(GRID["users"])} + i_u) * {len(GRID["passwords"])} + i_p) * {len(GRID["gaps"])} + i_g AS grid_id, a, u, p, CAST(g AS DOUBLE) AS g
         FROM {_values("a", GRID["attempts"])}, {_values("u", GRID["users"])}, {_values("p", GRID["passwords"])}, {_values("g", GRID["gaps"])}),
hit AS (SELECT grid_id, a, u, p, g, {LABEL_SQL} AS label,
               CAST(attempts >= a AND (unique_users >= u OR unique_passwords >= p OR (g >= 0 AND mean_interarrival_s <= g)) AS INTEGER) AS pred
        FROM sc, grid),
cnt AS (SELECT grid_id, a, u, p, g, count(*) AS rows_total, CAST(sum(pred) AS BIGINT) AS alerts,
          count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
          count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM hit GROUP BY ALL),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS pc, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rc FROM cnt),
swp AS (SELECT CAST(grid_id AS BIGINT) AS grid_id, CAST(a AS BIGINT) AS attempts_ge, CAST(u AS BIGINT) AS unique_users_ge,
          CAST(p AS BIGINT) AS unique_passwords_ge, g AS max_mean_interarrival_s, pc AS sample_precision, rc AS sample_recall,
          coalesce(2 * pc * rc / nullif(pc + rc, 0), 0.0) AS sample_f1, tp AS sample_tp, fp AS sample_fp, fn AS sample_fn, tn AS sample_tn,
          alerts AS alerts_full_count, alerts / rows_total AS alerts_full_rate FROM pr)"""
SWEEP_TABLES = (ex.features(), SCORED, GRID_SQL)
SWEEP_OUT = """SELECT * REPLACE (round(sample_precision, 6) AS sample_precision, round(sample_recall, 6) AS sample_recall,
  round(sample_f1, 6) AS sample_f1, round(alerts_full_rate, 6) AS alerts_full_rate)"""
CONFIG_TEXT = """'a>=' || attempts_ge || ', u>=' || unique_users_ge || ', p>=' || unique_passwords_ge || ', '
  || CASE WHEN max_mean_interarrival_s < 0 THEN 'mi=off' ELSE 'mi<=' || CAST(max_mean_interarrival_s AS BIGINT) || 's' END"""


def day_sweep(spark, sf_dir):
    return sweeps.rule_sweep(day_features(spark, sf_dir), window_label(), **GRID)


@query("rule_sweep", ex.with_tables(*SWEEP_TABLES) + f" {SWEEP_OUT} FROM swp")
def rule_sweep(spark, sf_dir):
    return day_sweep(spark, sf_dir)


@query(
    "sweep_profiles",
    ex.with_tables(*SWEEP_TABLES)
    + """ SELECT grid_id, alerts_full_count, 'alerting' AS profile FROM (SELECT * FROM swp ORDER BY sample_precision DESC, alerts_full_count, grid_id LIMIT 10)
          UNION ALL SELECT grid_id, alerts_full_count, 'triage' FROM (SELECT * FROM swp ORDER BY sample_f1 DESC, grid_id LIMIT 10)""",
)
def sweep_profiles(spark, sf_dir):
    found = sweeps.operating_profiles(staged(day_sweep(spark, sf_dir), "sweep"))
    return found.select("grid_id", "alerts_full_count", "profile")


@query(
    "sweep_chart",
    ex.with_tables(*SWEEP_TABLES)
    + f""" SELECT grid_id, {CONFIG_TEXT} AS label_text, CAST(row_number() OVER (ORDER BY sample_f1 DESC, attempts_ge, unique_users_ge,
             unique_passwords_ge, max_mean_interarrival_s) <= 12 AS BIGINT) AS annotated FROM swp""",
)
def sweep_chart(spark, sf_dir):
    return sweeps.chart_points(day_sweep(spark, sf_dir)).select("grid_id", "label_text", "annotated")


@query(
    "metric_repair",
    ex.with_tables(*SWEEP_TABLES)
    + """ SELECT grid_id, round(tp_ / nullif(tp_ + fp_, 0), 6) AS sample_precision, round(tp_ / nullif(tp_ + fn_, 0), 6) AS sample_recall,
             round(2 * (tp_ / nullif(tp_ + fp_, 0)) * (tp_ / nullif(tp_ + fn_, 0)) / nullif(tp_ / nullif(tp_ + fp_, 0) + tp_ / nullif(tp_ + fn_, 0), 0), 6) AS sample_f1
          FROM (SELECT *, sample_tp AS tp_, sample_fp AS fp_, sample_fn AS fn_ FROM swp)""",
)
def metric_repair(spark, sf_dir):
    """A sweep whose recall was flattened to 1 is repaired from its counts."""
    flat = day_sweep(spark, sf_dir).withColumns({"sample_recall": F.lit(1.0), "sample_f1": F.lit(0.0)})
    repaired = sweeps.repair_metrics(staged(flat, "flat"))
    return repaired.select("grid_id", "sample_precision", "sample_recall", "sample_f1")


@query(
    "sweep_fixed_decimals",
    ex.with_tables(*SWEEP_TABLES)
    + " SELECT grid_id, printf('%.6f', sample_recall) AS sample_recall, printf('%.6f', alerts_full_rate) AS alerts_full_rate FROM swp",
)
def sweep_fixed_decimals(spark, sf_dir):
    shown = files.fixed_decimals(day_sweep(spark, sf_dir))
    return shown.select("grid_id", "sample_recall", "alerts_full_rate")


def _score_sql(table: str, score: str, label: str, probs: list[float], inclusive: bool) -> str:
    test = "<=" if inclusive else "<"
    marks = ", ".join(f"({p})" for p in probs)
    return f"""
    WITH s AS (SELECT {score} AS score, {label} AS label FROM {table}),
    t AS (SELECT CAST(p AS DOUBLE) AS prob, (SELECT quantile_cont(score, [{", ".join(map(str, probs))}]) FROM s)[i] AS thr
          FROM (SELECT p, row_number() OVER () AS i FROM (VALUES {marks}) AS v(p))),
    c AS (SELECT prob, thr, count(*) AS n, count(*) FILTER (WHERE score {test} thr) AS alerts,
            count(*) FILTER (WHERE label = 1 AND score {test} thr) AS tp, count(*) FILTER (WHERE label = 0 AND score {test} thr) AS fp,
            count(*) FILTER (WHERE label = 1 AND NOT score {test} thr) AS fn FROM s, t GROUP BY prob, thr),
    p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS pc, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rc FROM c)
    SELECT prob, round(thr, 6) AS threshold_if_score, alerts AS alerts_full_count, round(alerts / n, 6) AS alerts_full_rate,
      round(pc, 6) AS sample_precision, round(rc, 6) AS sample_recall, round(coalesce(2 * pc * rc / nullif(pc + rc, 0), 0.0), 6) AS sample_f1,
      tp AS sample_tp, fp AS sample_fp, fn AS sample_fn FROM p"""


_LINE_LABEL = "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END"


@query(
    "score_thresholds",
    _score_sql("lineitem", "l_extendedprice", _LINE_LABEL, sweeps.CONTAMINATIONS, False),
)
def score_thresholds(spark, sf_dir):
    """Volume and metrics per contamination over a large scored table."""
    rows = adapter.table(spark, sf_dir, "lineitem")
    return sweeps.score_sweep(
        rows, F.expr(_LINE_LABEL), sweeps.CONTAMINATIONS, inclusive=False, score="l_extendedprice"
    )


@query(
    "score_ranking",
    _score_sql("lineitem", "l_extendedprice", _LINE_LABEL, [0.01, 0.02, 0.05, 0.1], True),
)
def score_ranking(spark, sf_dir):
    """The same by top-k share."""
    rows = adapter.table(spark, sf_dir, "lineitem")
    return sweeps.score_sweep(
        rows, F.expr(_LINE_LABEL), [k / 100 for k in sweeps.TOPK_PERCENTS], score="l_extendedprice",
    )


@query(
    "ranking_series",
    "SELECT prob AS topk_percent, sample_precision, sample_recall, sample_f1, CAST(alerts_full_count AS DOUBLE) AS alerts_full_count FROM ("
    + _score_sql("lineitem", "l_extendedprice", _LINE_LABEL, [0.01, 0.02, 0.05, 0.1], True)
    + ")",
)
def ranking_series(spark, sf_dir):
    """Line-chart rows of the ranking sweep."""
    swept = score_ranking(spark, sf_dir).withColumnRenamed("prob", "topk_percent")
    return sweeps.chart_series(swept, "topk_percent")


_LABELLED = "(SELECT * FROM sc WHERE service <> 'ftp')"
FULL_SWEEP = f"""
lab AS (SELECT *, if_score AS s, CAST(success_count >= 3 AS INTEGER) AS y FROM {_LABELLED}),
q AS (SELECT quantile_cont(s, [0.005, 0.01, 0.02, 0.05, 0.1]) AS qs FROM lab),
cont AS (SELECT CAST(unnest([0.005, 0.01, 0.02, 0.05, 0.1]) AS DOUBLE) AS contamination, unnest(qs) AS thr FROM q),
topk AS (SELECT CAST(unnest([1.0, 2.0, 5.0, 10.0]) AS DOUBLE) AS topk_percent, unnest([qs[2], qs[3], qs[4], qs[5]]) AS thr FROM q),
ic AS (SELECT contamination, count(*) FILTER (WHERE y = 1 AND s < thr) AS if_tp, count(*) FILTER (WHERE y = 0 AND s < thr) AS if_fp,
         count(*) FILTER (WHERE y = 1 AND NOT s < thr) AS if_fn FROM lab, cont GROUP BY contamination),
rk AS (SELECT topk_percent, count(*) FILTER (WHERE y = 1 AND s <= thr) AS rank_tp, count(*) FILTER (WHERE y = 0 AND s <= thr) AS rank_fp,
         count(*) FILTER (WHERE y = 1 AND NOT s <= thr) AS rank_fn FROM lab, topk GROUP BY topk_percent)"""
_F1 = "round(coalesce(2.0 * {0}_tp / nullif(2 * {0}_tp + {0}_fp + {0}_fn, 0), 0.0), 6) AS {0}_f1"


PARAMETER_SWEEP = (
    ex.with_tables(ex.features(), SCORED, FULL_SWEEP,
                   GRID_SQL.replace("FROM sc, grid", f"FROM {_LABELLED} AS sc, grid"))
    + f""" SELECT attempts_ge, unique_users_ge, unique_passwords_ge, max_mean_interarrival_s, contamination, topk_percent,
             sample_tp AS baseline_tp, sample_fp AS baseline_fp, sample_fn AS baseline_fn, if_tp, if_fp, if_fn, rank_tp, rank_fp, rank_fn,
             round(sample_f1, 6) AS baseline_f1, {_F1.format("if")}, {_F1.format("rank")} FROM swp, ic, rk"""
)
SWEEP_COUNTS = [f"{kind}_{cell}" for kind in ("baseline", "if", "rank") for cell in ("tp", "fp", "fn")]
SWEEP_RATES = ["baseline_f1", "if_f1", "rank_f1"]


@query("parameter_sweep", PARAMETER_SWEEP)
def parameter_sweep(spark, sf_dir):
    """Rule, forest and ranking metrics for all 2,160 parameter tuples of a labelled table."""
    scored = scored_by_entropy(day_alerts(spark, sf_dir)).withColumn("label", window_label())
    labelled = staged(scored.filter("label IS NOT NULL"), "labelled")
    swept = sweeps.full_sweep(labelled, F.col("label"), **GRID)
    return swept.select(*sweeps.PARAMS, "contamination", "topk_percent", *SWEEP_COUNTS, *SWEEP_RATES)


@query("tune_files", PARAMETER_SWEEP)
def tune_files(spark, sf_dir):
    """A tuning run over labelled windows, unlabelled ones among them, written as CSV and read back."""
    scored = scored_by_entropy(day_alerts(spark, sf_dir)).withColumn("label", F.coalesce(window_label().cast("string"), F.lit("")))
    out = new_path(spark, "tuned-csv")
    detect_plan.tune_and_write(staged(scored, "labelled"), out, score_source="full", **GRID)
    whole = [*sweeps.PARAMS[:3], *SWEEP_COUNTS]
    shares = [sweeps.PARAMS[3], "contamination", "topk_percent", *SWEEP_RATES]
    typed = [F.col(c).cast("bigint").alias(c) for c in whole] + [F.col(c).cast("double").alias(c) for c in shares]
    return read_csv_table(spark, out).select(*typed)


# --- sessions: TF-IDF, clusters ---------------------------------------------

TALK = r"""
WITH w AS (SELECT conv_id, turn, regexp_extract(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))), '^(\S+)', 1) AS word FROM conversations),
d AS (SELECT conv_id AS doc_id, coalesce(string_agg(word, ' ' ORDER BY turn) FILTER (WHERE length(word) >= 2), '') AS doc FROM w GROUP BY conv_id)"""


def talk_sessions(spark, sf_dir):
    """Conversations as sessions: every turn is one command line."""
    turns = adapter.table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(
        F.transform(ordered, lambda t: t["text"]).alias("commands_seq"),
        F.count("*").alias("num_commands"),
    )


@query(
    "session_docs",
    TALK + " SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc FROM d",
)
def session_docs(spark, sf_dir):
    return cl.session_docs(talk_sessions(spark, sf_dir))


# Plain-letter words of each whole text, so that both engines split alike.
DOC_TERMS = """
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9_-]+', ' ', 'g') AS doc FROM documents),
w AS (SELECT doc_id, list_filter(string_split(trim(doc), ' '), lambda x: length(x) >= 2) AS ws FROM d),
t AS (SELECT doc_id, unnest(ws) AS term FROM w
      UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
DOC_TFIDF = DOC_TERMS + """,
v AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, n WHERE df >= 2 AND df <= 0.8 * n),
r AS (SELECT doc_id, term, tf * idf AS raw FROM tf JOIN v USING (term)),
wt AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM r)"""


def plain_docs(spark, sf_dir, deal=None):
    # By document, so that its terms are counted where it is.
    docs = (deal or skew.by_size)(adapter.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    # The runs of kept characters between blanks; replacing all others takes five times as long.
    return docs.withColumn("doc", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_-]+"), F.lit(0)), " ")).drop("text")


def doc_matrix(spark, sf_dir):
    docs = plain_docs(spark, sf_dir, skew.dealt)
    return cl.term_matrix(cl.doc_tokens(docs), docs.count(), **TERMS)


@query("term_df", DOC_TERMS + " SELECT term, df FROM df")
def term_df(spark, sf_dir):
    return cl.document_frequency(cl.term_counts(plain_docs(spark, sf_dir)))


@query("session_tfidf", DOC_TFIDF + " SELECT doc_id, term, round(weight, 6) AS weight FROM wt")
def session_tfidf(spark, sf_dir):
    return doc_matrix(spark, sf_dir).named()


@query(
    "cluster_top_terms",
    DOC_TFIDF
    + """, s AS (SELECT doc_id % 4 AS cluster, term, sum(weight) AS total FROM wt GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(total, 9) DESC, term) AS rn FROM s),
    z AS (SELECT doc_id % 4 AS cluster, count(*) AS n_sessions FROM d GROUP BY ALL)
    SELECT CAST(cluster AS BIGINT) AS cluster, any_value(n_sessions) AS n_sessions, string_agg(term, ', ' ORDER BY rn) AS top_terms
    FROM k JOIN z USING (cluster) WHERE rn <= 15 GROUP BY cluster""",
)
def cluster_top_terms(spark, sf_dir):
    docs = plain_docs(spark, sf_dir)
    given = docs.select("doc_id", (F.col("doc_id") % 4).alias("cluster"))
    return cl.top_terms(doc_matrix(spark, sf_dir), given)


def talk_items(spark, sf_dir):
    turns = adapter.table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("position"), F.col("text").alias("command")
    )


def _clustered(spark, sf_dir):
    return cluster_plan.cluster_sessions(
        talk_sessions(spark, sf_dir), talk_items(spark, sf_dir), k=4, min_commands=2, **TERMS
    )


# What holds for any clustering: every session of two or more turns once, sizes that add up.
TALKS_SQL = "(SELECT count(*) AS n FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 2))"


@query(
    "kmeans_sessions",
    f"SELECT n AS sessions, n AS different, CAST(0 AS BIGINT) AS nearer_elsewhere, CAST(4 AS BIGINT) AS clusters FROM {TALKS_SQL}",
)
def kmeans_sessions(spark, sf_dir):
    """Every session is in one cluster, and no other cluster's centre is nearer to it."""
    chosen = staged(cl.sessions_for_clustering(talk_sessions(spark, sf_dir), 2), "sessions")
    docs = chosen.select(F.col("session_id").alias("doc_id"))
    said = talk_items(spark, sf_dir).join(chosen.select("session_id"), "session_id", "left_semi")
    weights = staged(cl.term_matrix(cl.item_tokens(said), docs.count(), **TERMS).weights, "weights")
    found = staged(kmeans(weights, docs, 4), "clusters")
    # Distances from the long table: |c|^2 - 2 x.c is enough to compare centres.
    sizes = found.groupBy("cluster").agg(F.count("*").alias("size"))
    centres = weights.join(found, "doc_id").groupBy("cluster", "idx").agg(F.sum("weight").alias("total")).join(sizes, "cluster")
    centres = staged(centres.select("cluster", "idx", (F.col("total") / F.col("size")).alias("c")), "centres")
    square = centres.groupBy("cluster").agg(F.sum(F.col("c") * F.col("c")).alias("square"))
    products = weights.join(centres, "idx").groupBy("doc_id", "cluster").agg(F.sum(F.col("weight") * F.col("c")).alias("product"))
    labels4 = docs.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(3))))
    far = labels4.join(square, "cluster").join(products, ["doc_id", "cluster"], "left").select(
        "doc_id", "cluster", (F.col("square") - 2 * F.coalesce("product", F.lit(0.0))).alias("distance")
    )
    own = far.join(found, ["doc_id", "cluster"]).select("doc_id", F.col("distance").alias("own"))
    nearer = far.join(own, "doc_id").where(F.col("distance") < F.col("own") - 1e-9).select("doc_id").distinct()
    totals = found.agg(F.count("*").alias("sessions"), F.count_distinct("doc_id").alias("different"), F.count_distinct("cluster").alias("clusters"))
    return totals.join(nearer.agg(F.count("*").alias("nearer_elsewhere")), F.lit(True), "inner").select(
        "sessions", "different", "nearer_elsewhere", "clusters"
    )


@query(
    "cluster_files",
    f"""SELECT file, CAST(n AS BIGINT) AS n_sessions, CAST(4 AS BIGINT) AS clusters, CAST(4 AS BIGINT) AS same_sizes
        FROM {TALKS_SQL}, (VALUES ('coords'), ('sessions'), ('summary')) AS f(file)""",
)
def cluster_files(spark, sf_dir):
    """The outputs of a clustering run as files, each read back: sessions and clusters, and sizes that are those of the run."""
    out = new_path(spark, "cluster-files")
    made = cluster_plan.cluster_and_write(
        talk_sessions(spark, sf_dir), talk_items(spark, sf_dir), out, k=4, min_commands=2, **TERMS
    )
    sizes = made["sessions"].groupBy("cluster").agg(F.count("*").alias("size"))
    coords = read_csv_table(spark, f"{out}/cluster_coords_2d").where("try_cast(x AS DOUBLE) IS NOT NULL AND try_cast(y AS DOUBLE) IS NOT NULL")
    summary = read_csv_table(spark, f"{out}/cluster_summary").where("top_terms <> ''")
    read = {
        "coords": coords.groupBy(F.col("cluster").cast("int").alias("cluster")).agg(F.count("*").alias("n")),
        "sessions": spark.read.parquet(f"{out}/session_clusters.parquet").groupBy("cluster").agg(F.count("*").alias("n")),
        "summary": summary.select(F.col("cluster").cast("int").alias("cluster"), F.col("n_sessions").cast("bigint").alias("n")),
    }
    return dedup.union_sources(*[
        found.join(sizes, "cluster").agg(
            F.lit(name).alias("file"), F.sum("n").alias("n_sessions"), F.count("*").alias("clusters"), F.count_if(F.col("n") == F.col("size")).alias("same_sizes")
        )
        for name, found in read.items()
    ])


@query(
    "cluster_summary",
    f"""SELECT CAST(4 AS BIGINT) AS clusters, CAST(n AS BIGINT) AS sessions, CAST(4 AS BIGINT) AS same_terms, CAST(4 AS BIGINT) AS same_sizes FROM {TALKS_SQL}""",
)
def cluster_summary(spark, sf_dir):
    """Sizes and heaviest terms of the clusters, against those of whole documents by plain windows."""
    found = _clustered(spark, sf_dir)
    given = staged(found["sessions"], "clustered")
    docs = cl.session_docs(given).join(given.select(F.col("session_id").alias("doc_id"), "cluster"), "doc_id")
    counts = cl.term_counts(docs).join(docs.select("doc_id", "cluster"), "doc_id")
    n = F.lit(docs.count())
    known = counts.withColumn("df", F.count("*").over(Window.partitionBy("term"))).where((F.col("df") >= 2) & (F.col("df") <= 0.8 * n))
    raw = known.withColumn("raw", F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    weighted = raw.withColumn("weight", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id"))))
    totals = weighted.groupBy("cluster", "term").agg(F.round(F.sum("weight"), 9).alias("total"))
    placed = totals.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("total"), "term"))).where("rn <= 15")
    listed = placed.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "term"))), lambda e: e["term"]), ", ").alias("wanted"))
    sizes = given.groupBy("cluster").agg(F.count("*").alias("size"))
    both = found["summary"].join(listed, "cluster", "left").join(sizes, "cluster")
    return both.agg(
        F.count("*").alias("clusters"), F.sum("n_sessions").alias("sessions"), F.count_if(F.col("top_terms").eqNullSafe(F.col("wanted"))).alias("same_terms"),
        F.count_if(F.col("n_sessions") == F.col("size")).alias("same_sizes"),
    )


def _largest_variances(squarings: int = 14) -> str:
    """The two largest variances of the centred documents, from powers of their Gram matrix.

    A power by repeated squaring leaves only the first axis; what it explains is
    taken off, and the rest gives the second.
    """
    parts = [TALK.strip(), """
chosen AS (SELECT conv_id AS doc_id FROM conversations GROUP BY conv_id HAVING count(*) >= 2),
ws AS (SELECT doc_id, list_filter(regexp_extract_all(doc, '[\\p{L}\\p{M}\\p{N}_-]+'), lambda x: regexp_full_match(x, '[a-z0-9_-]{2,}')) AS ws
       FROM d SEMI JOIN chosen USING (doc_id)),
tk AS (SELECT doc_id, unnest(ws) AS term FROM ws UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM ws),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY ALL),
n AS (SELECT count(*) AS n FROM chosen),
v AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.8 * any_value(n)),
r AS (SELECT doc_id, term, tf * idf AS raw FROM tf JOIN v USING (term)),
wt AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM r),
dots AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.w * b.w) AS v FROM wt a JOIN wt b USING (term) GROUP BY ALL),
k AS MATERIALIZED (SELECT a.doc_id AS i, b.doc_id AS j, coalesce(v, 0.0) AS v FROM chosen a CROSS JOIN chosen b LEFT JOIN dots ON i = a.doc_id AND j = b.doc_id),
m AS MATERIALIZED (SELECT i, avg(v) AS m FROM k GROUP BY i),
g1 AS MATERIALIZED (SELECT i, j, (k.v - a.m - b.m + (SELECT avg(m) FROM m)) / (n - 1) AS v FROM k JOIN m a USING (i) JOIN (SELECT i AS j, m FROM m) b USING (j), n)"""]
    for axis in (1, 2):
        before = f"g{axis}"
        for step in range(squarings):
            name = f"p{axis}_{step}"
            parts.append(f"""
{name} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) / (SELECT sum(v * v) FROM {before}) AS v FROM {before} a JOIN {before} b ON a.j = b.i GROUP BY ALL)""")
            before = name
        parts.append(f"""
l{axis} AS MATERIALIZED (SELECT sum(a.v * b.v) AS l FROM g{axis} a JOIN {before} b USING (i, j))""")
        if axis == 1:
            parts.append(f"""
g2 AS MATERIALIZED (SELECT i, j, a.v - (SELECT l FROM l1) * b.v AS v FROM g1 a JOIN {before} b USING (i, j))""")
    return ",".join(parts)


@query(
    "pca_sessions",
    _largest_variances()
    + """ SELECT n AS sessions, 0.0 AS mean_x, 0.0 AS mean_y, 0.0 AS covariance, round((SELECT l FROM l1), 6) AS var_x, round((SELECT l FROM l2), 6) AS var_y FROM n""",
)
def pca_sessions(spark, sf_dir):
    """One point a session; axes centred, uncorrelated, and of the largest variances there are."""
    found = _clustered(spark, sf_dir)["coords"]
    return found.agg(
        F.count("*").alias("sessions"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.covar_samp("x", "y").alias("covariance"),
        F.var_samp("x").alias("var_x"), F.var_samp("y").alias("var_y"),
    )


# --- forest -----------------------------------------------------------------


def exact_share(share: float) -> Column:
    """The number of rows that a share flags, where score and flag agree on it from below and from above; else -1.

    Rows that tie at the quantile may lie on either side.
    """
    rank = F.floor(share * (F.count("*") - 1)) + 1
    below, upto = F.count_if(F.col("if_score") < 0), F.count_if(F.col("if_score") <= 0)
    return F.when((below <= rank) & (rank <= upto) & (F.sum("if_pred") == below), rank).otherwise(-1)


@query(
    "isolation_forest",
    """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_orderkey % 32 = 0 AND l_linenumber = 1) AS planted FROM lineitem)
    SELECT n AS windows, CAST(floor(0.05 * (n - 1)) + 1 AS BIGINT) AS flagged, planted AS planted_flagged,
           CAST(200 AS BIGINT) AS trees, CAST(1 AS BIGINT) AS drawn_from_all FROM n""",
)
def isolation_forest(spark, sf_dir):
    """Rows of ``lineitem`` with planted outliers: these are flagged, so is the wanted share, and
    the trees draw from every part of the table."""
    rows = adapter.spread(adapter.table(spark, sf_dir, "lineitem")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), "l_orderkey",
        ((F.col("l_orderkey") % 32 == 0) & (F.col("l_linenumber") == 1)).cast("long").alias("planted"),
        *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
    )
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    far = staged(rows.withColumns({c: F.col(c) + F.col("planted") * 1e7 for c in features}), "forest-input")
    scored = forest.isolation_forest(far, contamination=0.05, features=features, key=["key"])
    n = far.count()
    drawn = forest._tree_samples(far, [*features, "l_orderkey"], ["key"], forest.TREES, min(forest.SAMPLE, n), 42, n)
    ends = far.agg(F.expr("percentile_approx(l_orderkey, array(0.1, 0.9))").alias("p")).first()["p"]
    spread = drawn.agg(
        F.count_distinct("tree").alias("trees"),
        ((F.count_if(F.col("l_orderkey") < ends[0]) > 0) & (F.count_if(F.col("l_orderkey") > ends[1]) > 0)).cast("bigint").alias("drawn_from_all"),
    )
    return scored.agg(
        F.count("*").alias("windows"), exact_share(0.05).alias("flagged"), F.sum(F.col("planted") * F.col("if_pred")).alias("planted_flagged"),
    ).join(spread, F.lit(True), "inner")


@query("forest_paths", ex.with_tables(ex.features()) + " SELECT service, count(*) AS windows, CAST(0 AS BIGINT) AS scored_otherwise, CAST(200 AS BIGINT) AS trees FROM feat GROUP BY service")
def forest_paths(spark, sf_dir):
    """Scores of a fitted forest against paths followed by joins with its node table."""
    rows = staged(day_features(spark, sf_dir).withColumn("row", F.xxhash64(*schema.WINDOW_KEY)), "forest-rows")
    n = rows.count()
    nodes = staged(forest.fit_forest(rows, rows=n), "forest-nodes")
    scored = forest.score_rows(rows, nodes, rows=n).select("row", "service", "raw_score")
    values = F.array(*[F.col(c).cast("double") for c in fe.FOREST_FEATURES])
    at = rows.select("row", values.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(forest.TREES - 1))).alias("tree"), F.lit(0).alias("node"))
    table = F.broadcast(nodes)  # trees x at most 511 rows
    for _ in range(8):  # 256 rows a tree
        goes = F.when(F.col("feature") < 0, F.col("node")).otherwise(
            2 * F.col("node") + 1 + (F.element_at("x", F.greatest(F.col("feature"), F.lit(0)) + 1) > F.col("threshold")).cast("int")
        )
        at = at.join(table, ["tree", "node"]).select("row", "x", "tree", goes.alias("node"))
    followed = at.join(table, ["tree", "node"]).where("feature < 0").groupBy("row").agg(F.sum("depth").alias("path"), F.count_distinct("tree").alias("trees"))
    scale = forest.average_path(min(forest.SAMPLE, n))
    wanted = -F.pow(F.lit(2.0), -F.col("path") / (F.col("trees") * scale))
    differs = F.coalesce(F.abs(F.col("raw_score") - wanted) > 1e-9, F.lit(True))
    return scored.join(followed, "row", "left").groupBy("service").agg(
        F.count("*").alias("windows"), F.count_if(differs).alias("scored_otherwise"), F.min("trees").alias("trees")
    )


@query(
    "top_anomalies",
    ex.with_tables(ex.features(), SCORED)
    + """ SELECT count(*) AS windows, least(count(*), 200) AS listed, CAST(sum(baseline_alert) AS BIGINT) AS alerts, CAST(1 AS BIGINT) AS in_order,
                 CAST(floor(0.05 * (count(*) - 1)) + 1 AS BIGINT) AS flagged, CAST(1 AS BIGINT) AS scores_differ FROM sc""",
)
def top_anomalies(spark, sf_dir):
    """The lowest scores of a whole detection run, its flags and its rule alerts."""
    scored = staged(detect_plan.detect(day_windows(spark, sf_dir), contamination=0.05, **RULE), "scored")
    listed = fe.top_anomalies(scored)
    worst = listed.agg(F.count("*").alias("listed"), F.max("if_score").alias("last"))
    beyond = scored.join(F.broadcast(worst), F.lit(True), "inner")
    order = (F.count_if(F.col("if_score") < F.col("last")) <= F.max("listed")) & (F.count_if(F.col("if_score") <= F.col("last")) >= F.max("listed"))
    return beyond.agg(
        F.count("*").alias("windows"), F.max("listed").alias("listed"), F.sum("baseline_alert").alias("alerts"), order.cast("bigint").alias("in_order"),
        exact_share(0.05).alias("flagged"), (F.count_distinct(F.round("if_score", 9)) * 2 > F.count("*")).cast("bigint").alias("scores_differ"),
    )


@query(
    "detect_files",
    ex.with_tables(ex.features(), SCORED)
    + """ SELECT count(*) AS windows, CAST(sum(baseline_alert) AS BIGINT) AS alerts, CAST(floor(0.05 * (count(*) - 1)) + 1 AS BIGINT) AS flagged,
                 least(count(*), 200) AS listed_scores, CAST(least(sum(baseline_alert), 200) AS BIGINT) AS listed_alerts, count(*) AS told_windows,
                 CAST(sum(baseline_alert) AS BIGINT) AS told_alerts, CAST(10 AS BIGINT) AS told_attempts, CAST(0 AS BIGINT) AS told_otherwise,
                 CAST(0 AS BIGINT) AS sampled_otherwise FROM sc""",
)
def detect_files(spark, sf_dir):
    """The outputs of a detection run with its forest as files, each read back."""
    out = new_path(spark, "detect-files")
    detect_plan.detect_and_write(day_windows(spark, sf_dir), out, sample_n=80, contamination=0.05, **RULE)
    scored = spark.read.parquet(f"{out}/anomaly_windows.parquet")
    suspicious = F.count_if((F.col("baseline_alert") == 1) | (F.col("if_pred") == 1))
    stored = scored.agg(
        F.count("*").alias("windows"), F.sum("baseline_alert").alias("alerts"), exact_share(0.05).alias("flagged"),
        F.sum("if_pred").alias("anomalies"), suspicious.alias("suspicious"),
    )
    document = "rows_total BIGINT, baseline STRUCT<attempts_ge: BIGINT, alerts_count: BIGINT>, isolation_forest STRUCT<anomalies_count: BIGINT>"
    told = spark.read.schema(document).json(f"{out}/anomaly_summary").select(
        F.col("rows_total").alias("told_windows"), F.col("baseline.alerts_count").alias("told_alerts"),
        F.col("baseline.attempts_ge").alias("told_attempts"), F.col("isolation_forest.anomalies_count").alias("told_anomalies"),
    )
    scores = read_csv_table(spark, f"{out}/top_if_anomalies").agg(F.count("*").alias("listed_scores"))
    alerts = read_csv_table(spark, f"{out}/top_baseline_alerts").where("baseline_alert = '1'").agg(F.count("*").alias("listed_alerts"))
    drawn = read_csv_table(spark, f"{out}/label_sample").agg(
        F.count("*").alias("sampled"), F.count_if(F.expr("baseline_alert = '1' OR if_pred = '1'")).alias("sampled_suspicious")
    )
    joined = stored
    for part in (told, scores, alerts, drawn):  # one row each
        joined = joined.join(part, F.lit(True), "inner")
    first = F.least(F.col("suspicious"), F.lit(40))
    wanted = first + F.least(F.lit(80) - first, F.col("windows") - F.col("suspicious"))
    return joined.select(
        "windows", "alerts", "flagged", "listed_scores", "listed_alerts", "told_windows", "told_alerts", "told_attempts",
        (F.col("told_anomalies") != F.col("anomalies")).cast("bigint").alias("told_otherwise"),
        ((F.col("sampled") != wanted) | (F.col("sampled_suspicious") != first)).cast("bigint").alias("sampled_otherwise"),
    )


# --- whole runs over files --------------------------------------------------


def curated_in_batches(spark, sf_dir) -> str:
    """The root of curated tables, made once a session: all events in three batches: of two thirds of the days a part each, the last batch with late and repeated events."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} in batches")
    if key in _STORED:
        return _STORED[key]
    root = _STORED[key] = new_path(spark, "increments")
    raw = staged(normalize.valid_events(normalized(spark, sf_dir)).withColumn("part", F.pmod(F.dayofyear("ts_utc"), F.lit(3))), "in-batches")
    late = F.pmod(F.xxhash64("event_hash"), F.lit(5)) == 0
    increment.curate_batch(spark, raw.where((F.col("part") < 2) & ~late), root)
    increment.curate_batch(spark, raw.where(F.col("part") == 2), root)
    increment.curate_batch(spark, raw.where((F.col("part") == 0) | late), root)
    return root


@query(
    "curated_in_batches",
    ex.with_tables(ex.windows(5))
    + f""", ses AS ({SESSIONS_SQL}) {ITEMS_SQL}
          SELECT 'events' AS name, count(*) AS n, CAST(sum(('0x' || substr(event_hash, 1, 8))::BIGINT) AS BIGINT) AS total FROM ev
          UNION ALL SELECT 'sessions', count(*), CAST(sum(num_commands * 7 + num_downloads * 5 + duration_s + has_success) AS BIGINT) FROM ses
          UNION ALL SELECT 'session_items', count(*), CAST(sum(position * 3 + length(coalesce(command, url))) AS BIGINT) FROM it
          UNION ALL SELECT 'ip_windows', count(*), CAST(sum(attempts * 7 + success_count * 5 + unique_users * 3 + unique_passwords) AS BIGINT) FROM win""",
)
def curated_totals_in_batches(spark, sf_dir):
    return dedup.union_sources(*_increment_totals(spark, curated_in_batches(spark, sf_dir)))


def _increment_totals(spark, root: str) -> list[DataFrame]:
    totals = {
        "events": (spark.read.parquet(f"{root}/events"), "cast(conv(substr(event_hash, 1, 8), 16, 10) AS BIGINT)"),
        "sessions": (increment.read_sessions(spark, root), "num_commands * 7 + num_downloads * 5 + duration_s + cast(has_success AS INT)"),
        "session_items": (increment.read_session_items(spark, root), "position * 3 + char_length(coalesce(command, url))"),
        "ip_windows": (increment.read_ip_windows(spark, root), "attempts * 7 + success_count * 5 + unique_users * 3 + unique_passwords"),
    }
    return [t.agg(F.count("*").alias("n"), F.expr(f"sum({total})").alias("total")).select(F.lit(name).alias("name"), "n", "total") for name, (t, total) in totals.items()]


STREAMED_SQL = SQL["curated_in_batches"] + """
          UNION ALL SELECT 'rejects', CAST(sum(copies) AS BIGINT), CAST(sum(copies) FILTER (WHERE reason = 'bad_ts') AS BIGINT) FROM src WHERE reason IS NOT NULL
          UNION ALL SELECT 'raw', CAST(sum(copies) AS BIGINT), CAST(0 AS BIGINT) FROM ev"""


@query("stream_to_curated", STREAMED_SQL)
def stream_to_curated(spark, sf_dir):
    """Log files as a stream of a few micro-batches, to the same tables as a batch run."""
    root = new_path(spark, "stream")
    folders = {}
    for sensor, frame in lines(spark, sf_dir).items():
        folders[sensor] = f"{root}/logs/{sensor}"
        frame.select("value").repartition(4).write.text(folders[sensor])
    running = streaming_ingest.stream_to_curated(
        spark, folders, f"{root}/events_raw", f"{root}/rejects", f"{root}/curated", f"{root}/checkpoint",
        files_at_a_time=2, salt=adapter.SALT, redact_free_text=True,
    )
    running.awaitTermination()
    bad = spark.read.option("recursiveFileLookup", "true").json([f"{root}/rejects/{sensor}_rejects" for sensor in folders])
    bad = bad.agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "bad_ts").alias("total")).select(F.lit("rejects").alias("name"), "n", "total")
    raw = tables.read_events(spark, f"{root}/events_raw").agg(F.count("*").alias("n")).select(F.lit("raw").alias("name"), "n", F.lit(0).cast("bigint").alias("total"))
    return dedup.union_sources(*_increment_totals(spark, f"{root}/curated"), bad, raw)


@query("ip_windows_in_batches", ex.with_tables(ex.windows(5)) + f" SELECT {WINDOW_OUT} FROM win")
def ip_windows_in_batches(spark, sf_dir):
    return increment.read_ip_windows(spark, curated_in_batches(spark, sf_dir))


@query("sessions_in_batches", ex.with_tables() + SESSIONS_SQL)
def sessions_in_batches(spark, sf_dir):
    return increment.read_sessions(spark, curated_in_batches(spark, sf_dir))


@query(
    "logs_to_curated",
    ex.with_tables(ex.windows(5))
    + f""", ses AS ({SESSIONS_SQL}) {ITEMS_SQL}
          SELECT 'events' AS name, count(*) AS n, CAST(sum(('0x' || substr(event_hash, 1, 8))::BIGINT) AS BIGINT) AS total FROM ev
          UNION ALL SELECT 'sessions', count(*), CAST(sum(num_commands * 7 + num_downloads * 5 + duration_s + has_success) AS BIGINT) FROM ses
          UNION ALL SELECT 'session_items', count(*), CAST(sum(position * 3 + length(coalesce(command, url))) AS BIGINT) FROM it
          UNION ALL SELECT 'ip_windows', count(*), CAST(sum(attempts * 7 + success_count * 5 + unique_users * 3 + unique_passwords) AS BIGINT) FROM win
          UNION ALL SELECT 'rejects', CAST(sum(copies) AS BIGINT), CAST(sum(copies) FILTER (WHERE reason = 'bad_ts') AS BIGINT) FROM src WHERE reason IS NOT NULL""",
)
def logs_to_curated(spark, sf_dir):
    """Log files to raw events, rejects and curated tables, a rebuild from the stored events, then read back."""
    root = new_path(spark, "lake")
    for sensor, frame in lines(spark, sf_dir).items():
        frame.select("value").write.text(f"{root}/logs/{sensor}")
    # The interactive sensor's files are found by name.
    adapter_files = f"{root}/logs/cowrie"
    paths = (f"{root}/events_raw", f"{root}/rejects", f"{root}/curated")
    ingest_plan.run(
        spark, *paths, salt=adapter.SALT, cowrie_dir=adapter_files, cowrie_pattern="part-*", opencanary_path=f"{root}/logs/opencanary",
        redact_free_text=True,
    )
    ingest_plan.run(spark, *paths, salt=adapter.SALT, redact_free_text=True, ingest="none")
    totals = {
        "events": ("events/events_clean", "cast(conv(substr(event_hash, 1, 8), 16, 10) AS BIGINT)"),
        "sessions": ("sessions/cowrie_sessions", "num_commands * 7 + num_downloads * 5 + duration_s + cast(has_success AS INT)"),
        "session_items": ("sessions/session_items", "position * 3 + char_length(coalesce(command, url))"),
        "ip_windows": ("ip_windows/ip_windows_5m", "attempts * 7 + success_count * 5 + unique_users * 3 + unique_passwords"),
    }
    counted = [
        load_table(spark, name, f"{root}/curated/{path}.parquet", prefer="parquet").agg(F.count("*").alias("n"), F.expr(f"sum({total})").alias("total"))
        .select(F.lit(name).alias("name"), "n", "total")
        for name, (path, total) in totals.items()
    ]
    bad = spark.read.option("recursiveFileLookup", "true").json([f"{root}/rejects/cowrie_rejects", f"{root}/rejects/opencanary_rejects"])
    counted.append(bad.agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "bad_ts").alias("total")).select(F.lit("rejects").alias("name"), "n", "total"))
    return dedup.union_sources(*counted)
