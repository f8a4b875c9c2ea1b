"""Sensor logs derived from the ``events`` test table.

No test table is a sensor log, so every event row becomes one JSON line of one
of the two sensors.  Arithmetic on ``event_id`` plants the irregularities the
ingest must handle: broken lines, missing or numeric times, other zones,
fallback keys, invalid addresses, copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALT = "pepper"

COMMANDS = [
    "uname -a", "cat /proc/cpuinfo", "LS -la /tmp", "wget http://198.51.100.7/x", "a", "  echo  hi", "cd /tmp",
]
EVENT_IDS = {
    "error": "cowrie.login.failed",
    "click": "cowrie.client.version",
    "signup": "cowrie.login.success",
    "view": "cowrie.command.input",
    "purchase": "cowrie.session.file_download",
}
LOG_WORDS = {"error": "login_failed", "click": "login", "signup": "login_success", "view": "connection"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: a test table is one small file, hence one task otherwise."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table with UTC timestamps (the files hold naive ones)."""
    return spread(table(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


def _every(n: int) -> str:
    return f"event_id % {n} = 0"


def _json_text(text: str) -> str:
    """A JSON string literal; NULL stays NULL."""
    spelled = f"""regexp_extract(to_json(named_struct('t', {text})), r'(?s)^\\{{"t":(.*)\\}}$', 1)"""
    return f"CASE WHEN {text} IS NOT NULL THEN {spelled} END"


def _plain_text(text: str) -> str:
    """``_json_text`` of a text without quotes, backslashes and control characters."""
    return f"""concat('"', {text}, '"')"""


def _choice(column: str, values: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{key}' THEN '{value}'" for key, value in values.items())
    return f"CASE {column} {cases} END"


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TIME_JSON = f"""CASE
    WHEN {_every(83)} THEN cast(cast(cast(unix_micros(ts) AS DECIMAL(20, 0)) / 1000000 AS DECIMAL(20, 6)) AS STRING)
    WHEN {_every(79)} THEN concat('"', date_format(ts + INTERVAL 2 HOURS, "{ISO}"), '+02:00"')
    WHEN {_every(77)} THEN concat('"', date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), '"')
    ELSE concat('"', date_format(ts, "{ISO}"), 'Z"') END"""
ADDRESS = f"""CASE WHEN {_every(71)} THEN '10.0.0.999'
    ELSE concat(CASE WHEN {_every(5)} THEN '::ffff:' ELSE '' END, '10.0.', user_id % 8, '.', user_id % 8 + 1) END"""
SPOILED = f"""CASE WHEN {_every(97)} THEN left(line, char_length(line) - 1)
    WHEN {_every(67)} THEN concat('[', line, ']') WHEN {_every(101)} THEN concat(line, ' x') ELSE line END"""


def _record(**members: str) -> str:
    """JSON object text; a member whose value is NULL is left out."""
    parts = ", ".join(f"""concat('"{key}":', {value})""" for key, value in members.items())
    return f"concat('{{', concat_ws(',', {parts}), '}}')"


def _emit(events: DataFrame, prepared: dict[str, str], line: str, file: str) -> DataFrame:
    """One line per event, some spoiled, some twice."""
    columns = [f"{value} AS {name}" for name, value in prepared.items()]
    spelled = events.selectExpr("*", *columns).selectExpr("event_id", f"{line} AS line")
    copies = f"explode(sequence(1, CASE WHEN {_every(50)} THEN 2 ELSE 1 END)) AS copy"
    return spelled.selectExpr(f"'{file}' AS file", f"{SPOILED} AS value", copies).drop("copy")


def cowrie_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = "array(" + ", ".join(f"'{c}'" for c in COMMANDS) + f")[cast(event_id % {len(COMMANDS)} AS INT)]"
    port = "cast(40000 + event_id % 1000 AS STRING)"
    prepared = {
        "time": f"CASE WHEN NOT {_every(89)} THEN {TIME_JSON} END",
        "eventid": _plain_text(_choice("event_type", EVENT_IDS)),
        "ip": _plain_text(ADDRESS),
        "person": f"CASE WHEN {_every(53)} THEN '' ELSE concat('u', user_id) END",
        "typed": f"CASE WHEN {_every(11)} THEN concat({typed}, '\\u0001\\n') ELSE {typed} END",
        "download": "CASE WHEN event_type = 'purchase' AND event_id % 3 <> 0 THEN concat('http://h/', props) END",
        "day": "concat_ws('-', user_id, to_date(ts))",
        "digest": "CASE WHEN event_type = 'purchase' AND event_id % 3 <> 0 THEN md5(props) END",
    }
    line = _record(
        eventid=f"CASE WHEN {_every(73)} THEN '\"\"' ELSE eventid END",
        event_id=f"CASE WHEN {_every(73)} THEN eventid END",
        timestamp=f"CASE WHEN {_every(73)} THEN 'null' ELSE time END",
        time=f"CASE WHEN {_every(73)} THEN time END",
        src_ip=f"CASE WHEN {_every(61)} THEN '\"\"' ELSE ip END",
        src_host=f"CASE WHEN {_every(61)} THEN ip END",
        src_port=f"CASE WHEN {_every(2)} THEN concat('\"', {port}, '\"') ELSE {port} END",
        port=f"CASE WHEN {_every(4)} THEN '2222' END",
        session=_plain_text("day"),
        username=_plain_text("person"),
        password=f"CASE WHEN {_every(59)} THEN cast(event_id % 1000 AS STRING) ELSE {_json_text('props')} END",
        input=f"CASE WHEN event_type = 'view' THEN {_json_text('typed')} END",
        message=_plain_text("concat('about [', person, '] é')"),
        url=_json_text("download"),
        outfile="CASE WHEN event_type = 'purchase' THEN '\"dl/f\"' END",
        shasum=_plain_text("digest"),
    )
    events = base_events(spark, sf_dir).filter("user_id % 3 <> 2")
    return _emit(events, prepared, line, "cowrie.json")


def opencanary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = {
        "slot": "floor(user_id / 3) % 4",
        "word": _choice("event_type", LOG_WORDS),
        "person": _plain_text("concat('u', user_id)"),
        "secret": _json_text("props"),
        "ip": _plain_text(ADDRESS),
    }
    prefix = "CASE floor(user_id / 3) % 4 WHEN 0 THEN 'ftp.' WHEN 1 THEN 'ssh.' ELSE '' END"
    nested = _record(
        username="person",
        **{"pass": f"CASE WHEN {_every(3)} THEN secret END"},
        password=f"CASE WHEN NOT {_every(3)} THEN secret END",
        dst_port="'1'",
    )
    line = _record(
        utc_time=f"CASE WHEN NOT {_every(89)} THEN {TIME_JSON} END",
        logtype=f"CASE WHEN word IS NULL THEN '2000' ELSE concat('\"', {prefix}, word, '\"') END",
        src_host="ip",
        src_port="cast(50000 + event_id % 1000 AS STRING)",
        dst_port="CASE slot WHEN 0 THEN '21' WHEN 1 THEN '22' WHEN 2 THEN '3306' ELSE '9999' END",
        username=f"CASE WHEN {_every(47)} THEN 'null' END",
        logdata=nested,
    )
    events = base_events(spark, sf_dir).filter("user_id % 3 = 2")
    return _emit(events, prepared, line, "opencanary.log")
