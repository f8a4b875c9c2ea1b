"""DuckDB texts of the expected tables, computed from ``events`` without any JSON."""

from __future__ import annotations

from lurelog.workload.adapter import COMMANDS, SALT

_COMMAND = "[" + ", ".join("'" + c + "'" for c in COMMANDS) + f"][event_id % {len(COMMANDS)} + 1]"


def _sha16(mark: str, text: str) -> str:
    return f"substr(sha256('{SALT}|{mark}' || {text}), 1, 16)"


_HASH_TIME = """strftime(ts, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END
    || '+00:00'"""

# The time member of a line as the record shows it.
_TIME_JSON = """CASE
    WHEN event_id % 83 = 0 THEN regexp_replace((epoch_us(ts) // 1000000) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'), '[.]?0+$', '')
    WHEN event_id % 79 = 0 THEN '"' || strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+02:00"'
    WHEN event_id % 77 = 0 THEN '"' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '"'
    ELSE '"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"' END"""
_ADDRESS_JSON = """'"' || CASE WHEN event_id % 71 = 0 THEN '10.0.0.999'
    ELSE CASE WHEN event_id % 5 = 0 THEN '::ffff:' ELSE '' END || '10.0.' || (user_id % 8) || '.' || (user_id % 8 + 1) END || '"'"""
_LOG_WORD = "CASE slot WHEN 0 THEN 'ftp.' WHEN 1 THEN 'ssh.' ELSE '' END || word"


def _quoted(text: str) -> str:
    return f"CAST(to_json({text}) AS VARCHAR)"


def _members(**members: str) -> str:
    """JSON object text; a member whose value is NULL is left out.  Name the members in order."""
    return "'{' || concat_ws(',', " + ", ".join(f"""'"{key}":' || {value}""" for key, value in members.items()) + ") || '}'"


_COWRIE_JSON = _members(
    event_id="CASE WHEN event_id % 73 = 0 THEN id_json END",
    eventid="CASE WHEN event_id % 73 = 0 THEN '\"\"' ELSE id_json END",
    input=f"""CASE WHEN kind = 'view' THEN {_quoted(f"{_COMMAND} || CASE WHEN event_id % 11 = 0 THEN chr(1) || chr(10) ELSE '' END")} END""",
    message=_quoted("'about [' || coalesce(uname, '') || '] é'"),
    outfile="CASE WHEN kind = 'purchase' THEN '\"dl/f\"' END",
    password=f"CASE WHEN pw_number THEN pw ELSE {_quoted('props')} END",
    port="CASE WHEN event_id % 4 = 0 THEN '2222' END",
    session=_quoted("sess"),
    shasum=f"CASE WHEN kind = 'purchase' AND event_id % 3 <> 0 THEN {_quoted('md5(props)')} END",
    src_host=f"CASE WHEN event_id % 61 = 0 THEN {_ADDRESS_JSON} END",
    src_ip=f"CASE WHEN event_id % 61 = 0 THEN '\"\"' ELSE {_ADDRESS_JSON} END",
    src_port="CASE WHEN event_id % 2 = 0 THEN '\"' || (40000 + event_id % 1000) || '\"' ELSE CAST(40000 + event_id % 1000 AS VARCHAR) END",
    time=f"CASE WHEN event_id % 73 = 0 THEN {_TIME_JSON} END",
    timestamp=f"CASE WHEN event_id % 73 = 0 THEN 'null' ELSE {_TIME_JSON} END",
    url=_quoted("url"),
    username=_quoted("coalesce(uname, '')"),
)
_SECRET = {"pass": f"CASE WHEN event_id % 3 = 0 THEN {_quoted('props')} END", "password": f"CASE WHEN event_id % 3 <> 0 THEN {_quoted('props')} END"}
_OPENCANARY_JSON = _members(
    dst_port="CASE slot WHEN 0 THEN '21' WHEN 1 THEN '22' WHEN 2 THEN '3306' ELSE '9999' END",
    logdata=_members(dst_port="'1'", **_SECRET, username=_quoted("'u' || user_id")),
    logtype=f"CASE WHEN word IS NULL THEN '2000' ELSE {_quoted(_LOG_WORD)} END",
    **_SECRET,
    src_host=_ADDRESS_JSON,
    src_port="CAST(50000 + event_id % 1000 AS VARCHAR)",
    username=f"coalesce({_quoted('uname')}, 'null')",
    utc_time=_TIME_JSON,
)

BASE = f"""
src AS (
  SELECT event_id, ts, user_id, event_type AS kind, props,
         CASE WHEN event_id % 71 <> 0 THEN '10.0.' || (user_id % 8) || '.' || (user_id % 8 + 1) END AS ip,
         CASE WHEN event_id % 97 = 0 OR event_id % 67 = 0 OR event_id % 101 = 0 THEN 'not_dict_or_bad_json'
              WHEN event_id % 89 = 0 THEN 'bad_ts' END AS reason,
         CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS copies
  FROM events),
c0 AS (
  SELECT *, CASE WHEN event_id % 53 <> 0 THEN 'u' || user_id END AS uname,
         CASE WHEN event_id % 59 = 0 THEN CAST(event_id % 1000 AS VARCHAR) ELSE props END AS pw,
         event_id % 59 = 0 AS pw_number,
         CASE WHEN kind = 'view' THEN trim({_COMMAND}, ' ')
              ELSE 'about [' || CASE WHEN event_id % 53 <> 0 THEN 'u' || user_id ELSE '' END || '] é' END AS cmd,
         CASE WHEN kind = 'purchase' AND event_id % 3 <> 0 THEN 'http://h/' || props END AS url,
         user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS sess
  FROM src WHERE user_id % 3 <> 2),
o0 AS (
  SELECT *, (user_id // 3) % 4 AS slot,
         CASE WHEN event_id % 47 <> 0 THEN 'u' || user_id END AS uname, props AS pw,
         CASE kind WHEN 'error' THEN 'login_failed' WHEN 'click' THEN 'login' WHEN 'signup' THEN 'login_success'
                   WHEN 'view' THEN 'connection' END AS word
  FROM src WHERE user_id % 3 = 2),
ent AS (
  SELECT pw, 0.0 - sum(c / n * log2(c / n)) AS bits
  FROM (SELECT pw, ch, CAST(count(*) AS DOUBLE) AS c, CAST(any_value(length(pw)) AS DOUBLE) AS n
        FROM (SELECT pw, unnest(string_split(pw, '')) AS ch
              FROM (SELECT DISTINCT pw FROM (SELECT pw FROM c0 UNION ALL SELECT pw FROM o0)))
        GROUP BY pw, ch)
  GROUP BY pw),
c1 AS (
  SELECT event_id, copies, ts AS ts_utc, 'cowrie' AS source, 'ssh' AS service,
         CASE kind WHEN 'error' THEN 'login_fail' WHEN 'signup' THEN 'login_success' WHEN 'view' THEN 'command'
                   WHEN 'purchase' THEN 'download' ELSE 'other' END AS event_type,
         CASE kind WHEN 'error' THEN 'cowrie.login.failed' WHEN 'signup' THEN 'cowrie.login.success'
                   WHEN 'view' THEN 'cowrie.command.input' WHEN 'purchase' THEN 'cowrie.session.file_download'
                   ELSE 'cowrie.client.version' END AS eventid,
         {_sha16("", "ip")} AS src_ip_hash,
         regexp_replace(ip, '[0-9]+$', '0/24') AS src_ip_masked,
         CAST(40000 + event_id % 1000 AS INTEGER) AS src_port,
         CASE WHEN event_id % 4 = 0 THEN 2222 END AS dst_port, sess AS session_id,
         {_sha16("u|", "uname")} AS username_hash, {_sha16("p|", "pw_used")} AS password_hash,
         CASE WHEN NOT pw_number THEN length(pw) END AS pass_len, CASE WHEN pw_used IS NOT NULL THEN bits END AS pass_entropy,
         cmd AS command, url, CASE WHEN kind = 'purchase' THEN 'dl/f' END AS filename,
         CASE WHEN kind = 'purchase' AND event_id % 3 <> 0 THEN md5(props) END AS file_hash, {_COWRIE_JSON} AS raw_json
  FROM (SELECT *, CASE WHEN NOT (pw_number AND pw = '0') THEN pw END AS pw_used,
               CASE kind WHEN 'error' THEN '"cowrie.login.failed"' WHEN 'signup' THEN '"cowrie.login.success"' WHEN 'view' THEN '"cowrie.command.input"'
                         WHEN 'purchase' THEN '"cowrie.session.file_download"' WHEN 'click' THEN '"cowrie.client.version"' END AS id_json
        FROM c0 LEFT JOIN ent USING (pw))
  WHERE reason IS NULL),
o1 AS (
  SELECT event_id, copies, ts AS ts_utc, 'opencanary' AS source,
         CASE slot WHEN 0 THEN 'ftp' WHEN 1 THEN 'ssh' WHEN 2 THEN 'mysql' ELSE 'unknown' END AS service,
         CASE kind WHEN 'error' THEN 'login_fail' WHEN 'signup' THEN 'login_success' WHEN 'click' THEN 'login_attempt'
                   WHEN 'view' THEN 'connect' ELSE 'other' END AS event_type,
         CASE WHEN word IS NULL THEN '2000' ELSE CASE slot WHEN 0 THEN 'ftp.' WHEN 1 THEN 'ssh.' ELSE '' END || word END AS eventid,
         {_sha16("", "ip")} AS src_ip_hash,
         regexp_replace(ip, '[0-9]+$', '0/24') AS src_ip_masked,
         CAST(50000 + event_id % 1000 AS INTEGER) AS src_port,
         CASE slot WHEN 0 THEN 21 WHEN 1 THEN 22 WHEN 2 THEN 3306 ELSE 9999 END AS dst_port,
         CAST(NULL AS VARCHAR) AS session_id,
         {_sha16("u|", "uname")} AS username_hash, {_sha16("p|", "pw")} AS password_hash,
         length(pw) AS pass_len, bits AS pass_entropy,
         CAST(NULL AS VARCHAR) AS command, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS filename,
         CAST(NULL AS VARCHAR) AS file_hash, {_OPENCANARY_JSON} AS raw_json
  FROM o0 LEFT JOIN ent USING (pw) WHERE reason IS NULL),
cowrie AS (
  SELECT *, sha256(concat_ws('|', source, service, event_type, eventid, {_HASH_TIME.replace("ts", "ts_utc").replace("%Y-%m-%dT", "%Y-%m-%dT")},
           coalesce(src_ip_hash, ''), session_id, coalesce(username_hash, ''), coalesce(password_hash, ''),
           command, coalesce(url, ''), coalesce(filename, ''))) AS event_hash
  FROM c1),
opencanary AS (
  SELECT *, sha256(concat_ws('|', source, service, event_type, eventid, {_HASH_TIME.replace("ts", "ts_utc")},
           coalesce(src_ip_hash, ''), coalesce(username_hash, ''), coalesce(password_hash, ''),
           CAST(dst_port AS VARCHAR))) AS event_hash
  FROM o1),
ev AS (SELECT * FROM cowrie UNION ALL SELECT * FROM opencanary)"""


def time_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def windows(minutes: int, name: str = "win") -> str:
    """Window table over ``ev``; gaps are counted in whole microseconds."""
    length = minutes * 60
    return f"""
logins AS (
  SELECT *, make_timestamp(epoch_us(ts_utc) // {length * 1_000_000} * {length * 1_000_000}) AS window_start,
         epoch_us(ts_utc) - lag(epoch_us(ts_utc)) OVER (PARTITION BY src_ip_hash, service ORDER BY ts_utc, source) AS gap
  FROM ev WHERE event_type IN ('login_fail', 'login_success', 'login_attempt') AND src_ip_hash IS NOT NULL),
{name} AS (
  SELECT window_start, source, service, src_ip_hash, min(src_ip_masked) AS src_ip_masked,
         count(*) AS attempts, count(*) FILTER (WHERE event_type = 'login_success') AS success_count,
         count(DISTINCT username_hash) AS unique_users, count(DISTINCT password_hash) AS unique_passwords,
         avg(pass_entropy) AS pass_entropy_mean,
         CAST(sum(gap) AS DOUBLE) / count(gap) / 1e6 AS mean_interarrival_s, min(gap) / 1e6 AS min_interarrival_s
  FROM logins GROUP BY ALL)"""


def features(minutes: int = 1440) -> str:
    """Windows with imputed measures (``feat``)."""
    return (
        windows(minutes)
        + """,
med AS (
  SELECT service, median(mean_interarrival_s) AS m1, median(min_interarrival_s) AS m2, median(pass_entropy_mean) AS m3
  FROM win GROUP BY service),
feat AS (
  SELECT win.* EXCLUDE (mean_interarrival_s, min_interarrival_s, pass_entropy_mean),
         coalesce(mean_interarrival_s, m1, 0.0) AS mean_interarrival_s,
         coalesce(min_interarrival_s, m2, 0.0) AS min_interarrival_s,
         coalesce(pass_entropy_mean, m3, 0.0) AS pass_entropy_mean,
         CAST(unique_users AS DOUBLE) / attempts AS users_per_attempt,
         CAST(unique_passwords AS DOUBLE) / attempts AS passwords_per_attempt,
         CAST(success_count AS DOUBLE) / attempts AS success_rate,
         ln(1 + attempts) AS log_attempts, ln(1 + unique_users) AS log_unique_users,
         ln(1 + unique_passwords) AS log_unique_passwords
  FROM win JOIN med USING (service))"""
    )


def with_tables(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in (BASE, *parts))
