"""Raw log lines to canonical event rows and rejected lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelog import schema
from lurelog.functions import addresses, json_values as jv, kinds, pseudonyms, text, times
from lurelog.functions.local import columns

BAD_JSON = "not_dict_or_bad_json"
BAD_TIME = "bad_ts"
NESTED = "logdata"

# The line is parsed as the first of two array elements.  Text after the record,
# or a second record, makes the parse fail or the element count differ.
_GUARD = "end~"

# Input keys per canonical field, in fallback order.
INTERACTIVE_KEYS = {
    "eventid": ["eventid", "event_id", "event"],
    "ts": ["timestamp", "time", "ts"],
    "src_ip": ["src_ip", "src_host", "src", "ip"],
    "src_port": ["src_port"],
    "dst_port": ["dst_port", "port"],
    "session_id": ["session", "session_id"],
    "username": ["username"],
    "password": ["password"],
    "command": ["input", "command", "message"],
    "url": ["url"],
    "filename": ["outfile", "filename", "destfile"],
    "file_hash": ["sha256", "shasum", "hash"],
}
LOW_INTERACTION_KEYS = {
    "eventid": ["logtype", "type"],
    "service_hint": ["logtype", "type", "logger"],
    "ts": ["utc_time", "timestamp", "time", "local_time"],
    "src_ip": ["src_host", "src_ip", "src", "ip"],
    "src_port": ["src_port"],
    "dst_port": ["dst_port", "port"],
    "username": ["username", "user"],
    "password": ["password", "pass"],
}


# Fields for which a JSON string and another JSON type are treated differently.
TYPED = ["eventid", "ts", "src_port", "dst_port", "password"]


def parse_records(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``rec``: the wanted members of the line's JSON object, each a VARIANT.

    NULL for anything but one whole object.  One pass over the text reads all
    members; a repeated key keeps its last value.
    """
    members = ", ".join(f"`{key}`: VARIANT" for key in dict.fromkeys(keys))
    # Trimming walks over the whole line; one that begins and ends with its braces has nothing to trim.
    body = f"CASE WHEN startswith(value, '{{') AND endswith(value, '}}') THEN value ELSE {jv.strip('value')} END"
    parsed = lines.withColumn(
        "_pair",
        F.expr(
            f"""from_json(concat('[', {body}, ',{{"{_GUARD}":0}}]'),
                          'ARRAY<STRUCT<{members}, `{_GUARD}`: INT>>', map('allowSingleQuotes', 'false'))"""
        ),
    )
    whole = f"size(_pair) = 2 AND get(_pair, 1).`{_GUARD}` = 0"
    return parsed.withColumn("rec", F.expr(f"CASE WHEN {whole} THEN get(_pair, 0) END")).drop("_pair")


def _pick(lines: DataFrame, keys: dict[str, list[str]], nested: str | None) -> DataFrame:
    """One text column per canonical field, chosen by the fallback rules.

    Fields whose JSON type matters also get a ``…_is_string`` flag, credentials
    a ``given_…`` text that is NULL for falsy values.
    """
    members = list(dict.fromkeys(key for names in keys.values() for key in names))
    # Every member's text is read once, and all choices are made on these texts.
    values = {f"f_{key}": jv.field("rec", key, nested) for key in members}
    texts = {f"t_{key}": jv.plain(f"f_{key}") for key in members}
    read = {}
    for name, names in keys.items():
        truthy = [jv.is_truthy(f"f_{key}", f"t_{key}") for key in names]
        text_of = [jv.as_text(f"f_{key}", f"t_{key}") for key in names]
        read[f"v_{name}"] = jv.first_of(truthy, text_of)
        if name in TYPED:
            read[f"{name}_is_string"] = jv.first_of(truthy, [jv.is_string(f"f_{key}") for key in names])
        if name in ("username", "password"):
            read[f"given_{name}"] = jv.first_of([*truthy, ""], [*text_of, "NULL"])
    parsed = parse_records(lines, members + ([nested] if nested else []))
    return parsed.withColumns(columns(**values)).withColumns(columns(**texts)).withColumns(columns(**read))


def _identity(picked: DataFrame, salt: str) -> DataFrame:
    """Columns both sensors derive the same way: time, address, ports, credentials."""
    reason = f"CASE WHEN rec IS NULL THEN '{BAD_JSON}' WHEN ts_utc IS NULL THEN '{BAD_TIME}' END"
    timed = picked.withColumns(
        columns(ts_utc=times.parse_event_time("v_ts", "ts_is_string"), ip_text=addresses.unmapped("v_src_ip"))
    )
    # A generator in between keeps a later filter on the reason from being pushed
    # below the parse, where the optimizer would repeat the whole expression.
    checked = timed.withColumn(
        "checked", F.explode_outer(F.array(F.struct("ts_utc", F.expr(reason).alias("reject_reason"))))
    )
    typed = checked.withColumns(
        columns(
            ts_utc="checked.ts_utc",
            reject_reason="checked.reject_reason",
            src_ip=addresses.canonical("ip_text"),
            src_port=jv.as_int("v_src_port", "src_port_is_string"),
            dst_port=jv.as_int("v_dst_port", "dst_port_is_string"),
            eventid="v_eventid",
            username="v_username",
            password="v_password",
        )
    )
    return typed.withColumns(
        columns(
            src_ip_hash=pseudonyms.hash_ip("src_ip", salt),
            src_ip_masked=addresses.mask_ip("src_ip"),
            username_hash=pseudonyms.hash_user("given_username", salt),
            password_hash=pseudonyms.hash_password("given_password", salt),
            pass_len="CASE WHEN password_is_string THEN char_length(password) END",
            pass_entropy=text.shannon_entropy("given_password"),
        )
    )


def _canonical(df: DataFrame, raw_json: str, keep_secrets: bool, redact: bool) -> DataFrame:
    """Project to the canonical schema plus where the line came from and why it failed."""
    hidden = [] if keep_secrets else ["src_ip", "username", "password"]
    changes = {name: "cast(NULL AS STRING)" for name in hidden}
    changes["raw_json"] = "cast(NULL AS STRING)" if redact else raw_json
    if redact:
        changes["command"] = "CASE WHEN event_type = 'command' THEN command END"
    changes["raw"] = f"CASE WHEN reject_reason IS NOT NULL THEN {jv.strip('value')} END"
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.EVENTS.fields]
    origin = [c for c in ("file", "line") if c in df.columns]
    return df.withColumns(columns(**changes)).select(*typed, *origin, "reject_reason", "raw")


def normalize_cowrie(
    lines: DataFrame, *, salt: str, redact_free_text: bool, keep_secrets: bool = False
) -> DataFrame:
    """Canonical rows of the interactive sensor; a bad line keeps its ``reject_reason``.

    Free text can carry clear-text passwords and addresses.  The caller says
    whether to redact it: ``raw_json`` is then left out and ``command`` kept for
    command events only.  Texts are kept whole.
    """
    picked = _identity(_pick(lines, INTERACTIVE_KEYS, None), salt)
    full = picked.withColumns(
        columns(
            source="'cowrie'",
            service="'ssh'",
            event_type=kinds.event_type_by_id("eventid", "eventid_is_string"),
            session_id="v_session_id",
            command=text.without_control_chars("v_command"),
            command_truncated="false",
            url="v_url",
            filename="v_filename",
            file_hash="v_file_hash",
        )
    )
    parts = [
        "source", "service", "event_type", "eventid", times.iso_utc("ts_utc"), "src_ip_hash",
        "session_id", "username_hash", "password_hash", "command",
        "url", "filename",
    ]
    hashed = full.withColumn("event_hash", F.expr(pseudonyms.fingerprint(parts)))
    return _canonical(hashed, _RECORD_JSON, keep_secrets, redact_free_text)


def normalize_opencanary(
    lines: DataFrame, *, salt: str, redact_free_text: bool, keep_secrets: bool = False
) -> DataFrame:
    """Canonical rows of the low-interaction sensor; ``logdata`` is merged up first."""
    picked = _identity(_pick(lines, LOW_INTERACTION_KEYS, NESTED), salt)
    unused = ["session_id", "command", "url", "filename", "file_hash"]
    lowered = picked.withColumns(columns(lower_hint="lower(v_service_hint)", lower_id="lower(eventid)"))
    full = lowered.withColumns(
        columns(
            source="'opencanary'",
            service=kinds.service_by_log_type("v_service_hint", "dst_port", "lower_hint"),
            event_type=kinds.event_type_by_log_type("eventid", "lower_id"),
            command_truncated="false",
            **{name: "cast(NULL AS STRING)" for name in unused},
        )
    )
    parts = [
        "source", "service", "event_type", "eventid", times.iso_utc("ts_utc"), "src_ip_hash",
        "username_hash", "password_hash", "CASE WHEN dst_port <> 0 THEN cast(dst_port AS STRING) END",
    ]
    hashed = full.withColumn("event_hash", F.expr(pseudonyms.fingerprint(parts)))
    return _canonical(hashed, _FLATTENED_JSON, keep_secrets, redact_free_text)


# The whole record as JSON text, members in name order.
_RECORD_JSON = "coalesce(to_json(try_parse_json(value)), value)"

# The same with ``logdata`` members merged up; top-level members win.
_FLATTENED_JSON = f"""
    coalesce(to_json(map_from_entries(array_sort(concat(
        filter(map_entries(coalesce(try_variant_get(try_parse_json(value), '$.{NESTED}', 'map<string,variant>'), map())),
               e -> NOT map_contains_key(try_cast(try_parse_json(value) AS MAP<STRING, VARIANT>), e.key)),
        map_entries(try_cast(try_parse_json(value) AS MAP<STRING, VARIANT>))),
        (a, b) -> CASE WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END))), value)
"""


def valid_events(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNull()).select(*schema.EVENTS.names)


def rejects(normalized: DataFrame) -> DataFrame:
    """Rejected lines as ``file, line, reason, raw`` (``line`` only for numbered scans)."""
    origin = [c for c in ("file", "line") if c in normalized.columns]
    bad = normalized.filter(F.col("reject_reason").isNotNull())
    return bad.select(*origin, F.col("reject_reason").alias("reason"), "raw")


def split_valid_rejects(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of one normalised frame; stage it first to parse only once."""
    return valid_events(normalized), rejects(normalized)
