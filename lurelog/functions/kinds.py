"""Event-kind and service classification, as SQL text."""

from __future__ import annotations

# Ends of the interactive sensor's event ids, first match wins.
EVENT_SUFFIXES = [
    ("login.failed", "login_fail"),
    ("login.success", "login_success"),
    ("command.input", "command"),
    ("session.connect", "connect"),
    ("session.closed", "disconnect"),
]
DOWNLOAD_MARK = "file_download"

# Words looked for in the low-interaction sensor's log type, in order.
SERVICE_WORDS = ["ftp", "mysql", "rdp", "ssh", "smb", "http"]

# Service by destination port when the log type says nothing.
SERVICE_PORTS = {21: "ftp", 22: "ssh", 80: "http", 443: "http", 3389: "rdp", 3306: "mysql", 445: "smb"}


def event_type_by_id(eventid: str, textual: str) -> str:
    """Kind of an interactive-sensor event; ids that are not text are ``other``."""
    cases = [f"WHEN NOT {textual} THEN 'other'"]
    cases += [f"WHEN endswith({eventid}, '{end}') THEN '{kind}'" for end, kind in EVENT_SUFFIXES]
    cases.append(f"WHEN contains({eventid}, '{DOWNLOAD_MARK}') THEN 'download'")
    return f"CASE {' '.join(cases)} ELSE 'other' END"


def service_by_log_type(log_type: str, port: str, lowered: str | None = None) -> str:
    """``lowered`` names a column with the type in lower case, here and below."""
    lowered = lowered or f"lower({log_type})"
    by_word = [f"WHEN contains({lowered}, '{w}') THEN '{w}'" for w in SERVICE_WORDS]
    by_port = [f"WHEN {port} = {number} THEN '{name}'" for number, name in SERVICE_PORTS.items()]
    return f"CASE {' '.join(by_word + by_port)} ELSE 'unknown' END"


def event_type_by_log_type(log_type: str, lowered: str | None = None) -> str:
    kind = lowered or f"lower({log_type})"
    login = f"contains({kind}, 'login')"
    return f"""CASE WHEN {login} AND contains({kind}, 'fail') THEN 'login_fail'
                    WHEN {login} AND contains({kind}, 'success') THEN 'login_success'
                    WHEN {login} THEN 'login_attempt'
                    WHEN contains({kind}, 'connect') THEN 'connect' ELSE 'other' END"""
