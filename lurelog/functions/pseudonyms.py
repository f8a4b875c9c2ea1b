"""Salted pseudonyms and event fingerprints, as SQL text."""

from __future__ import annotations

from lurelog.functions.local import quoted


def _short_sha(salt: str, mark: str, text: str) -> str:
    return f"substring(sha2(concat({quoted(f'{salt}|{mark}')}, {text}), 256), 1, 16)"


def hash_ip(ip: str, salt: str) -> str:
    """16 hex digits of sha256(salt|ip); NULL for a missing or empty address."""
    return f"CASE WHEN {ip} <> '' THEN {_short_sha(salt, '', ip)} END"


def hash_user(text: str, salt: str) -> str:
    return _short_sha(salt, "u|", text)


def hash_password(text: str, salt: str) -> str:
    return _short_sha(salt, "p|", text)


def fingerprint(parts: list[str]) -> str:
    """sha256 over the parts joined by a pipe, a NULL part counting as empty."""
    filled = ", ".join(f"coalesce({part}, '')" for part in parts)
    return f"sha2(concat_ws('|', {filled}), 256)"
