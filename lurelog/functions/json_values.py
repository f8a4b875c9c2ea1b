"""Field access on parsed JSON records with Python truth rules, as SQL text.

A sensor field may be missing, JSON null, or hold any JSON type.  Fallback
chains in the log formats skip every *falsy* value (empty text, zero, false,
empty list or object), not only missing ones.
"""

from __future__ import annotations

# Characters that count as white space when text is trimmed.
WHITESPACE = (
    "\\t\\n\\u000b\\u000c\\r\\u001c\\u001d\\u001e\\u001f \\u0085\\u00a0\\u1680"
    "\\u2000\\u2001\\u2002\\u2003\\u2004\\u2005\\u2006\\u2007\\u2008\\u2009\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000"
)


def strip(text: str) -> str:
    return f"trim(BOTH '{WHITESPACE}' FROM {text})"


def field(record: str, key: str, nested: str | None = None) -> str:
    """The VARIANT under ``key``, NULL only where the key is missing.

    With ``nested`` the key is also looked up one level down; a top-level key
    wins even when its value is JSON null.
    """
    top = f"{record}.`{key}`"
    if nested is None:
        return top
    return f"coalesce({top}, try_variant_get({record}.`{nested}`, '$.{key}', 'variant'))"


def _kind(value: str) -> str:
    return f"schema_of_variant({value})"


def plain(value: str) -> str:
    """Text of a VARIANT; each call costs a cast, so give the text of a value that is looked at often."""
    return f"try_variant_get({value}, '$', 'string')"


# Texts of falsy values; as JSON strings they are truthy.
FALSY = "'0', '0.0', '-0.0', '[]', '{}', 'false'"


def is_truthy(value: str, read: str | None = None) -> str:
    """The type is looked at only where the text could be that of a falsy value.

    ``read`` names a column with the value's ``plain`` text.
    """
    read = read or plain(value)
    return f"""CASE WHEN {read} IS NULL OR {read} = '' THEN false
                    WHEN {read} IN ({FALSY}) THEN {_kind(value)} = 'STRING' ELSE true END"""


def first_truthy(record: str, keys: list[str], nested: str | None = None) -> str:
    """``a or b or c``: the first truthy value, else the last key's own value."""
    values = [field(record, key, nested) for key in keys]
    return first_of([is_truthy(value) for value in values], values)


def first_of(truthy: list[str], results: list[str]) -> str:
    """The result beside the first true condition, else the last result."""
    if len(results) == 1:
        return results[0]
    chain = " ".join(f"WHEN {test} THEN {result}" for test, result in zip(truthy[:-1], results))
    return f"CASE {chain} ELSE {results[-1]} END"


def is_string(value: str) -> str:
    return f"coalesce({_kind(value)} = 'STRING', false)"


def as_text(value: str, read: str | None = None) -> str:
    """Text form of any JSON value; NULL for missing and JSON null."""
    read = read or plain(value)
    return f"""CASE WHEN {read} IN ('true', 'false') AND {_kind(value)} = 'BOOLEAN' THEN initcap({read})
                    ELSE {read} END"""


def as_int(text: str, string: str) -> str:
    """Integer reading: whole-number text is accepted, ``"22.7"`` is not, 22.7 becomes 22."""
    plain = strip(text)
    return f"""CASE WHEN {plain} RLIKE r'^[+-]?\\d+$' THEN try_cast({plain} AS INT)
                    WHEN {text} = 'True' AND NOT {string} THEN 1
                    WHEN {text} = 'False' AND NOT {string} THEN 0
                    WHEN NOT {string} THEN try_cast(try_cast({text} AS DOUBLE) AS INT) END"""
