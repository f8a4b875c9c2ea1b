"""IPv4 and IPv6 text as SQL expressions (no Python in the scan)."""

from __future__ import annotations

from lurelog.functions.json_values import strip
from lurelog.functions.local import let

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
MAPPED_PREFIX = "::ffff:"


def normalize_ip(text: str) -> str:
    """Canonical address text; NULL when the text is not an address."""
    return let("ip", unmapped(text), canonical("ip"))


def unmapped(text: str) -> str:
    """The trimmed text without the prefix of an IPv4 address in IPv6."""
    trimmed = strip(text)
    return f"""CASE WHEN startswith({trimmed}, '{MAPPED_PREFIX}')
                    THEN replace({trimmed}, '{MAPPED_PREFIX}', '') ELSE {trimmed} END"""


def canonical(ip: str) -> str:
    """``normalize_ip`` of a text that is ``unmapped`` already."""
    return f"""CASE WHEN {ip} RLIKE r'^{V4}\\z' THEN {ip}
                    WHEN contains({ip}, ':') THEN {_normalize_v6(ip)} END"""


def mask_ip(ip: str) -> str:
    """Network of a canonical address: /24 for IPv4, /64 for IPv6."""
    network = _v6_text("concat(slice(groups, 1, 4), array_repeat('0', 4))")
    v6 = let("groups", _v6_groups(f"substring_index({ip}, '%', 1)"), f"concat({network}, '/64')")
    return f"""CASE WHEN contains({ip}, ':') THEN {v6}
                    WHEN {ip} IS NOT NULL THEN concat(substring_index({ip}, '.', 3), '.0/24') END"""


def _normalize_v6(ip: str) -> str:
    address = _v6_text(_v6_groups(f"lower(substring_index({ip}, '%', 1))"))
    scope = f"regexp_extract({ip}, r'^[^%]*(%[^%/]+)\\z', 1)"
    return let(
        "address",
        address,
        f"""CASE WHEN NOT contains({ip}, '%') THEN address
                 WHEN {scope} <> '' THEN concat(address, {scope}) END""",
    )


def _v6_groups(text: str) -> str:
    """Eight groups without leading zeros, or NULL for malformed text."""
    return let("plain", _v4_tail_as_hex(text), let("halves", "split(plain, '::', -1)", _fill_groups()))


def _v4_tail_as_hex(text: str) -> str:
    """An IPv4 address at the end written as the two groups it stands for."""

    def pair(i: int) -> str:
        high, low = (f"try_cast(get(octets, {j}) AS BIGINT)" for j in (i, i + 1))
        return f"lower(hex({high} * 256 + {low}))"

    octets = rf"split(regexp_extract({text}, r':({V4})\z', 1), r'\.')"
    head = rf"regexp_extract({text}, r'^(.*:){V4}\z', 1)"
    tail = let("octets", octets, f"concat({pair(0)}, ':', {pair(2)})")
    return rf"CASE WHEN {text} RLIKE r':{V4}\z' THEN concat({head}, {tail}) ELSE {text} END"


def _fill_groups() -> str:
    """Both sides of ``::`` (``halves``) with the zeros between them filled in."""
    none = "cast(array() AS ARRAY<STRING>)"

    def groups_of(i: int) -> str:
        half = f"get(halves, {i})"
        return f"CASE WHEN coalesce({half}, '') = '' THEN {none} ELSE split({half}, ':', -1) END"

    fill = r"""
        CASE WHEN forall(concat(s.head, s.tail), g -> g RLIKE r'^[0-9a-f]{1,4}\z')
              AND ((size(halves) = 1 AND size(s.head) = 8)
                   OR (size(halves) = 2 AND size(s.head) + size(s.tail) <= 7))
             THEN transform(
               concat(s.head, array_repeat('0', 8 - size(s.head) - size(s.tail)), s.tail),
               g -> regexp_replace(g, r'^0+(?=.)', '')) END"""
    return let("s", f"named_struct('head', {groups_of(0)}, 'tail', {groups_of(1)})", fill)


def _v6_text(groups: str) -> str:
    """Join eight groups, shortening the first longest run of two or more zeros to ``::``."""
    run = "concat(repeat(':0', n), ':')"
    longest = f"get(filter(array(8, 7, 6, 5, 4, 3, 2), n -> position({run} IN joined) > 0), 0)"
    cut = """concat(left(joined, position(run IN joined) - 1), '::',
                    substring(joined, position(run IN joined) + char_length(run)))"""
    shortened = let("n", longest, let("run", run, f"CASE WHEN n IS NULL THEN joined ELSE {cut} END"))
    text = let("joined", f"concat(':', array_join({groups}, ':'), ':')", shortened)
    # A single colon left at either end is only the separator added above.
    return f"regexp_replace({text}, r'^:(?!:)|(?<!:):$', '')"
