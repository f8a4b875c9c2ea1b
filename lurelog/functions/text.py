"""Text measures and clean-up for passwords and commands, as SQL text."""

from __future__ import annotations

from lurelog.functions.json_values import strip
from lurelog.functions.local import let


def without_control_chars(text: str) -> str:
    """Drop code points below 32 except tab and newline, then trim."""
    return strip(f"regexp_replace({text}, r'[\\x00-\\x08\\x0B-\\x1F]', '')")


def shannon_entropy(text: str) -> str:
    """Bits per character of the trimmed text; NULL when nothing is left."""
    # Every character's share is computed once, over the distinct ones.
    shares = "transform(array_distinct(split(body, '')), c -> (n - char_length(replace(body, c, ''))) / n)"
    bits = f"aggregate({shares}, 0D, (acc, share) -> acc - share * log2(share))"
    counted = let("n", "char_length(body)", bits)
    return let("body", strip(text), f"CASE WHEN body <> '' THEN {counted} END")


def first_word(line: str) -> str:
    return f"regexp_extract(lower({strip(line)}), r'(?U)^(\\S+)', 1)"


def command_tokens(lines: str) -> str:
    """First word of every command line, lower-cased, words of one letter dropped."""
    return f"filter(transform({lines}, line -> {first_word('line')}), w -> char_length(w) >= 2)"


def command_doc(lines: str) -> str:
    """One document per session: its command words joined by blanks."""
    return f"coalesce(array_join({command_tokens(lines)}, ' '), '')"


def words(doc: str) -> str:
    """Words of two or more letters, digits, ``_`` or ``-``."""
    return f"regexp_extract_all(lower({doc}), r'(?U)\\b([a-zA-Z0-9_\\-]{{2,}})\\b', 1)"


def doc_terms(doc: str) -> str:
    """All words and pairs of neighbouring words."""
    pairs = """zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)),
                        (a, b) -> concat(a, ' ', b))"""
    return let("w", words(doc), f"concat(w, {pairs})")
