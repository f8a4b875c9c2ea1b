"""Two-stage suffix sorting of one byte string in numpy, and adjacent common prefixes.

A suffix is *small* when it sorts before the suffix one place on.  Only small
suffixes are sorted by content; the others follow from the order of their
successors: going through the buckets of first symbols in ascending order, each
finished suffix yields its predecessor, which is appended to its own bucket.
Order and common prefixes are exact up to ``depth`` symbols.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def words_at(text: np.ndarray, spare: int) -> np.ndarray:
    """For every position the next eight symbols as one number; ``spare`` zeros follow the end."""
    padded = np.concatenate([text, np.zeros(spare + WORD, np.uint8)])
    return np.ndarray((len(text) + spare,), ">u8", padded, strides=(1,)).astype(np.uint64)


def small_suffixes(text: np.ndarray) -> np.ndarray:
    """Whether each suffix sorts before its successor; equal symbols look on to the next change."""
    step = np.sign(np.diff(text.astype(np.int16)))
    place = np.where(step != 0, np.arange(len(step)), len(step))
    change = np.minimum.accumulate(place[::-1])[::-1]
    small = np.zeros(len(text), bool)  # the last suffix is larger than the empty one
    known = change < len(step)
    small[:-1][known] = step[change[known]] > 0
    return small


def sort_by_content(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``places`` ordered by the ``depth`` symbols that follow each."""
    first = words[places]
    order = np.argsort(first, kind="stable")
    places, first = places[order], first[order]
    begins = np.r_[True, first[1:] != first[:-1]] if len(places) else np.empty(0, bool)
    at = WORD
    while at < depth and len(places):
        group = np.cumsum(begins)
        tied = np.flatnonzero(~begins | np.r_[~begins[1:], False])
        if not len(tied):
            break
        key, of = words[places[tied] + at], group[tied]
        differs = np.r_[False, (key[1:] != key[:-1]) & (of[1:] == of[:-1])]
        if differs.any():
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[of[differs]] = True
            rows = np.flatnonzero(mixed[of])
            moved = rows[np.lexsort((key[rows], of[rows]))]
            places[tied[rows]] = places[tied[moved]]
            key[rows] = key[moved]
            changed = np.r_[False, (key[1:] != key[:-1]) & (of[1:] == of[:-1])]
            begins[tied[changed]] = True
        at += WORD
    return places


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of ``text`` (``uint8``, ending in its only or smallest symbol 0), in order."""
    words = words_at(text, depth) if words is None else words
    small = small_suffixes(text)
    direct = sort_by_content(np.flatnonzero(small).astype(np.int32), words, depth)
    direct_of = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([len(text) - 1], np.int32))
    done = []
    for symbol in range(256):
        induced = waiting[symbol]
        level = np.concatenate(induced) if induced else np.empty(0, np.int32)
        parts = [level]
        while len(level):
            # Predecessors that repeat the symbol belong to the same bucket, after those that led here.
            before = level[level > 0] - 1
            level = before[~small[before] & (text[before] == symbol)]
            parts.append(level)
        bucket = np.concatenate([*parts, direct[direct_of[symbol] : direct_of[symbol + 1]]])
        waiting[symbol] = []
        if not len(bucket):
            continue
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (text[before] > symbol)]
        if len(before):
            heads = text[before]
            order = np.argsort(heads, kind="stable")
            before, heads = before[order], heads[order]
            cuts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
            for head, chunk in zip(heads[cuts].tolist(), np.split(before, cuts[1:]), strict=True):
                waiting[head].append(chunk)
    return np.concatenate(done)


def reach(words: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Whether each pair of suffixes has a common prefix of at least ``depth`` symbols."""
    alive = np.arange(len(left))
    for at in range(0, depth - WORD + 1, WORD):
        alive = alive[words[left[alive] + at] == words[right[alive] + at]]
        if not len(alive):
            break
    rest = depth % WORD
    if rest and len(alive):
        alive = alive[words[left[alive] + depth - WORD] == words[right[alive] + depth - WORD]]
    same = np.zeros(len(left), bool)
    same[alive] = True
    return same


def repeated(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Of the positions flagged in ``starts`` those whose next ``depth`` symbols begin at another one too."""
    words = words_at(text, depth)
    order = suffix_array(text, depth, words)
    order = order[starts[order]]
    same = reach(words, order[:-1], order[1:], depth)
    found = np.zeros(len(text), bool)
    found[order[:-1][same]] = True
    found[order[1:][same]] = True
    return found
