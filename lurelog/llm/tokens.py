"""Token ids of whole texts, word by word with a bounded memory of words.

A text splits where the tokenizer's own pre-tokenization always splits, so the
ids of the pieces, each encoded by the tokenizers library, join to the ids of
the text.  Most pieces of a corpus repeat; a process keeps those it has seen,
up to ``REMEMBERED``, and gives only new ones to the library.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces one Python worker keeps.
REMEMBERED = 1_000_000
#: A piece longer than this is not kept.
LONGEST_KEPT = 64
#: Unknown pieces that are encoded as one line.
LINE = 64
#: Characters whose pieces are looked up together.
TOGETHER = 1 << 20
END = b"\x00\x00\x00\x00"
#: Letters that neither normalisation nor lower-casing turns into other than letters.
_L = "[A-Za-zÀ-įı-ɏ]"
#: A place before a letter where pre-tokenization always splits: behind a mark that is no
#: apostrophe, or behind a digit.
_BEHIND_MARK = rf"(?<=[!-&(-/:-@\[-`{{-~0-9]){_L}"
#: Pieces: a run of letters that ends at an ASCII character, else all up to the next sure split.
_SPACED = re.compile(rf" ?{_L}++(?=[\x00-\x7f]|\Z)|.+?(?= {_L}|{_BEHIND_MARK}|(?<=[^\s]\n){_L}|\Z)", re.S)
_WORDS = re.compile(rf"{_L}++(?=[\x00-\x7f]|\Z)|[^ \t\n\r]+?(?=[ \t\n\r]|{_BEHIND_MARK}|\Z)", re.S)
#: Pieces that stay themselves between line breaks.
_NO_BREAK = re.compile(r" ?\S+\Z")
_ONE_WORD = re.compile(rf"{_L}+\Z")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, without an end id."""

    def __init__(self, path: str, words_only: bool):
        """``words_only``: the tokenizer drops white space, so any blank parts two pieces."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words_only = words_only
        if words_only:
            vocabulary = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        else:
            (self.line_break,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def whole_words(self, words: list[str]) -> list[bytes]:
        """The same for pieces, plain ones joined to lines: one result for many of them.

        A line's ids part again at the break's id, or where a word ends if the
        tokenizer drops breaks.
        """
        plain = [k for k, w in enumerate(words) if self._plain(w)]
        odd = [k for k, w in enumerate(words) if not self._plain(w)]
        found = [b""] * len(words)
        for k, ids in zip(odd, self.whole([words[k] for k in odd]), strict=True):
            found[k] = ids
        lines = [plain[at : at + LINE] for at in range(0, len(plain), LINE)]
        texts = ["\n".join([words[k] for k in line]) for line in lines]
        for line, data in zip(lines, self.whole(texts), strict=True):
            ids = np.frombuffer(data, "<u4")
            if self.words_only:
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                begins = np.r_[0, ends[:-1]]
            else:
                cuts = np.flatnonzero(ids == self.line_break)
                begins, ends = np.r_[0, cuts + 1], np.r_[cuts, len(ids)]
            if len(begins) != len(line):
                raise AssertionError("a line of words did not part into its words")
            for k, a, b in zip(line, (4 * begins).tolist(), (4 * ends).tolist(), strict=True):
                found[k] = data[a:b]
        return found

    def _plain(self, word: str) -> bool:
        """Whether the piece keeps its ids between two breaks, and can be told apart there."""
        return bool((_ONE_WORD if self.words_only else _NO_BREAK).match(word))

    def pieces(self, text: str) -> list[str]:
        return (_WORDS if self.words_only else _SPACED).findall(text)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text in order; the pieces of at most about ``TOGETHER`` characters exist at a time."""
        held, size = [], 0
        for text in texts:
            text = text or ""
            if size + len(text) > TOGETHER and held:
                yield from self._encode(held)
                held, size = [], 0
            if len(text) > TOGETHER:
                yield b"".join(self._long(text))
            else:
                held.append(text)
                size += len(text)
        yield from self._encode(held)

    def _long(self, text: str) -> Iterator[bytes]:
        matches = (m.group() for m in (_WORDS if self.words_only else _SPACED).finditer(text))
        while pieces := list(islice(matches, TOGETHER // 8)):
            yield self._encode_pieces([pieces])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return self._encode_pieces([self.pieces(t) if t else [] for t in texts])

    def _encode_pieces(self, split: list[list[str]]) -> list[bytes]:
        known = self.known
        found = [list(map(known.get, pieces)) for pieces in split]
        lacking: dict[str, bytes] = {}
        gaps = []
        for pieces, ids in zip(split, found, strict=True):
            if None in ids:
                holes = [k for k, x in enumerate(ids) if x is None]
                gaps.append((pieces, ids, holes))
                for k in holes:
                    lacking[pieces[k]] = b""
        lacking = dict(zip(lacking, self.whole_words(list(lacking)), strict=True))
        for pieces, ids, holes in gaps:
            for k in holes:
                ids[k] = lacking[pieces[k]]
        # The first words met are mostly the frequent ones; they stay, later ones come and go.
        room = REMEMBERED - len(known)
        if room > 0:
            known.update(islice(((p, x) for p, x in lacking.items() if len(p) <= LONGEST_KEPT), room))
        return [b"".join(ids) for ids in found]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, words_only: bool) -> Encoder:
    """The encoder of this process."""
    key = (path, words_only)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, words_only)
    return _ENCODERS[key]
