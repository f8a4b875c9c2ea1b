"""Secrets in texts: fixed patterns, and formats inferred from what the patterns find.

The first pass over the texts finds the values of base matches; these labelled
credentials, a bounded draw of them, train one probabilistic automaton for each
kind.  It also counts, over all texts, which character follows which two others
outside of base matches: the background.  The second pass scores the candidates: maximal
runs of credential characters, and their parts between separators, such as the
value in ``name=value`` or a step of a path.  A candidate that no base match
touches becomes a span of kind ``format`` when it is as likely as all but the
least likely of the credentials that an automaton learned from, and when it is
likelier a credential than background: the ratio of the two likelihoods times
that of labelled credentials to runs in the background is over one.  So plain
words are no spans where passwords are words, and a value that many texts repeat
is background; a candidate's own occurrence does not count.  Of overlapping candidates the
leftmost counts, and of those that begin together the longest.

An automaton knows no length that its credentials do not have, so from each
separator a scan goes no further than the longest of them: the time is linear
in the text.

All patterns are ASCII, so a text is read as one byte a code point, with ``?``
for the rest; offsets are code points.

Defined cases
    null or empty text   no span
    very long texts      read whole
    repeated rows        each has its own, equal result
    null identifier      a document like any other
    no labelled credential of a kind   that kind adds no span
    one run of millions of characters  scanned in linear time
    empty table          empty result
    clashing columns     only identifier and text are read
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelog.llm.automata import Automaton, Chain
from lurelog.staging import staged

# Kinds in their order, their patterns, and the least length of what counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KEYWORDS = (b"passw", b"secret", b"token", b"api")
FORMAT = "format"
#: Characters of a candidate, those among them that part it, and the fewest characters.
CANDIDATE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SEPARATORS = "+/_.=-"
CANDIDATE_LEAST = min(LEAST.values())
#: Credentials of one kind an automaton learns from, at most.
LEARN = 600
#: Share of the learned credentials that may be less likely than an accepted candidate.
LEAST_LIKELY = 0.02
#: The place of each byte among the candidate characters, from 1; 0 for all others.
_PLACE = np.zeros(256, np.int32)
_PLACE[list(CANDIDATE)] = np.arange(1, len(CANDIDATE) + 1)
_PLACES = len(CANDIDATE) + 1
#: What the first pass writes beside labelled values: characters behind two others, and runs.
TRIPLE, RUN = "triple", "run"

Span = tuple[int, int, int]
#: An automaton, its least likelihood for each character, and the bits by which it must exceed the background.
Format = tuple[Automaton, float, float]


def runs(data: bytes, least: int = CANDIDATE_LEAST) -> list[tuple[int, int]]:
    """Maximal runs of candidate characters of at least ``least``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _PLACE[np.frombuffer(data, np.uint8)] > 0
    step = np.flatnonzero(np.diff(inside))
    begin, end = step[0::2], step[1::2]
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))


def scan(text: str | None) -> tuple[list[Span], list[tuple[str, str]], list[tuple[int, str]]]:
    """Base spans ``(start, kind, end)`` in order, labelled values, and runs ``(start, value)``."""
    data = (text or "").encode("ascii", "replace")
    spans: list[Span] = []
    values: list[tuple[str, str]] = []
    lower = data.lower()
    if any(k in lower for k in KEYWORDS):
        for m in ASSIGN.finditer(data):
            if len(m[2]) >= LEAST["assign"]:
                spans.append((m.start(), 0, m.end()))
                values.append(("assign", m[2].decode()))
    found = runs(data)
    # Matches of the other kinds are long enough to lie in such a run.
    for begin, end in found:
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            for m in pattern.finditer(data, begin, end):
                if len(m[0]) >= LEAST[KINDS[kind]]:
                    spans.append((m.start(), kind, m.end()))
                    values.append((KINDS[kind], m[0].decode()))
    spans.sort()
    return spans, values, [(b, data[b:e].decode()) for b, e in found]


def written(spans: list[Span]) -> str:
    names = (*KINDS, FORMAT)
    return ",".join(f"{names[kind]}:{begin}:{end}" for begin, kind, end in spans)


def joined(base: list[Span]) -> list[tuple[int, int]]:
    """The places that base spans cover, apart and in order."""
    found: list[tuple[int, int]] = []
    for begin, _, end in base:
        if found and begin <= found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((begin, end))
    return found


def background(text: str | None, base: list[Span]) -> np.ndarray:
    """Each candidate character, or end of a run, behind two others, outside of base spans, as one number.

    The place 0 is the outside of a run; what lies before it does not count.
    """
    data = np.frombuffer((text or "").encode("ascii", "replace"), np.uint8)
    places = np.zeros(len(data) + 3, np.int32)
    places[2:-1] = _PLACE[data]
    for begin, end in joined(base):
        places[begin + 2 : end + 2] = 0
    before, last, now = places[:-2], places[1:-1], places[2:]
    triples = (np.where(last > 0, before, 0) * _PLACES + last) * _PLACES + now
    return triples[triples > 0]


def _label_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["kinds", "credentials", "n"]
    triples, n_runs = np.zeros(_PLACES**3, np.int64), 0
    for batch in batches:
        values, seen = [], []
        for text in batch["text"]:
            base, labelled, found = scan(text)
            values += [(kind, value, 1) for kind, value in labelled]
            seen.append(background(text, base))
            n_runs += len(found)
        if seen:
            triples += np.bincount(np.concatenate(seen), minlength=_PLACES**3)
        yield pd.DataFrame(values, columns=names).astype({"kinds": object, "credentials": object, "n": np.int64})
    counted = [(TRIPLE, str(k), int(triples[k])) for k in np.flatnonzero(triples)] + [(RUN, "", n_runs)]
    yield pd.DataFrame(counted, columns=names)


def learn(found: DataFrame) -> tuple[list[Format], Chain]:
    """A format for each kind, from at most ``LEARN`` distinct credentials, and the background of all texts."""
    labelled = found.where(~F.col("kinds").isin(TRIPLE, RUN))
    number = {r.kinds: r.n for r in found.groupBy("kinds").agg(F.sum("n").alias("n")).collect()}
    triples = np.zeros(_PLACES**3, np.int64)
    counted = found.where(F.col("kinds") == TRIPLE).groupBy("credentials").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # at most a row for three candidate characters
        triples[int(row.credentials)] = row.n
    formats = []
    for kind in KINDS:
        distinct = labelled.where(F.col("kinds") == kind).select("credentials").distinct()
        examples = [r.credentials for r in distinct.orderBy(F.xxhash64("credentials"), "credentials").limit(LEARN).collect()]
        if examples:
            automaton = Automaton(examples)
            known = sorted(automaton.likelihood(x) for x in examples)
            formats.append((automaton, known[int(LEAST_LIKELY * len(known))], math.log2(max(1, number[RUN]) / number[kind])))
    return formats, Chain(CANDIDATE, triples)


def parts(start: int, run: str, covered: list[tuple[int, int]], formats: list[Format], chain: Chain) -> list[Span]:
    """The spans of a learned format in a run, none of which touches ``covered``, the joined base spans."""
    if len(run) < min((automaton.shortest for automaton, *_ in formats), default=len(run) + 1):
        return []
    cuts = [i for i, c in enumerate(run) if c in SEPARATORS]
    begins, ends = [0, *(i + 1 for i in cuts)], [*cuts, len(run)]
    first = bisect_right(covered, start, key=lambda c: c[1])
    added, done = [], 0
    for begin in begins:
        while first < len(covered) and covered[first][1] <= start + begin:
            first += 1
        limit = min(len(run), covered[first][0] - start) if first < len(covered) else len(run)
        if begin < done or limit <= begin:
            continue
        fitting = 0
        for automaton, least, margin in formats:
            low = bisect_left(ends, begin + automaton.shortest)
            high = bisect_right(ends, min(limit, begin + automaton.longest))
            if low < high:
                near = automaton.prefix_likelihoods(run[begin : ends[high - 1]])
                for end in ends[low:high]:
                    length = end - begin
                    if length < len(near) and near[length] >= least and end > fitting:
                        # A span must be likelier by the automaton than by the background.
                        if near[length] * (length + 1) - chain.likelihood(run, begin, end) > margin:
                            fitting = end
        if fitting:
            added.append((start + begin, len(KINDS), start + fitting))
            done = fitting
    return added


def _score_batches(formats: list[Format], chain: Chain):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, text in zip(batch["id"], batch["text"], strict=True):
                base, _, found = scan(text)
                covered = joined(base)
                added = [span for start, run in found for span in parts(start, run, covered, formats, chain)]
                number = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                rows.append((ident, *number, hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + added)), len(added)))
            frame = pd.DataFrame(rows, columns=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])
            frame["id"] = frame["id"].astype(batch["id"].dtype)
            yield frame

    return score


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: identifier, counts of each base kind, ``base_sha256``, ``spans``, ``n_format``."""
    kind = df.schema[id_col].dataType.simpleString()
    # Identifiers pass through Python as text: a column of numbers with a null would turn into floats there.
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = staged(docs.select("text").mapInPandas(_label_batches, "kinds string, credentials string, n long"), "secret-labels")
    schema = "id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"
    scored = docs.mapInPandas(_score_batches(*learn(found)), schema)
    return scored.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
