"""Language identification with a bidirectional gated recurrent network over bytes.

Two recurrent layers read the UTF-8 bytes of a text, one from each side, and a
linear layer labels every position.  A document's probabilities are the mean
over all its positions.  Texts are read in segments of fixed length, whole
texts included; a segment is one column of a matrix, so each step of the
recurrence works on thousands of segments.

The network is trained in numpy by backpropagation through time, on segments
drawn from labelled documents.  The draw is bounded by ``TRAIN_SEGMENTS``; the
documents whose ``crc32(doc_id)`` leaves 2 when divided by 4 are never drawn.

Defined cases
    null text, or no letter   ``und`` with score 0
    no labelled document      every row is ``und`` with score 0
    null identifier           predicted like any other, not held out, never trained on
    very long texts           all segments are read, in blocks
    repeated rows, ties       equal texts get equal results; equal probabilities go to the first label
    empty table               empty result
    clashing columns          columns of the input named like an output column are replaced
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most training segments, shared equally between the labels.
TRAIN_SEGMENTS = 24_000
#: Segments offered by one document for the draw.
SEGMENTS_OF_DOCUMENT = 6
SEGMENT = 64
HIDDEN = 8
BATCH = 512
STEPS = 360
RATE = 0.02
SEED = 7
#: Segments in a block at prediction, and bytes in each.
COLUMNS = 2048
READ_SEGMENT = 96
#: How far from an even guess to certainty a score must lie to tell a language from chance.
CERTAIN = 0.1
UNKNOWN = "und"
OUTPUT = ["held_out", "lang_pred", "score"]
_LETTER = re.compile(r"[^\W\d_]")
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def has_letter(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text))


class Direction:
    """One gated recurrent layer; the weights of reset gate, update gate and candidate are stacked."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.inputs = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.inner = (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)

    @property
    def hidden(self) -> int:
        return self.inner.shape[1]

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state, gates, candidate and the candidate's share of the inner product."""
        h = self.hidden
        x = np.ascontiguousarray(self.inputs[codes].T)
        a = self.inner @ state
        gates = x[: 2 * h]
        gates += a[: 2 * h]
        gates *= np.float32(0.5)
        np.tanh(gates, out=gates)
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        candidate = a[2 * h :] * gates[:h]
        candidate += x[2 * h :]
        np.tanh(candidate, out=candidate)
        fresh = state - candidate
        fresh *= gates[h:]
        fresh += candidate
        return fresh, gates, candidate, a[2 * h :]

    def run(self, codes: np.ndarray, real: np.ndarray, order: range) -> Iterator[tuple]:
        """States along ``order``; positions without a byte reset the state to zero."""
        state = np.zeros((self.hidden, codes.shape[1]), np.float32)
        for t in order:
            before = state
            state, gates, candidate, inner = self.step(before, codes[t])
            state = state * real[t]
            yield t, before, state, gates, candidate, inner

    def back(self, trace: list[tuple], from_output: dict[int, np.ndarray], codes: np.ndarray, real: np.ndarray) -> tuple:
        """Gradients of both weight tables by backpropagation through time."""
        h = self.hidden
        inner_grad = np.zeros_like(self.inner)
        later = np.zeros_like(trace[0][1])
        gathered, which = [], []
        for t, before, _, gates, candidate, inner in reversed(trace):
            at = (later + from_output[t]) * real[t]
            reset, update = gates[:h], gates[h:]
            d_candidate = at * (1 - update) * (1 - candidate * candidate)
            d_update = at * (before - candidate) * update * (1 - update)
            d_reset = d_candidate * inner * reset * (1 - reset)
            d_inner = np.concatenate([d_reset, d_update, d_candidate * reset])
            inner_grad += d_inner @ before.T
            later = at * update + self.inner.T @ d_inner
            gathered.append(np.concatenate([d_reset, d_update, d_candidate]).T)
            which.append(codes[t])
        flat, code = np.concatenate(gathered), np.concatenate(which)
        order = np.argsort(code, kind="stable")
        begins = np.flatnonzero(np.r_[True, np.diff(code[order].astype(np.int16)) != 0])
        input_grad = np.zeros_like(self.inputs)
        input_grad[code[order][begins]] = np.add.reduceat(flat[order], begins, axis=0)
        return input_grad, inner_grad


class Network:
    """Both directions and the labelling layer."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.behind = Direction(rng, hidden), Direction(rng, hidden)
        self.out = (rng.standard_normal((len(labels), 2 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.bias = np.zeros((len(labels), 1), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.inputs, self.ahead.inner, self.behind.inputs, self.behind.inner, self.out, self.bias]

    def gradients(self, codes: np.ndarray, real: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over all positions; ``target`` is one-hot, a column for each segment."""
        length, h = len(codes), self.ahead.hidden
        forward = list(self.ahead.run(codes, real, range(length)))
        backward = list(self.behind.run(codes, real, range(length - 1, -1, -1)))
        states = {s[0]: [s[2]] for s in forward}
        for s in backward:
            states[s[0]].append(s[2])
        out_grad, bias_grad = np.zeros_like(self.out), np.zeros_like(self.bias)
        to_ahead, to_behind = {}, {}
        share = np.float32(1 / max(1, real.sum()))
        for t in range(length):
            both = np.concatenate(states[t])
            error = (softmax(self.out @ both + self.bias) - target) * real[t] * share
            out_grad += error @ both.T
            bias_grad += error.sum(1, keepdims=True)
            down = self.out.T @ error
            to_ahead[t], to_behind[t] = down[:h], down[h:]
        a, b = self.ahead.back(forward, to_ahead, codes, real), self.behind.back(backward, to_behind, codes, real)
        return [*a, *b, out_grad, bias_grad]

    def position_probabilities(self, codes: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Sum over the positions of each segment of the label probabilities, labels by segments."""
        length, h = len(codes), self.ahead.hidden
        first = np.empty((length, len(self.labels), codes.shape[1]), np.float32)
        for t, _, state, *_ in self.ahead.run(codes, real, range(length)):
            np.matmul(self.out[:, :h], state, out=first[t])
        total = np.zeros(first.shape[1:], np.float32)
        for t, _, state, *_ in self.behind.run(codes, real, range(length - 1, -1, -1)):
            total += softmax(first[t] + self.out[:, h:] @ state + self.bias) * real[t]
        return total

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over all positions of each text, documents by labels."""
        parts = np.array([-(-len(t) // READ_SEGMENT) for t in texts])
        begin = np.r_[0, np.cumsum(parts)]
        grid = np.zeros((begin[-1], READ_SEGMENT), np.uint8)
        real = np.zeros(grid.shape, np.float32)
        for k, text in enumerate(texts):
            grid[begin[k] : begin[k + 1]].reshape(-1)[: len(text)] = np.frombuffer(text, np.uint8)
            real[begin[k] : begin[k + 1]].reshape(-1)[: len(text)] = 1
        sums = np.empty((len(grid), len(self.labels)))
        for at in range(0, len(grid), COLUMNS):
            cut = slice(at, at + COLUMNS)
            sums[cut] = self.position_probabilities(np.ascontiguousarray(grid[cut].T), np.ascontiguousarray(real[cut].T)).T
        found = np.zeros((len(texts), len(self.labels)))
        some = parts > 0
        if some.any():
            found[some] = np.add.reduceat(sums, begin[:-1][some], axis=0) / np.array([len(t) for t in texts])[some, None]
        return found


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(0))
    scores /= scores.sum(0)
    return scores


def train(segments: list[bytes], labels: list[str]) -> Network:
    """A network fitted to segments and their labels with Adam steps."""
    names = sorted(set(labels))
    network = Network(names)
    rng = np.random.default_rng(SEED)
    codes = np.zeros((SEGMENT, len(segments)), np.uint8)
    real = np.zeros(codes.shape, np.float32)
    for k, s in enumerate(segments):
        codes[: len(s), k], real[: len(s), k] = np.frombuffer(s, np.uint8), 1
    target = np.equal.outer(np.array(names), np.array(labels)).astype(np.float32)
    mean = [np.zeros_like(w) for w in network.weights()]
    square = [np.zeros_like(w) for w in network.weights()]
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(segments), BATCH)
        grads = network.gradients(codes[:, pick], real[:, pick], target[:, pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - 0.9 * step / STEPS)
        for w, g, m, v in zip(network.weights(), grads, mean, square, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")) % 4 == 2, F.lit(False))


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Up to ``SEGMENTS_OF_DOCUMENT`` segments spread over each whole text, with a draw number."""
    for batch in batches:
        rows = []
        for ident, text, lang in zip(batch["id"], batch["text"], batch["lang"], strict=True):
            data = text.encode("utf-8", "replace")
            rng = np.random.default_rng([SEED, int(ident) & 0xFFFFFFFFFFFFFFFF])
            for _ in range(min(SEGMENTS_OF_DOCUMENT, -(-len(data) // SEGMENT))):
                at = int(rng.integers(0, max(1, len(data) - SEGMENT + 1)))
                rows.append((data[at : at + SEGMENT], lang, float(rng.random())))
        yield pd.DataFrame(rows, columns=["segment", "lang", "draw"])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on a draw of at most ``TRAIN_SEGMENTS`` segments of the labelled documents that are not held out."""
    known = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("id"))
    )
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    wanted = TRAIN_SEGMENTS // (SEGMENTS_OF_DOCUMENT * len(counts))
    share = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, wanted / n)) for k, n in counts.items()])
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30) < share)
    rows = drawn.mapInPandas(_segments, "segment binary, lang string, draw double").toPandas()
    rows = rows.sort_values(["draw", "segment"]).head(TRAIN_SEGMENTS)
    return train([bytes(s) for s in rows["segment"]], rows["lang"].tolist()) if len(rows) else None


def predictor(network: Network | None):
    """A vectorised function from texts to ``lang_pred`` and ``score``."""

    @F.pandas_udf(RESULT)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            label = np.full(len(batch), UNKNOWN, object)
            score = np.zeros(len(batch))
            good = [k for k, t in enumerate(batch) if network is not None and has_letter(t)]
            if good:
                shares = network.document_probabilities([batch.iloc[k].encode("utf-8", "replace") for k in good])
                best = shares.argmax(1)
                label[good] = np.array(network.labels, object)[best]
                score[good] = np.clip(shares[np.arange(len(good)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": label, "score": score})

    return predict


def certain(n_labels: int) -> float:
    """The least score of a language that is told from chance: ``CERTAIN`` of the way from an even guess to certainty."""
    even = 1 / max(1, n_labels)
    return even + CERTAIN * (1 - even)


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", network: Network | None = None
) -> DataFrame:
    """``df`` with ``held_out``, ``lang_pred`` and ``score``, by ``network`` or one fitted to ``df``."""
    predict = predictor(network or fit(df, id_col, text_col, lang_col))
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in OUTPUT]).alias("row")
    return df.select(kept, held_out(F.col(id_col)).alias("held_out"), predict(text_col).alias("found")).select(
        "row.*", "held_out", "found.lang_pred", "found.score"
    )


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
