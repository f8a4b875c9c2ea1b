"""Repeats, top-k search, language and secrets, against brute force or held-out accuracy."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from lurelog.llm import langid, repeats, secrets, suffix_sort, topk
from lurelog.llm.automata import IMPOSSIBLE, Automaton


def test_suffix_array():
    rng = np.random.default_rng(1)
    for size, letters in ((1, 1), (60, 2), (300, 3), (400, 1), (900, 5)):
        text = np.r_[rng.integers(1, letters + 1, size), 0].astype(np.uint8)
        if size > 50:
            text[size // 2] = 0
        data = bytes(text)
        for depth in (8, 24, 200):
            order = suffix_sort.suffix_array(text, depth)
            assert sorted(order.tolist()) == list(range(size + 1))
            keys = [(data[i:] + bytes(depth))[:depth] for i in order]
            assert keys == sorted(keys)
        starts = np.arange(len(text)) <= len(text) - 13
        seen = Counter(data[i : i + 13] for i in np.flatnonzero(starts))
        found = suffix_sort.repeated(text, starts, 13)
        assert [bool(found[i]) for i in np.flatnonzero(starts)] == [seen[data[i : i + 13]] > 1 for i in np.flatnonzero(starts)]


@pytest.mark.parametrize("wide,length", [(repeats.WIDE, 200), (1, 200), (repeats.WIDE, 70)])
def test_repeats(awkward, docs, empty, monkeypatch, wide, length):
    monkeypatch.setattr(repeats, "WIDE", wide)
    if length != repeats.LENGTH:
        monkeypatch.setattr(repeats, "PIECE", 900)
    data = [(i, (t or "").encode()) for i, t, *_ in awkward]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    wanted = []
    for i, b in data:
        cover = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cover[k : k + length] = True
        edge = np.flatnonzero(np.diff(np.r_[0, cover.astype(np.int8)]))
        kept = bytes(np.frombuffer(b, np.uint8)[~cover[:-1]]) if b else b""
        wanted.append(repr((i, len(b), list(map(list, zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))), kept)))
    found = [repr((r.doc_id, r.n_bytes, [list(s) for s in r.spans], bytes(r.kept))) for r in repeats.remove_repeats(docs, length=length).collect()]
    assert sorted(found) == sorted(wanted)
    if wide == 1:
        assert repeats.remove_repeats(empty).count() == 0


def test_top_k(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(0, 300)]
    same = [0.5, -0.25, 0.125, 0.0, 1.0, 2.0]
    vectors += [(1000 + i, same) for i in range(60)]
    vectors += [(400, None), (450, [1.0, None]), (451, [float("nan")] * 6), (452, [float("inf")] * 6), (500, []), (501, [3.0, 4.0]), (None, same), (550, same), (550, same)]
    rng.shuffle(vectors)
    usable = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumnRenamed("nothing", "x")
    wanted = []
    for i, q in usable:
        if i is not None and i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), (1 << 63) if j is None else j) for j, v in usable if j != i)[:5]  # noqa: B905
            wanted += [(i, k + 1, None if j == 1 << 63 else j, -s) for k, (s, j) in enumerate(scored)]
    found = [tuple(r) for r in topk.top_k(frame).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))
    assert topk.top_k(frame.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    with pytest.raises(Exception, match="too long"):
        topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [1e20])], "vec_id long, embedding array<float>")).collect()


def test_top_k_of_a_query_row_repeated_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 4)
    rows = [(50, [1.0, 2.0])] * 19 + [(i, [float(i), 1.0]) for i in range(1, 8)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    wanted = [(50, k + 1, 7 - k, 65536 * (7 - k + 2)) for k in range(5)]
    assert sorted(map(tuple, found)) == sorted(wanted * 19)


def test_top_k_bounds_hold():
    rng = np.random.default_rng(3)
    cells = rng.integers(-300, 300, (400, 8))
    block = topk.Lists(np.arange(400).tobytes(), cells.tobytes(), np.argsort(cells, axis=0, kind="stable").astype(np.int32).tobytes(), 8)
    q = rng.integers(-300, 300, 8).astype(float)
    scores = cells @ q
    for depth in (1, 20, 399, 400):
        low, high, far_low, far_high = block.read(depth)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        assert (high @ up + low @ down >= scores).all() and (far_high @ up + far_low @ down <= scores).all()


def test_language_gradients():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b", "c"], hidden=3)
    for d in (net.ahead, net.behind):
        d.inputs, d.inner = d.inputs.astype(float), d.inner.astype(float)
    codes, real = rng.integers(0, 256, (7, 4)).astype(np.uint8), np.ones((7, 4))
    real[5:, 1] = 0
    target = np.eye(3)[:, [0, 1, 2, 0]]

    def loss():
        a = {s[0]: s[2] for s in net.ahead.run(codes, real, range(7))}
        b = {s[0]: s[2] for s in net.behind.run(codes, real, range(6, -1, -1))}
        return sum(float((-(target * np.log(langid.softmax(net.out @ np.concatenate([a[t], b[t]]) + net.bias))) * real[t]).sum()) for t in range(7)) / real.sum()

    for w, g in zip(net.weights(), net.gradients(codes, real, target), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        held = w[at]
        w[at] = held + 1e-3
        high = loss()
        w[at] = held - 1e-3
        low = loss()
        w[at] = held
        assert (high - low) / 2e-3 == pytest.approx(g[at], rel=1e-3)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs)
    judged = found.where("held_out AND lang IS NOT NULL").select("lang", "lang_pred", "score").toPandas()
    assert len(judged) > 150 and (judged.lang == judged.lang_pred).mean() >= 0.97 and judged.score.between(0, 1).all()


def test_language_of_awkward_texts(awkward, docs, empty):
    found = langid.identify(docs).collect()
    assert len(found) == len(awkward)
    for r in found:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    unlabelled = langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("text = 'a'"))
    assert unlabelled.count() == 1
    assert langid.identify(empty).count() == 0


BASE = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 16), ("hex", re.compile(r"[0-9a-f]+"), 32),
]


def plain_spans(text):
    found = []
    for n, (kind, pattern, least) in enumerate(BASE):
        found += [(m.start(), n, kind, m.end()) for m in pattern.finditer(text or "") if len(m[2] if n == 0 else m[0]) >= least]
    return sorted(found)


def test_secrets(awkward, docs, empty):
    texts = defaultdict(list)
    for i, t, *_ in awkward:
        texts[i].append(t)
    found = secrets.find_secrets(docs).collect()
    assert len(found) == len(awkward)
    digests = Counter()
    for r in found:
        digests[r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex] += 1
        assert r.n_format == len([s for s in r.spans.split(",") if s.startswith("format")])
    wanted = Counter()
    for i, t, *_ in awkward:
        spans = plain_spans(t)
        line = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        wanted[i, hashlib.sha256(line.encode()).hexdigest(), *[sum(s[1] == n for s in spans) for n in range(3)]] += 1
    assert digests == wanted and sum(n * (k[2] + k[3] + k[4]) for k, n in wanted.items()) >= 4
    assert secrets.find_secrets(empty).count() == 0


@pytest.mark.parametrize("text", ["é token=abcdefgh1 \U0001f600 AKIA" + "A" * 13, "Token = 'x' api_key:12345678", "K secret=" + "f" * 40, "toKen=secret:abcdefghij"])
def test_offsets_are_code_points(text):
    spans, _, _ = secrets.scan(text)
    assert [(a, k, b) for a, k, b in spans] == [(a, n, b) for a, n, _, b in plain_spans(text)]


def test_automata_learn_lengths_and_symbols():
    rng = random.Random(6)
    keys = ["sk-" + "".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(200)]
    automaton = Automaton(keys)
    assert automaton.prefix == "sk-" and automaton.states() <= 25
    fresh = "sk-" + "0f" * 10
    assert automaton.likelihood(fresh) == pytest.approx(max(map(automaton.likelihood, keys)))
    for other in ("sk-" + "0f" * 9, "sk-" + "0z" * 10, "xk-" + "0f" * 10, ""):
        assert automaton.likelihood(other) == IMPOSSIBLE
    mixed = Automaton(["ab-1"] * 50 + ["ab-12"] * 50)
    assert mixed.likelihood("ab-1") > IMPOSSIBLE


def test_a_stray_credential_becomes_a_format_span(spark):
    rng = random.Random(8)
    value = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(24))
    rows = [(i, f"words here password={value()} more words") for i in range(300)] + [(900, f"left alone {value()} here"), (901, "nothing but quiteordinarylongwords 4041894974608795")]
    found = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[900].spans == "format:11:35" and found[900].n_format == 1 and found[901].spans == ""


def test_short_formats_and_parts_of_runs(spark):
    rng = random.Random(7)
    value = lambda: "".join(rng.choice("0123456789") for _ in range(10))
    rows = [(i, f"say token={value()} here") for i in range(100)]
    texts = [f"bare {value()}", f"auth_key={value()}", f"pwd={value()}.", f"at /v1/{value()}/x", f"a=123456789 {value()}1"]
    rows += [(900 + i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[900 + i] for i in range(5)] == ["format:5:15", "format:9:19", "format:4:14", "format:7:17", ""]


def test_classes_of_characters_and_lengths_bound_a_format():
    rng = random.Random(11)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    small, large, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    shaped = Automaton([pick(large, 3) + pick(digits, 6) + pick(small, 3) for _ in range(300)])
    assert shaped.likelihood("ABC123456xyz") > IMPOSSIBLE
    for other in ("abc123456xyz", "ABCdefghixyz", "ABC12345xyz", "ABC1234567xyz"):
        assert shaped.likelihood(other) == IMPOSSIBLE
    mixed = Automaton([pick(small + large + digits, rng.randint(16, 90)) for _ in range(600)])
    assert mixed.states() > 60 and mixed.likelihood("aB3" * 40) == IMPOSSIBLE


def planted(rng, n):
    """Documents of prose with passwords that are words, labelled keys, and keys that no base pattern covers."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    with open(langid.__file__) as own:
        prose = re.findall("[a-z]{4,}", own.read())
    syllables = ["ad", "min", "is", "tra", "tive", "com", "mit", "tee", "pro", "po", "sal", "de", "vel", "op", "ment", "yes", "ter", "day"]
    word = lambda: rng.choice(prose) if rng.random() < 0.4 else "".join(rng.choice(syllables) for _ in range(rng.randint(2, 6)))
    key = lambda: "live-" + "".join(rng.choice(letters) for _ in range(24))
    block = lambda: "-".join("".join(rng.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12))
    rows, wanted = [], {}
    for i in range(n):
        text = " ".join(word() for _ in range(80))
        kind = i % 6
        if kind == 0:
            text += f" password: {''.join(rng.choice(syllables) for _ in range(4))} "
        elif kind in (1, 2):
            text += f" api_key={(key, block)[kind - 1]()} "
        elif kind in (3, 4):
            value = (key, block)[kind - 3]()
            wanted[i] = f"format:{len(text) + 1}:{len(text) + 1 + len(value)}"
            text += f" {value} and {word()}"
        rows.append((i, text))
    return rows, wanted


def test_planted_credentials_and_plain_words(spark):
    rows, wanted = planted(random.Random(12), 1500)
    found = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {(i, s) for i, r in found.items() for s in r.spans.split(",") if s.startswith("format")}
    right = spans & set(wanted.items())
    assert len(right) >= 0.9 * len(wanted) and len(right) >= 0.9 * len(spans)


def chain_of(triples):
    size = (len(secrets.CANDIDATE) + 1) ** 3
    return secrets.Chain(secrets.CANDIDATE, np.bincount(np.concatenate(triples), minlength=size))


def test_words_as_passwords_mark_no_words():
    rng = random.Random(13)
    rows, _ = planted(rng, 900)
    texts = [t for i, t in rows if i % 6 in (0, 5)]
    triples, values, n_runs = [], [], 0
    for text in texts:
        base, labelled, runs = secrets.scan(text)
        triples.append(secrets.background(text, base))
        values += [v for _, v in labelled]
        n_runs += len(runs)
    automaton = Automaton(values)
    least = sorted(map(automaton.likelihood, values))[len(values) // 50]
    formats, chain = [(automaton, least, float(np.log2(n_runs / len(values))))], chain_of(triples)
    assert len(values) > 100 and min(map(len, values)) >= 8
    for text in texts:
        base, _, runs = secrets.scan(text)
        assert not [s for at, run in runs for s in secrets.parts(at, run, secrets.joined(base), formats, chain)]


def test_a_long_run_is_scanned_in_linear_time():
    rng = random.Random(14)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    automaton = Automaton(["".join(rng.choices(letters, k=rng.randint(16, 90))) for _ in range(600)])
    run = "".join(rng.choices(letters, k=1 << 20))
    chain = chain_of([secrets.background(run, [])])
    begin = time.process_time()
    secrets.parts(0, run, [], [(automaton, IMPOSSIBLE, 1e9)], chain)
    assert time.process_time() - begin < 6  # about two seconds on a free machine


def test_background_likelihood_leaves_out_one_occurrence():
    size, trust = len(secrets.CANDIDATE) + 1, secrets.Chain.TRUST
    chain = chain_of([secrets.background(t, []) for t in ["abab abc", "abab cab"]])
    place = {chr(c): k + 1 for k, c in enumerate(secrets.CANDIDATE)}
    seen = [tuple(place.get(c, 0) for c in t) for t in ["  a", " ab", "aba", "bab", "ab ", "  a", " ab", "abc", "bc "]]
    seen += [tuple(place.get(c, 0) for c in t) for t in ["  a", " ab", "aba", "bab", "ab ", "  c", " ca", "cab", "ab "]]
    expected = 0.0
    for now in [tuple(place.get(c, 0) for c in t) for t in ["aba", "bab", "ab "]]:
        share = 1 / size
        for known in (0, 1, 2):
            begin = now[2 - known : 2]
            whole = [t for t in seen if t[2 - known : 2] == begin]
            share = (max(whole.count(now) if known == 2 else sum(t[2] == now[2] for t in whole), 1) - 1 + trust * share) / (
                max(len(whole), 1) - 1 + trust
            )
        expected += np.log2(share)
    assert abs(chain.likelihood("abab", 2, 4) - expected) < 1e-9
