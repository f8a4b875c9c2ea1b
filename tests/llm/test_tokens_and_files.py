"""Token files, packing, WARC archives: round trips against the plain library."""

import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from lurelog.llm import huffman, packing, packing_plan, token_file, tokens, warc
from lurelog.staging import new_path
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from tokenizers import Tokenizer


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def plain(name):
    tok = Tokenizer.from_file(path(name))
    tok.encode_special_tokens = True
    return lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("name,words_only", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_join_to_the_library_ids(name, words_only, awkward, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "TOGETHER", 400)
    encoder = tokens.Encoder(path(name), words_only)
    rng = random.Random(5)
    alphabet = [" ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "　", "'s", "'", "'re", "a", "Zo", "é", "é", "̈", "ñ", "12", "½",
                "漢字", "\U0001f600", "!", "--", "_", "<|endoftext|>", "İ", "ß", "Σ", "\x0b", "\x1c", "\x85", "​", "ﬁ", "가", "`", "K"]
    texts = [t or "" for _, t, *_ in awkward] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert list(encoder.encode(texts)) == encoder.whole(texts)


@pytest.mark.parametrize("size,limit", [(1, 4), (2, 4), (5, 3), (200, 8), (200, 16), (3000, 16)])
def test_huffman_round_trip(size, limit):
    rng = np.random.default_rng(size)
    counts = rng.zipf(1.4, size) % 10_000 + 1
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (size == 1 or np.sum(2.0 ** -lengths.astype(float)) == 1.0)
    codes = huffman.canonical_codes(lengths)
    for n in (0, 1, 3, 256, 257, 5000):
        symbols = rng.choice(size, n, p=counts / counts.sum())
        stream, bits, points = huffman.encode(symbols, lengths, codes)
        assert bits == lengths[symbols].sum() and len(stream) == -(-bits // 8)
        assert (huffman.Decoder(lengths).decode(stream, n, points) == symbols).all()


def test_huffman_limits():
    assert not huffman.code_lengths(np.zeros(5, int)).any()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


def test_token_file(spark, awkward, docs, empty, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK", 500)
    where = new_path(spark, "tokens")
    token_file.write_tokens(docs, where, path("byte_bpe_50k.json"), 50257)
    found = token_file.read_tokens(spark, where).collect()
    encode = plain("byte_bpe_50k.json")
    assert len(found) == len(awkward)
    wanted = sorted((i is None, i or 0, encode(t).tobytes()) for i, t, *_ in awkward)
    got = sorted((r.id is None, r.id or 0, bytes(r.ids)) for r in found)
    assert got == wanted
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    ids = [(r.id is None, r.id or 0) for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids)
    nothing = new_path(spark, "tokens")
    token_file.write_tokens(empty, nothing, path("byte_bpe_50k.json"), 50257)
    assert token_file.read_tokens(spark, nothing).count() == 0


def test_packing(awkward, docs, empty):
    found = packing.pack(docs, path("word_bpe_49k.json"), capacity=64, with_ids=True).collect()
    encode = plain("word_bpe_49k.json")
    pieces = [(i, k, at, part) for i, t, *_ in awkward for ids in [encode(t)] for k, at in enumerate(range(0, len(ids), 64)) for part in [ids[at : at + 64]]]
    wanted = sorted(repr((i, k, at, len(p), zlib.crc32(p.tobytes()), p.tobytes())) for i, k, at, p in pieces)
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids))) for r in found) == wanted
    placed = defaultdict(list)
    for r in found:
        placed[r.sequence_id].append((r.offset, r.length))
    for content in placed.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 64
    assert len(placed) <= 1.03 * sum(len(p) for *_, p in pieces) / 64 + 1
    assert packing.pack(empty, path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(0.02 + 0.02 * seed, 3000), 100)
    counts = np.bincount(lengths, minlength=101)
    plan = packing_plan.plan(counts, 100)
    made = np.zeros(101, int)
    for configuration, n in plan:
        assert n > 0 and sum(size * k for size, k in configuration) <= 100
        for size, k in configuration:
            made[size] += k * n
    assert (made == counts).all()
    least = max(-(-lengths.sum() // 100), (lengths > 50).sum())
    assert sum(n for _, n in plan) <= 1.02 * least + 1
    assert packing_plan.plan(np.zeros(101, int), 100) == []


def test_knapsack_against_enumeration():
    price = np.full(12, -np.inf)
    price[[1, 2, 4, 5]] = 1.0, 2.5, 5.2, 4.0
    copies, value = packing_plan.dearest(price, 11)
    best = max(a + 2.5 * b + 5.2 * c + 4 * d for a in range(12) for b in range(6) for c in range(3) for d in range(3) if a + 2 * b + 4 * c + 5 * d <= 11)
    assert abs(value - best) < 1e-9 and sum(price[k] * n for k, n in copies.items()) == pytest.approx(best)


PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (5, "http://a/5", ""), (4, "http://a/4", "é漢" * 9000),
    (0, "http://a/0\r\nX: y", "<p>\r\n\r\nodd</p>"), (None, "http://a/n", "<p>nameless</p>"), (7, "http://a/7", "<p>one</p>"), (7, "http://a/7", "<p>one</p>"),
]


def archive(spark, pages=PAGES):
    warc.register(spark)
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    where = new_path(spark, "warc")
    warc.capture_records(frame).write.format("warc").mode("append").save(where)
    return where


def test_warc_round_trip(spark, docs):
    where = archive(spark)
    read = spark.read.format("warc").load(where).collect()
    assert len(read) == len(PAGES)
    responses = {bytes(r.payload).decode() for r in read if r.record_type == "response"}
    assert responses == {h or "" for _, _, h in PAGES}
    found = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.captured(spark, where).collect()}
    firsts = {}
    for i, _, h in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        firsts.setdefault(h or "", i)
    wanted = set()
    for i, _, h in PAGES:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = firsts[h or ""]
        wanted.add((i, len(data), digest, "response" if first == i else "revisit", None if first == i else first))
    assert found == wanted
    assert warc.captured(spark, archive(spark, PAGES[:0])).count() == 0


def test_warc_pushes_predicates_down(spark):
    where = archive(spark)
    reader = warc.WarcReader({"path": where, "payload": "false"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("payload_digest",), ("x",)), GreaterThan(("payload_bytes",), 3)]))
    assert [type(f) for f in left] == [GreaterThan] and reader.wanted == {"record_type": {"revisit"}, "payload_digest": {"x"}}
    rows = spark.read.format("warc").option("payload", "false").load(where).where("record_type = 'revisit'")
    assert {r.payload for r in rows.collect()} == {None} and rows.count() == 4
    assert rows.where("target_uri = 'http://a/2'").select("refers_to").collect() == [("urn:page:1",)]
    assert reader.partitions()


def test_warc_members_of_other_writers():
    text = warc.record(dict(record_type="response", record_id="urn:x:1", target_uri="u", payload=b"p" * 10_000, payload_bytes=10_000, payload_digest="D"), "d")
    stream = io.BytesIO(gzip.compress(text) + warc.member(text) + gzip.compress(text))
    found = list(warc.members(stream))
    assert [gzip.decompress(m) for m in found] == [text] * 3
    row = warc.WarcReader({"path": "/x"}).row(found[0])
    assert row["payload"] == b"p" * 10_000 and row["payload_bytes"] == 10_000 and row["record_id"] == "urn:x:1"
