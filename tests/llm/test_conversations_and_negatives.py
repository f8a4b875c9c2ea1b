"""Chat formatting, conversation repair and hard negatives, against plain code."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from lurelog.llm import chat, negatives, registry, repair
from lurelog.llm import turn_search as ts
from lurelog.staging import new_path
from pyspark.sql import functions as F

CLASHES = ["named", "ident", "position", "row", "digest", "piece", "symbol", "fault", "edit", "audit", "example", "chunk", "formatted", "label2", "id", "cells", "number"]
CHAT = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward_turns():
    rng = random.Random(11)
    texts = ["Hello there.", "hello", "", None, " \t\n", "<|im_end|>", "<\\|im_start|>x", "<|im_start|>assistant ok", "<", "|", "\\", "é漢\U0001f600!", "What?", "fine. \n", "z" * 70000 + ".", "end. "]
    roles = ["user", "assistant", "system", None, "", "User", "unknown", "tool", "a%0A\n<|x|>%25"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), role, rng.choice(texts[:6] + texts[11:13]) if rng.random() < 0.7 else rng.choice(texts)))
    rows += [(200, 0, "user", "same.")] * 30 + [(None, k, "user" if k % 2 == 0 else "assistant", f"nameless {k}.") for k in range(25)]
    rows += [(300, 0, "assistant", None), (301, None, None, None), (-5, 1 << 60, "user", "big ids."), ((1 << 53) + 1, 2, "assistant", "odd id.")]
    rng.shuffle(rows)
    return rows


def in_order(rows, blank):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = blank if role is None else role, blank if text is None else text
        found[conv].append((turn is not None, turn or 0, role, sha(text), turn, text))
    return {conv: [(turn, role, text) for _, _, role, _, turn, text in sorted(turns)] for conv, turns in found.items()}


@pytest.fixture(scope="module")
def talks(spark):
    registry.prepared(spark)
    frame = spark.createDataFrame(awkward_turns(), CHAT).repartition(5)
    for name in CLASHES:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def written(text):
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def test_chat_round_trip(spark, talks, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 3)
    path = new_path(spark, "chat-test")
    chat.write_chat(talks, path)
    wanted, examples = {}, []
    for conv, turns in in_order(awkward_turns(), "").items():
        prefix, made, after = "", 0, 0
        replies = [text for _, role, text in turns if role == "assistant"]
        for _, role, text in turns:
            head = f"<|im_start|>{written(role.replace('%', '%25').replace(chr(10), '%0A'))}\n"
            prefix += f"{head}{written(text)}<|im_end|>\n"
            after += len(head) + len(written(text)) + 11
            if role == "assistant":
                end = len(prefix) - 11
                examples.append((conv, prefix, end - len(written(text)), end))
                made, after = made + len(prefix), 0
        loss = "".join(replies)
        wanted[conv] = (len(turns), sha("".join(f"{role}\n{text}\n" for _, role, text in turns)), len(loss), sha(loss), made + after, len(replies))
    found = {r.conv_id: tuple(r)[1:] for r in chat.read_conversations(spark, path).collect()}
    assert found == wanted
    read = [(r.conv_id, r.text, r.loss_start, r.loss_end) for r in chat.read_examples(spark, path).collect()]
    assert sorted(map(repr, read)) == sorted(map(repr, examples))
    # No text can end its turn or open another.
    assert all(t.count("<|im_start|>") == t.count("<|im_end|>\n") and t.endswith("<|im_end|>\n") for _, t, _, _ in read)


def test_empty_conversations(spark, talks):
    path = new_path(spark, "chat-empty")
    chat.write_chat(talks.limit(0), path)
    assert chat.read_conversations(spark, path).count() == chat.read_examples(spark, path).count() == 0
    assert repair.report(repair.repair(talks.limit(0))).count() == 0


def test_a_conversation_of_many_rows_is_numbered_in_ranges(spark):
    registry.prepared(spark)
    hot = spark.range(6000).selectExpr("if(id % 3 < 2, 7, id) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id, '.') AS text")
    path = new_path(spark, "chat-hot")
    chat.write_chat(hot, path)
    row = chat.read_conversations(spark, path).where("conv_id = 7").first()
    turns = [k for k in range(6000) if k % 3 < 2 or k == 7]
    assert (row.n_turns, row.turns_sha256) == (len(turns), sha("".join(f"{('user', 'assistant')[k % 2]}\nt{k}.\n" for k in turns)))


GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(turns):
    """Faults of the turns and the cheapest repair: uniform-cost search over (turns taken, initials given)."""
    faults, seen = [], set()
    for _, role, text in turns:
        said = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, given, kept = heapq.heappop(heap)
        if at == len(turns) and GRAMMAR.fullmatch(given):
            return faults, cost, audit, "\n".join(kept)
        if (at, given) in done or not re.fullmatch("s?(ua)*u?", given) or len(given) > len(turns) + 3:
            continue
        done.add((at, given))
        if at < len(turns):
            _, role, text = turns[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, given, kept))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 if faults[at] else 0
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, given + (role[:1] or " "), (*kept, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, given + name[0], (*kept, f"{name}:{text}")))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, given + name[0], (*kept, f"{name}:")))


def plain_report(turns):
    faults, cost, audit, kept = cheapest(turns)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
    return (gaps, *[faults.count(f) for f in repair.FAULTS], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha(kept))


@pytest.mark.parametrize("size", [2, repair.PIECE])
def test_repair(talks, size):
    wanted = {conv: plain_report(turns) for conv, turns in in_order([r for r in awkward_turns() if r[0] != 200], " ").items()}
    found = {r.conv_id: tuple(r)[1:] for r in repair.report(repair.repair(talks, size=size)).collect()}
    copies = found.pop(200)
    assert copies[:6] == (0, 0, 29, 0, 29, 3 + 29 * 4) and copies[6] == "K" + "D" * 29 + "I"
    assert found == wanted


def test_repair_of_damaged_conversations(spark, tmp_path):
    registry.prepared(spark)
    rows = [r for r in awkward_turns() if r[0] != 200] + [(k, 0, "user", "x.") for k in range(1000, 1040)]
    spark.createDataFrame(rows, CHAT).write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        damage = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        hurt += [(conv, turn, "user" if damage == 4 else role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
    turns = in_order(hurt, " ")
    nothing = (0, 0, 0, 0, 0, 0, "", sha(""))
    wanted = {conv: plain_report(turns[conv]) if conv in turns else nothing for conv in {r[0] for r in rows}}
    found = {r.conv_id: tuple(r)[1:] for r in repair.op12_repair(spark, str(tmp_path)).collect()}
    assert nothing in wanted.values() and found == wanted


def test_search_against_uniform_cost():
    rng = random.Random(3)
    role, text = {"s": "s", "u": "u", "a": "a", " ": "x"}, {ts.OK: "k.", ts.DROP: "", ts.CUT: "k"}
    for _ in range(400):
        symbols = [rng.choice(list(ts.MEANING)) for _ in range(rng.randint(0, 7))]
        # Unlike texts, so that nothing counts as said before.
        turns = [(k, role[i], text[f] and f"{k}{text[f]}") for k, (i, f) in enumerate(ts.MEANING[s] for s in symbols)]
        _, cost, audit, _ = cheapest(turns)
        assert ts.search("".join(symbols), ts.START)[:2] == (cost, audit)
        bounds = ts.suffix_bounds("".join(symbols), ts.END)
        assert bounds[0][ts.START] <= cost


def test_a_long_search_is_short():
    symbols = ts.SYMBOL["u", ts.OK] * 50000
    cost, audit, _ = ts.search(symbols, ts.START)
    assert (cost, audit) == (75000, "KR" * 25000)


def plain_negatives(rows):
    usable = [(i, x, [int(np.floor(256 * np.float64(np.float32(c)))) for c in v]) for i, v, x in rows if x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    found = []
    for i, x, v in usable:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), 1 << 63 if j is None else j, y) for j, y, w in usable if j != i)  # noqa: B905
        for s, j, _ in [c for c in scored if c[2] == x][:5]:
            near = [c for c in scored if c[2] != x and 80 * -s <= 100 * -c[0] <= 100 * -s][:5]
            found += [(i, None if j == 1 << 63 else j, k + 1, None if m == 1 << 63 else m, -s, -t) for k, (t, m, _) in enumerate(near)]
    return sorted(map(repr, found))


@pytest.mark.parametrize("block,anchors", [(negatives.BLOCK, negatives.ANCHORS), (37, 3), (1, 1)])
def test_hard_negatives(spark, block, anchors):
    registry.prepared(spark)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in centres[i % 4]], rng.randint(0, 3)) for i in range(0, 400 if block > 1 else 130)]
    same = [0.5, -0.25, 0.125, 0.0, 1.0]
    rows += [(1000 + 4 * i, same, i % 2) for i in range(60)] + [(1301, same, 1)] * 2
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, same, None), (800, [float("nan")] * 5, 1), (900, [float("inf")] * 5, 1), (1100, [], 2),
             (1200, [3.0, 4.0], 3), (None, same, 1), ((1 << 53) + 1, same, 0), (3000, [-c for c in same], 9)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    for name in ("id", "cells", "block", "number", "place"):
        frame = frame.withColumn(name, F.lit("clash"))
    found = negatives.mine(frame, block=block, anchor_block=anchors)
    assert sorted(map(repr, map(tuple, found.collect()))) == plain_negatives(rows)
    if block == 1:
        assert negatives.mine(frame.limit(0)).count() == 0
        with pytest.raises(Exception, match="beyond 2\\^62"):
            negatives.mine(spark.createDataFrame([(0, [1e30], 1)], "vec_id long, embedding array<float>, label int")).count()


def test_bounds_leave_out_what_is_far():
    rng = np.random.default_rng(4)
    cells = np.r_[rng.normal(0, 20, (64, 8)) + 400, rng.normal(0, 20, (64, 8)) - 400].astype(np.int64)
    order, parents, edges = negatives.spanning_tree(cells[:64].astype(float))
    row = {"ids": np.arange(64).tobytes(), "labels": np.zeros(64, np.int64).tobytes(), "cells": cells[:64].tobytes(), "width": 8,
           "order": order.tobytes(), "parents": parents.tobytes(), "edges": edges.tobytes()}
    anchors = negatives.Block(row)
    others = negatives.Block(row | {"ids": np.arange(128).tobytes(), "labels": np.zeros(128, np.int64).tobytes(), "cells": cells.tobytes()})
    exact, scored = cells[:64] @ cells.T, 0

    def wanted(at, low, high):
        assert (low <= exact[at]).all() and (exact[at] <= high).all()
        return high >= 0

    for at, chosen, scores in negatives.bounded_scores(anchors, others, wanted):
        assert (scores == exact[at, chosen]).all()
        scored += len(chosen)
    assert scored == 64 * 64  # the far half is never scored
