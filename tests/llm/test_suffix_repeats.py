"""Removed strings against a dictionary of all of them, and the index against direct search."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from llm_rows import plain
from logspark.llm import suffix_repeats as S
from logspark.llm.run_index import RunIndex


def brute(rows, width=S.WIDTH):
    first = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1 if doc is not None else 0):
            own = raw[i:i + width]
            first[own] = min(first.get(own, doc), doc)
    out = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1 if doc is not None else 0):
            if first[raw[i:i + width]] < doc:
                gone[i:i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture
def rows(odd_rows):
    rng = random.Random(2)
    vocabulary = ["the", "of", "é", "thisisalongword" * 2] + [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 40))) for _ in range(8)]
    passages += ["a" * 70, "ab" * 60]
    made = []
    for _ in range(200):
        parts = [rng.choice([rng.choice(passages), " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))])
                 for _ in range(rng.randint(0, 5))]
        made.append((rng.randint(0, 180), " ".join(parts)))
    return made + odd_rows + [(300, "x" * 49), (301, "x" * 50), (302, "x" * 51)]


@pytest.mark.parametrize("crowd,shard,batch", [
    (2048, 1 << 20, 1 << 22), (2, 1 << 20, 2000), (20, 500, 5000), (1, 1, 1)])
def test_against_brute_force(docs_of, rows, monkeypatch, crowd, shard, batch):
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S, "SHARD_BYTES", shard)
    got = S.remove_repeats(docs_of(rows), batch).drop("kept")
    assert plain(got.collect()) == brute(rows)


def test_long_text_in_parts(docs_of, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 700)
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(3000)}" for _ in range(1500))
    rows = [(5, text), (6, text[2000:4500]), (7, "z" + text), (8, text[:3000] + "!" + text[3000:])]
    assert plain(S.remove_repeats(docs_of(rows)).drop("kept").collect()) == brute(rows)


def test_parameters_reach_the_workers(docs_of, rows, monkeypatch):
    """One anchor is crowded at 2 fragments and is not at 2,048: other messages, the same result."""
    def flagging(crowd):
        return lambda table: S._flag_anchors(table, crowd)

    sent = []
    for crowd in (2048, 2):
        monkeypatch.setattr(S, "CROWD", crowd)
        docs = S.documents(docs_of(rows))
        packed = S._pack(docs, 1 << 22)
        flags = (packed.mapInArrow(S._send_anchors(4, S.CHUNK), S.MESSAGE_SQL).groupBy("bucket")
                 .applyInArrow(flagging(crowd), S.MESSAGE_SQL)).collect()
        marks = np.concatenate([np.frombuffer(S._body(r.asDict()), np.uint8) for r in flags])
        sent.append(int((marks == S.CROWDED).sum()))
    assert sent[0] == 0 < sent[1]


def test_equal_hashes_of_different_bytes():
    """Contents whose hash should be equal by chance are told apart."""
    data = np.frombuffer(b"aaaabbbbaaaacccc", np.uint8)
    at, size = np.array([0, 4, 8, 12]), np.full(4, 4)
    one = np.ones(4, np.uint64)
    own, kept, low = S.distinct(data, at, size, one, one, np.array([5, 6, 3, 9]))
    assert own[0] == own[2] and len(set(own.tolist())) == 3
    assert low[own].tolist() == [3, 6, 3, 9] and kept[own[0]] == 2


def test_empty_table(docs_of):
    assert S.remove_repeats(docs_of([(1, "x")]).where("false")).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    width = rng.choice([8, 9, 20, 33, 50])
    alphabet = bytes(range(1, rng.choice([2, 3, 6, 40]) + 1))
    base = [bytes(rng.choices(alphabet, k=rng.randint(1, 84))) for _ in range(rng.randint(1, 10))]
    strings = []
    for _ in range(rng.randint(1, 25)):
        own = rng.choice(base)
        a = rng.randint(0, len(own))
        strings.append((own[a:rng.randint(a, len(own))] + rng.choice(base)[:20])[:84] or b"\1")
    owners = [rng.randint(0, 50) for _ in strings]
    index = RunIndex(np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8),
                     np.repeat(owners, [len(s) + 1 for s in strings]), width)
    patterns = strings + [bytes(rng.choices(alphabet, k=30)), b"\xc8\xc8" + strings[0]]
    seen = {}
    for which, at, matched, rows in index.statistics([np.frombuffer(p, np.uint8) for p in patterns]):
        for key, found, low in zip(zip(which.tolist(), at.tolist()), matched.tolist(),
                                   index.lowest_owner(rows).tolist()):
            seen[key] = found, low
    for i, pattern in enumerate(patterns):
        for j in range(len(pattern)):
            n = 0
            while j + n < len(pattern) and any(pattern[j:j + n + 1] in s for s in strings):
                n += 1
            assert seen[i, j][0] == n
            if n >= width:
                assert seen[i, j][1] == min(o for s, o in zip(strings, owners)
                                            if pattern[j:j + width] in s)


def test_runs_are_fewer_than_symbols():
    text = bytes(random.Random(1).choices(range(1, 30), k=60))
    data = np.frombuffer((text + b"\0") * 50, np.uint8)
    assert len(RunIndex(data, np.zeros(len(data), np.int64), 32).starts) < len(data) / 20


def flags_of(texts, buckets=4):
    """Flags of the distinct anchors of documents that are a batch each."""
    sent = []
    for number, text in enumerate(texts):
        raw = text.encode()
        row = {"batch": number, "n_bytes": len(raw), "doc_ids": [number], "lengths": [len(raw)],
               "texts": pa.compress(raw, "zstd", asbytes=True)}
        for batch in S._send_anchors(buckets, S.CHUNK)(iter([pa.RecordBatch.from_pylist([row])])):
            sent += batch.to_pylist()
    out = []
    for bucket in {m["bucket"] for m in sent}:
        table = pa.Table.from_pylist([m for m in sent if m["bucket"] == bucket], schema=S.MESSAGE)
        out += [np.frombuffer(S._body(m), np.uint8) for m in S._flag_anchors(table, S.CROWD).to_pylist()]
    return np.concatenate(out)


def test_phrases_alone_do_not_bring_fragments_together():
    """Phrases of 20 bytes hold anchors of 16, but no string of 50 bytes is in two documents."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    phrases = ["".join(rng.choices(letters, k=20)) for _ in range(10)]
    texts = ["".join("".join(rng.choices(letters, k=60)) + p for p in phrases) for _ in range(30)]
    assert (flags_of(texts) == S.ALONE).all()
    assert (flags_of(texts[:2] + [texts[0][100:180]]) == S.SHARED).sum() >= 4


def test_messages_grow_with_the_corpus(docs_of, rows, monkeypatch):
    """Over sixteen times the text, buckets are four times and batches twice as large."""
    sizes, pack = [], S._pack

    def packed(docs, batch_bytes):
        sizes.append(batch_bytes)
        return pack(docs, batch_bytes)

    monkeypatch.setattr(S, "_pack", packed)
    total = sum(len((r[1] or "").encode()) for r in rows)
    for times in (1, 16):
        monkeypatch.setattr(S, "STEADY", total / times)
        monkeypatch.setattr(S, "BATCH_BYTES", 3000)
        assert plain(S.remove_repeats(docs_of(rows)).drop("kept").collect()) == brute(rows)
    assert sizes == [3000, 6000] and S.scale_of(total) == 4


def test_symbols_shared_before_a_difference_in_all_bits():
    data = np.frombuffer(b"A" + b"\x01" * 8 + b"\0A" + b"\xfe" * 8 + b"\0", np.uint8)
    index = RunIndex(data, np.zeros(len(data), np.int64), 8)
    assert index.shared(np.array([0]), np.array([10]), np.array([8])).tolist() == [1]
