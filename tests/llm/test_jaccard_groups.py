"""Components against brute force over all pairs that share a shingle."""

import random
import re

import pytest

from llm_rows import plain
from logspark.llm import jaccard_groups as J
from logspark.llm.shingles import set_key, shingle_sets


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    sets = [(r[0], shingles(r[1], size)) for r in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (one, a) in enumerate(sets):
        for j, (two, b) in enumerate(sets[:i]):
            if a and b and one is not None and two is not None:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    low = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(((doc, len(s), None if doc is None else low[find(i)])
                   for i, (doc, s) in enumerate(sets)), key=repr)


def near_copies(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choices(vocabulary, k=rng.choice([1, 2, 3, 12, 30, 60, 61, 90])) for _ in range(15)]
    rows = []
    for i in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed,percent", [(1, 90), (2, 80)])
def test_against_brute_force(docs_of, odd_rows, seed, percent):
    rows = near_copies(seed) + [(500 + (r[0] or 0) if r[0] else None, *r[1:]) for r in odd_rows]
    assert plain(J.linked_documents(docs_of(rows), 3, percent).collect()) == brute(rows, 3, percent)


def test_common_shingles_and_shuffled_ids(docs_of, monkeypatch):
    """With nearly all members put last, and ids joined without a broadcast."""
    monkeypatch.setattr(J, "COMMON", 2)
    monkeypatch.setattr(J, "IN_BATCH", 2)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    rows = near_copies(3)
    assert plain(J.linked_documents(docs_of(rows), 3, 85).collect()) == brute(rows, 3, 85)


def test_chain_of_copies(docs_of):
    """Each links only with the next: the component spans all."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(12):
        words = words[:i * 3] + [f"new{i}"] + words[i * 3 + 1:]
        rows.append((50 - i, " ".join(words)))
    assert plain(J.linked_documents(docs_of(rows)).collect()) == brute(rows, 3, 90)


def test_keep_one(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = J.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    assert plain(r[0] for r in kept.select(J.F.struct("doc_id")).collect()) == plain(
        [(i,) for i in (1, 2, 3, 4, None, None, 6, 7, 8, 9, 11)])


def test_empty_table(docs_of):
    empty = docs_of([(1, "x")]).where("false")
    assert J.linked_documents(empty).collect() == [] and J.keep_one(empty).collect() == []


def test_sets():
    texts = [r[1] for r in near_copies(4, 60)] + ["", None, "A b", "a B", "a\tb\x0bc\x0cd"]
    for size in (1, 3, 5):
        got = shingle_sets(texts, size)
        own = [shingles(t, size) for t in texts]
        assert [len(s) for s in got] == [len(s) for s in own]
        for i in range(0, len(texts), 7):
            for j in range(len(texts)):
                assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(own[i] & own[j])
                assert (set_key(got[i]) == set_key(got[j])) == (own[i] == own[j])
