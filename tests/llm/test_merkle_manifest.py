"""The manifest against the same trees built in one place, row by row."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from llm_rows import plain
from pyspark.sql import functions as F

from logspark.llm import merkle_manifest as M

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root over ``nodes`` and each one's runs as (place, run)."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i:i + 16] for i in range(0, len(level), 16)]
        for i, a in enumerate(at):
            paths[i].append((a % 16, runs[a // 16]))
        at = [a // 16 for a in at]
        level = [digest("".join(r)) for r in runs]
    return level[0], paths


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    root, tops = climb([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops):
        subroot, paths = trees[s]
        for (_, _, own, row), path in zip(sorted(sources[s], key=lambda x: x[:3]), paths):
            now = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                now = leaf((*row[:4], row[4].translate(str.maketrans(UPPER, LOWER))))
            proof = ""
            for at, run in path + top:
                proof += "".join(run[:at] + run[at + 1:])
                now = digest("".join(run[:at] + [now] + run[at + 1:]))
            out.append((row[0], own, subroot, root, digest(proof), now, now == root))
    return out


def manifest(df):
    return M.verified(df, F.translate("text", UPPER, LOWER),
                      F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def rows_of(df):
    return [tuple(r) for r in df.select(*M.FIELDS).collect()]


def test_odd_rows(docs_of, odd_rows):
    df = docs_of(odd_rows)
    expected = brute(rows_of(df))
    assert plain(manifest(df).collect()) == plain(expected)
    assert len(expected) == len(odd_rows)


@pytest.mark.parametrize("sizes", [(1,), (16, 1), (17, 2, 300), (4096, 4097, 5), tuple([1] * 40)])
def test_shapes(docs_of, sizes):
    rng = random.Random(len(sizes))
    rows, n = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            rows.append((n, rng.choice(["One Two", "three four", "Five"]), f"src{s}" if s else None))
            n += 1
    rng.shuffle(rows)
    df = docs_of(rows, parts=5)
    got = manifest(df).collect()
    assert plain(got) == plain(brute(rows_of(df)))
    assert len({r.root for r in got}) == 1


def test_small_superblocks_and_bundles(docs_of, monkeypatch):
    """Many ranges and bundles, and a source with several superblocks."""
    rows = [(i * 7 % 9000, f"Text {i}", "hot" if i % 3 else f"s{i % 40}") for i in range(9000)]
    df = docs_of(rows, parts=4)
    monkeypatch.setattr(M, "RANGE_ROWS", 700)
    monkeypatch.setattr(M, "BUNDLE", 300)
    assert plain(manifest(df).collect()) == plain(brute(rows_of(df)))


def test_only_changed_rows_fail(docs_of):
    df = docs_of([(i, "Aa" if i % 2 else "aa", "s") for i in range(200)])
    got = {r.doc_id: r for r in manifest(df).collect()}
    for i, r in got.items():
        changed = zlib.crc32(str(i).encode()) % 5 == 0 and i % 2
        assert r.verified == (not changed) and (r.folded_root == r.root) == r.verified


def test_empty_table(docs_of):
    assert manifest(docs_of([(1, "x")]).where("false")).collect() == []
