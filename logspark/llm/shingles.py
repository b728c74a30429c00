"""Sets of word shingles as sorted 64-bit hashes, for the texts of a batch at once."""

from __future__ import annotations

import numpy as np

from .common import SpanHash, mix

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text its distinct runs of ``size`` words, hashed and sorted.

    Words are what white space parts (space, tab, line breaks), with A-Z in lower case. A text of
    fewer words is one shingle; without words or text the set is empty. The top byte of a hash says how
    short the shingle is, so the longest come first.
    """
    joined = [b" ".join((t or "").encode().translate(LOWER).split()) for t in texts]
    data = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
    spans = SpanHash(data)
    ends = np.flatnonzero(data == 32)
    out, at, word = [], 0, 0
    for own in joined:
        if not own:  # an empty text still has its separating space
            out.append(np.zeros(0, np.uint64))
            at, word = at + 1, word + 1
            continue
        n = own.count(b" ") + 1
        stop = ends[word:word + n]
        start = np.concatenate(([at], stop[:-1] + 1))
        if n < size:
            start, stop = start[:1], stop[-1:]
        else:
            start, stop = start[:n - size + 1], stop[size - 1:]
        short = np.uint64(255) - np.minimum(stop - start, 255).astype(np.uint64)
        out.append(np.unique((short << np.uint64(56)) | (spans(start, stop) >> np.uint64(8))))
        at, word = at + len(own) + 1, word + n
    return out


def set_key(values: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        one = mix(values ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
        two = mix(values + np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(one).to_bytes(8, "big") + int(two ^ np.uint64(len(values))).to_bytes(8, "big")
