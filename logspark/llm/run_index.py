"""A run-length index over byte strings: matching statistics in a run-compressed transform.

The Burrows-Wheeler transform of repetitive strings has few runs. The index keeps, per run, its
symbol, its start, where its first row maps to, and the text positions of its first and last rows. A
pattern is streamed from its right end: while the next symbol to the left is that of the current row,
the row maps on; otherwise the match jumps to the nearest run of the symbol above or below, whichever
shares more with what is matched, measured from the sampled positions. All patterns move together,
one numpy step a symbol.

Rows whose suffixes share ``width`` bytes or more are neighbours; of each such block the index knows
the smallest owner of its strings.
"""

from __future__ import annotations

import numpy as np


def _keys(sym: np.ndarray, to_mark: np.ndarray) -> np.ndarray:
    """Eight symbols from each position on, as one number; zeros after an end mark."""
    n = len(sym)
    padded = np.concatenate((sym, np.zeros(8, np.uint8)))
    out = np.ndarray(n, ">u8", padded, 0, (1,)).astype(np.uint64)
    near = np.flatnonzero(to_mark < 8)
    out[near] &= ~(~np.uint64(0) >> (to_mark[near] * 8).astype(np.uint64))
    return out


class RunIndex:
    """Index of ``data``, strings each followed by an end mark of 0; other symbols are 1 to 255."""

    def __init__(self, data: np.ndarray, owner: np.ndarray, width: int) -> None:
        """``owner``: for each position, who the string there belongs to."""
        if width < 8:
            raise ValueError("matches of fewer than 8 bytes are not told apart")
        self.width, self.sym = width, data
        n = len(data)
        self.to_mark = self._to_mark(n)
        self.keys = _keys(data, self.to_mark)
        rows, half_rank = self._sorted()
        before = data[rows - 1]  # row 0's predecessor is the last mark
        starts = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.starts = starts
        self.heads = before[starts]
        self.ends = np.append(starts[1:], n)
        lengths = self.ends - starts
        self.run_of = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
        by_symbol = np.argsort(self.heads, kind="stable")
        mapped = np.zeros(len(starts), np.int64)
        mapped[by_symbol] = np.cumsum(lengths[by_symbol]) - lengths[by_symbol]
        self.mapped = mapped
        self.first, self.last = rows[starts], rows[self.ends - 1]
        # runs of each symbol, as numbers to search in
        self.places = self.heads[by_symbol].astype(np.int64) * (len(starts) + 1) + by_symbol
        self.by_symbol = by_symbol
        # rows that share ``width`` symbols with the one above: both halves rank alike
        late = np.minimum(rows + (width - self.half), n - 1)
        one, two, full = half_rank[rows], half_rank[late], self.to_mark[rows] >= width
        same = np.concatenate(([False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])
                               & full[1:] & full[:-1]))
        self.block_of = np.cumsum(~same, dtype=np.int32) - 1
        self.lowest = np.minimum.reduceat(owner[rows], np.flatnonzero(~same))

    def _to_mark(self, n: int) -> np.ndarray:
        marks = np.flatnonzero(self.sym == 0)
        return np.repeat(marks, np.diff(marks, prepend=-1)) - np.arange(n)

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and their ranks by the first ``half`` symbols only.

        Prefix doubling from as many symbols on as fit a number beside a position. End marks differ from
        each other, in text order, so suffixes that reach one are told apart by it and only others are
        sorted further. What is sorted are numbers that end in their position, which is faster than
        sorting positions, and leaves equal ones in text order.
        """
        n, to_mark = len(self.sym), self.to_mark
        bits = max(1, int(n - 1).bit_length())
        seen = np.bincount(self.sym, minlength=256) > 0
        seen[0] = True
        code = (np.cumsum(seen) - 1).astype(np.uint64)[self.sym]
        base = int(seen.sum())
        k = next(k for k in range(8, 0, -1) if base ** k <= 1 << (64 - bits))
        self.half = k << ((self.width // k).bit_length() - 1)  # ranks by so many symbols are kept
        lead = code.copy()
        for shift in range(1, k):
            lead *= np.uint64(base)
            lead[:n - shift] += code[shift:]
        near = np.flatnonzero(to_mark < k)  # nothing counts after a mark
        unit = np.array([base ** e for e in range(k + 1)], np.uint64)[k - to_mark[near]]
        lead[near] -= lead[near] % unit
        lead = np.sort((lead << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
        rows = (lead & np.uint64((1 << bits) - 1)).astype(np.int64)
        lead >>= np.uint64(bits)
        new = np.concatenate(([True], (lead[1:] != lead[:-1]) | (to_mark[rows[1:]] < k)))
        spots, own = np.arange(n), rows
        rank, half_rank = np.zeros(n, np.int64), None
        while True:
            rank[own] = np.maximum.accumulate(np.where(new, spots, 0))
            if k == self.half:
                half_rank = rank.copy()
            tied = ~new
            tied[:-1] |= ~new[1:]
            spots = spots[tied]
            if not len(spots):
                return rows, rank if half_rank is None else half_rank
            own = rows[spots]
            one, two = rank[own], rank[np.minimum(own + k, n - 1)]
            if 3 * bits < 64:
                pair = np.sort((one << (2 * bits)) | (two << bits) | own)
                own = pair & ((1 << bits) - 1)
                pair >>= bits
            else:
                pair = (one << 32) | two
                order = np.argsort(pair, kind="stable")
                own, pair = own[order], pair[order]
            rows[spots] = own
            k *= 2
            new = np.concatenate(([True], (pair[1:] != pair[:-1]) | (to_mark[own[1:]] < k)))

    def shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and ``b`` share, ``most`` at the most."""
        out, n = np.zeros(len(a), np.int64), len(self.sym)
        going = np.arange(len(a))
        while len(going):
            at = out[going]
            x, y = a[going] + at, b[going] + at
            inside = (x < n) & (y < n)
            differ = np.where(inside, self.keys[np.minimum(x, n - 1)]
                              ^ self.keys[np.minimum(y, n - 1)], np.uint64(1) << np.uint64(63))
            # symbols alike before the first difference, from the top byte down
            top = (differ & ~(differ >> np.uint64(1))).astype(np.float64)  # not rounded to a higher bit
            alike = np.where(differ == 0, 8, (64 - np.frexp(top)[1]) // 8)
            out[going] = np.minimum(at + alike, most[going])
            going = going[(differ == 0) & (out[going] < most[going])]
        return out

    def statistics(self, patterns: list[np.ndarray]):
        """For each step, from the right: pattern numbers, positions, matched lengths and rows."""
        sizes = np.array([len(p) for p in patterns])
        widest = int(sizes.max(initial=0))
        table = np.zeros((len(patterns), widest), np.uint8)
        if widest:
            table[np.arange(widest) >= widest - sizes[:, None]] = np.concatenate(patterns)
        order = np.argsort(-sizes, kind="stable")
        columns, sizes = np.ascontiguousarray(table[order].T), sizes[order]
        row = np.zeros(len(patterns), np.int64)
        spot = np.full(len(patterns), self.first[0])
        length = np.zeros(len(patterns), np.int64)
        runs = len(self.starts)
        for back in range(1, widest + 1):
            live = int(np.searchsorted(-sizes, -back, "right"))
            c = columns[widest - back, :live]
            r, s, ell = row[:live], spot[:live], length[:live]
            run = self.run_of[r]
            off = np.flatnonzero(self.heads[run] != c)
            if len(off):
                symbol, held, most = c[off], s[off], ell[off]
                at = np.searchsorted(self.places, symbol.astype(np.int64) * (runs + 1) + run[off])
                low, high = np.maximum(at - 1, 0), np.minimum(at, runs - 1)
                up, down = self.by_symbol[low], self.by_symbol[high]
                has_up = (at > 0) & (self.heads[up] == symbol)
                has_down = (at < runs) & (self.heads[down] == symbol)
                far_up = np.where(has_up, self.shared(held, self.last[up], most), -1)
                far_down = np.where(has_down, self.shared(held, self.first[down], most), -1)
                rise = far_up >= far_down
                run[off] = np.where(rise, up, down)
                r[off] = np.where(rise, self.ends[up] - 1, self.starts[down])
                s[off] = np.where(rise, self.last[up], self.first[down])
                ell[off] = np.maximum(far_up, far_down)
            missing = ell < 0
            r[:] = np.where(missing, 0, self.mapped[run] + r - self.starts[run])
            s[:] = np.where(missing, self.first[0], s - 1)
            ell[:] = np.where(missing, 0, ell + 1)
            yield order[:live], sizes[:live] - back, ell, r

    def lowest_owner(self, rows: np.ndarray) -> np.ndarray:
        """The smallest owner among rows that share ``width`` symbols with each of ``rows``."""
        return self.lowest[self.block_of[rows]]
