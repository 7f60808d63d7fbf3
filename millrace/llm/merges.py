"""Byte-pair merging of many short words side by side.

Words of one length stand as the rows of a matrix of symbols.  In each step the
merge of lowest rank, the leftmost of several, is found in every row and carried
out, so all rows that go on get shorter by one and stay a matrix; rows without a
merge are done.  This is what a byte-pair tokenizer does to each word by itself.

The merges are a sparse table of pairs, kept as rows laid over each other: the
entry of (a, b) stands at ``base[a] + b`` and names a.
"""

from __future__ import annotations

import copy

import numpy as np

_NONE = np.int32(2**31 - 1)

#: Rows that are merged together.
BLOCK = 32_768


class Merges:
    """``first`` and ``last`` give the symbol of a byte, inside a word and at its
    end; ``merges`` are (left, right, made) in order of rank, as ids; ``before``
    is a symbol that stands before each word, or None."""

    def __init__(self, first: np.ndarray, last: np.ndarray, merges: list[tuple[int, int, int]], before: int | None = None):
        self.first, self.last, self.before = first.astype(np.int32), last.astype(np.int32), before
        rank_of: dict[tuple[int, int], int] = {}
        for rank, (a, b, _) in enumerate(merges):
            rank_of.setdefault((a, b), rank)
        self.made = np.array([m for _, _, m in merges], np.int32)
        rows: dict[int, list[tuple[int, int]]] = {}
        for (a, b), rank in rank_of.items():
            rows.setdefault(a, []).append((b, rank))
        top = max([1, *(int(x.max()) for x in (self.first, self.last, self.made) if len(x)), *(max(a, b) for a, b in rank_of)]) + 1
        room = max(1 << 12, 1 << (8 * len(rank_of)).bit_length())
        self.base = np.zeros(top, np.int32)
        self.owner, self.rank = np.full(room + top, -1, np.int32), np.full(room + top, _NONE, np.int32)
        rng = np.random.default_rng(0)
        for a, own in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            right = np.array([b for b, _ in own])
            while True:  # fewer than one place in eight is taken
                at = right + (base := int(rng.integers(0, room)))
                if (self.owner[at] < 0).all():
                    break
            self.base[a], self.owner[at], self.rank[at] = base, a, [r for _, r in own]

    def after(self, symbol: int) -> Merges:
        """The same merges for words that stand after a symbol."""
        made = copy.copy(self)
        made.before = symbol
        return made

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE."""
        at = self.base.take(a) + b
        return np.where(self.owner.take(at) == a, self.rank.take(at), _NONE)

    def __call__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words data[start : start + size], one after the other, and
        how many each has; sizes are above 0."""
        counts, done = np.zeros(len(sizes), np.int64), []
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for rows in np.split(order, cuts):
            for k in range(0, len(rows), BLOCK):
                part = rows[k : k + BLOCK]
                for at, symbols in self._merged(data, starts[part], int(sizes[part[0]]) if len(part) else 0):
                    counts[part[at]] = symbols.shape[1]
                    done.append((part[at], symbols))
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for rows, symbols in done:
            out[(ends[rows] - counts[rows])[:, None] + np.arange(symbols.shape[1])] = symbols
        return out, counts

    def _merged(self, data, starts, size: int):
        """Yield (rows, their symbols) of words of one size as they are done."""
        if not len(starts):
            return
        own = data[starts[:, None] + np.arange(size)]
        symbols = self.first.take(own)
        symbols[:, -1] = self.last.take(own[:, -1])
        if self.before is not None:
            symbols = np.concatenate([np.full((len(own), 1), self.before, np.int32), symbols], 1)
        ranks = self.look(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(own))
        while symbols.shape[1] > 1:
            n, width = symbols.shape
            at = ranks.argmin(1)
            line = np.arange(n)
            best = ranks[line, at]
            go = best != _NONE
            if not go.all():
                yield rows[~go], symbols[~go]
                rows, symbols, ranks, at, best = rows[go], symbols[go], ranks[go], at[go], best[go]
                n, line = len(rows), line[: len(rows)]
                if not n:
                    return
            symbols[line, at] = self.made.take(best)
            left = np.ones((n, width), bool)
            left[line, at + 1] = False
            symbols = symbols[left].reshape(n, width - 1)
            left = np.ones((n, width - 1), bool)
            left[line, at] = False
            ranks = ranks[left].reshape(n, width - 2)
            new = symbols[line, at]
            k = np.flatnonzero(at > 0)
            ranks[k, at[k] - 1] = self.look(symbols[k, at[k] - 1], new[k])
            k = np.flatnonzero(at < width - 2)
            ranks[k, at[k]] = self.look(new[k], symbols[k, at[k] + 1])
        yield rows, symbols
