"""Column-wise construction of the Burrows-Wheeler transform of many strings with their common prefixes.

In each round one symbol of every string goes in, last symbols first. The transform (the symbol before each suffix) and
the prefix that each suffix shares with the one before it are two columns in suffix order. A round reads both from
front to back and writes them anew with the round's suffixes in place: a suffix cX goes where the transform ranks the c
before X, and its common prefix is one more than the least one between X and the nearest c. Columns of more than
``IN_MEMORY`` bytes lie in files, of which two take turns.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Entries read at a time.
BLOCK = 1 << 20
#: Columns of more bytes lie in files.
IN_MEMORY = 1 << 24
#: The symbol before a string's longest suffix so far. The bytes that occur are numbered from 1.
END = 0


class Columns:
    """Transform and common prefixes; ``room`` gives the next generation's arrays, in memory or in the other files."""

    def __init__(self, folder: str, n: int) -> None:
        self.folder, self.turn = folder, 0
        self.symbols, self.common = self.room(n)
        self.symbols[:], self.common[:] = END, 0

    def room(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= IN_MEMORY:
            return np.empty(n, np.uint8), np.empty(n, np.uint8)
        self.turn = 1 - self.turn
        names = (os.path.join(self.folder, f"{name}.{self.turn}") for name in ("symbols", "common"))
        return tuple(np.memmap(name, np.uint8, "w+", shape=(n,)) for name in names)

    def __len__(self) -> int:
        return len(self.symbols)

    def rank(self, places: np.ndarray, new: np.ndarray, counts: np.ndarray, first: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Put the symbols ``new`` at the sorted ``places`` of this generation.

        Gives, sorted: the places of the suffixes that go in, the common prefix of each, and which of ``new`` each is;
        and the places and common prefixes of older suffixes that now follow a new one. ``counts``: how often each
        symbol occurs, with ``new``; ``first``: the number of empty suffixes; ``most``: where common prefixes are cut.
        """
        n_symbols = len(counts)
        heads = first + np.cumsum(counts) - counts - counts[END]
        seen = np.zeros(n_symbols, np.int64)
        # per symbol: the least common prefix since it was last met (-1: never met), and whether it was new there
        least, last_new = np.full(n_symbols, -1, np.int64), np.zeros(n_symbols, bool)
        n = len(self)
        cuts = np.searchsorted(places, np.arange(0, n + BLOCK, BLOCK))
        parts = []
        for k, start in enumerate(range(0, n, BLOCK)):
            block, common = self.symbols[start : start + BLOCK], self.common[start : start + BLOCK]
            a, b = int(cuts[k]), int(cuts[k + 1])
            at, sym = places[a:b] - start, new[a:b]
            block[at] = sym
            order = np.argsort(block, kind="stable")  # a counting sort for bytes
            own = counts if n <= BLOCK else np.bincount(block, minlength=n_symbols)
            begin = np.cumsum(own) - own
            is_new = np.zeros(len(block), bool)
            is_new[at] = True
            hit = np.flatnonzero(is_new[order])
            by = np.argsort(sym, kind="stable")
            c = sym[by].astype(np.int64)
            # the new ones, and the older ones of the same symbol right after them
            after = hit + 1
            ok = after < (begin + own)[c]
            ok[ok] = ~is_new[order[after[ok]]]
            rows = np.concatenate([hit, after[ok]])
            row_c = np.concatenate([c, c[ok]])
            which = np.concatenate([a + by, np.full(int(ok.sum()), -1)])
            inner = rows > begin[row_c]
            value = np.zeros(len(rows), np.int64)
            if inner.any():
                # least common prefix after the row of the same symbol before, up to this row; from back to front, so
                # that what reduceat adds between two of these ranges is one element
                x = rows[inner]
                low, high = order[x - 1] + 1, order[x]
                back = np.lexsort((-low,))
                pairs = np.stack([low[back], high[back] + 1], 1).ravel()
                padded = np.append(common, np.uint8(0))
                found = np.empty(len(x), np.int64)
                found[back] = np.minimum.reduceat(padded, pairs)[::2]
                value[inner] = np.minimum(found + 1, most)
            if n > BLOCK:
                all_least = int(common.min())
                extra = [], [], [], []
                first_rows = {int(s): int(i) for i, s in zip(np.flatnonzero(~inner), row_c[~inner])}
                for s in np.flatnonzero(own[1:]) + 1:
                    head = int(order[begin[s]])
                    if least[s] >= 0:
                        shared = min(int(least[s]), int(common[: head + 1].min()))
                        if s in first_rows:
                            value[first_rows[s]] = min(shared + 1, most)
                        elif last_new[s]:
                            for column, v in zip(extra, (begin[s], s, -1, min(shared + 1, most))):
                                column.append(int(v))
                    tail = int(order[begin[s] + own[s] - 1])
                    least[s] = int(common[tail + 1 :].min()) if tail + 1 < len(common) else most
                    last_new[s] = bool(is_new[tail])
                for s in np.flatnonzero((own == 0) & (least >= 0)):
                    least[s] = min(int(least[s]), all_least)
                if extra[0]:
                    rows, row_c, which, value = (np.concatenate([x, np.array(y, np.int64)]) for x, y in zip((rows, row_c, which, value), extra))
            parts.append((heads[row_c] + seen[row_c] + rows - begin[row_c], value, which))
            seen += own
        target, value, which = (np.concatenate(x) for x in zip(*parts))
        fresh = which >= 0
        order = np.argsort(target[fresh])
        target, value, old_target, old_value = target[fresh][order], value[fresh][order], target[~fresh], value[~fresh]
        return target, value, which[fresh][order], old_target, old_value

    def insert(self, places: np.ndarray, values: np.ndarray, old_places: np.ndarray, old_values: np.ndarray) -> None:
        """New entries at the sorted ``places`` that they have in the result, and new common prefixes of older ones."""
        n = len(self) + len(places)
        symbols, common = self.room(n)
        cuts = np.searchsorted(places, np.arange(0, n + BLOCK, BLOCK))
        for k, start in enumerate(range(0, n, BLOCK)):
            end = min(n, start + BLOCK)
            a, b = int(cuts[k]), int(cuts[k + 1])
            old = np.ones(end - start, bool)
            old[places[a:b] - start] = False
            for column, before, entered in ((symbols, self.symbols, END), (common, self.common, values[a:b])):
                block = column[start:end]
                block[places[a:b] - start] = entered
                block[old] = before[start - a : end - b]
        common[old_places] = old_values
        self.symbols, self.common = symbols, common


def sort_suffixes(text: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the suffixes of the strings ``text[start:end]`` start, in suffix order, and the common prefix (cut at
    ``most``, 255 at the largest) of each with the one before it. Empty suffixes are left out.
    """
    m = len(start)
    if not m:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = (end - start).astype(np.int64)
    rounds = int(size.max())
    # the bytes that occur, as numbers from 1 in their order
    code = np.cumsum(np.bincount(text, minlength=256) > 0)
    text, n_symbols = code[text].astype(np.uint8), int(code[-1]) + 1
    # strings end their insertion together, so that the columns are short for as long as possible
    by_start = np.argsort(-size, kind="stable")
    joins = np.searchsorted(-size[by_start], -(rounds - np.arange(rounds)), side="right")
    counts = np.zeros(n_symbols, np.int64)
    counts[END] = m
    with tempfile.TemporaryDirectory(prefix="evoria-bwt-") as folder:
        columns = Columns(folder, m)
        place, string, at = np.empty(0, np.int64), np.empty(0, np.int64), end.astype(np.int64)
        active = 0
        for r in range(rounds):
            if joins[r] > active:
                # empty suffixes stand in front, in the order of their strings
                more = np.sort(by_start[active : joins[r]])
                place, string = np.concatenate([more, place]), np.concatenate([more, string])
                active = int(joins[r])
                order = np.argsort(place, kind="stable")
                place, string = place[order], string[order]
            at[string] -= 1
            new = text[at[string]]
            added = np.bincount(new, minlength=n_symbols)
            counts += added
            counts[END] = m - active
            target, value, which, old_target, old_value = columns.rank(place, new, counts, m, most)
            columns.insert(target, value, old_target, old_value)
            place, string = target, string[which]
        return _places(columns, end.astype(np.int64), m, rounds, folder)


def _places(columns: Columns, end: np.ndarray, m: int, rounds: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Follows every string through the transform, from its empty suffix to its longest."""
    n = len(columns)
    if n <= IN_MEMORY:
        step, where = np.empty(n, np.int64), np.empty(n, np.int64)
    else:
        step, where = (np.memmap(os.path.join(folder, name), np.int64, "w+", shape=(n,)) for name in ("step", "where"))
    order = np.argsort(columns.symbols, kind="stable")
    step[order] = np.arange(n)
    place, at = np.arange(m), end.copy()
    for _ in range(rounds + 1):
        where[place] = at
        # the m strings' ends rank first, as their empty suffixes do
        more = np.asarray(columns.symbols[place]) != END
        place, at = step[place[more]], at[more] - 1
        if not len(place):
            break
    return np.asarray(where[m:]), np.asarray(columns.common[m:]).astype(np.int64)
