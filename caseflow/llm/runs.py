"""Periodic runs of words by recompression.

A run is a stretch with smallest period q of at least ``max(least, repeats * q)`` words that cannot be extended with that period. Such a run covers ``repeats`` consecutive
multiples of q, so for each q the candidates are the points of the grid q, 2q, 3q ... at which that many words a step apart are equal; the grids of all q together have n ln n points.

Each candidate is extended to both sides as far as words q apart agree. That is a longest common extension, which a run-length grammar answers: levels of a text are made in
turn by block compression (a stretch of one symbol becomes one symbol with a count) and pair compression (symbols are dealt to two classes by a fixed hash, and a symbol of the first class merges with one of the
second class behind it). Equal substrings are compressed alike but for their rims, and equal symbols of a level stand for equal words. An extension climbs from words to long symbols
and steps down again where symbols differ. Neither suffix arrays nor fingerprints are needed, and the answer is exact.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the documents that are searched together.
GROUP_WORDS = 400_000


class Level:
    """One level of a grammar: its symbols, the first symbol of each below, and which symbol above each belongs to. ``base`` and ``count`` are set where the level was made by blocks."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray | None = None, base: np.ndarray | None = None, count: np.ndarray | None = None) -> None:
        self.n = len(symbols)
        self.symbols = symbols.tolist()
        self.base, self.count = (None, None) if base is None else (base.tolist(), count.tolist())
        self.first = None if first is None else first.tolist()
        self.above: list[int] | None = None


def _classes(symbols: np.ndarray, level: int) -> np.ndarray:
    """The class of each symbol in a round: a bit of a multiplicative hash, fixed for all texts."""
    x = (symbols.astype(np.uint64) + np.uint64(level + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(60)) & np.uint64(1)


class Grammar:
    """The run-length grammar of a sequence of whole numbers and longest common extensions by it."""

    def __init__(self, symbols: np.ndarray, rounds: int = 64) -> None:
        self.levels = [Level(symbols)]
        for k in range(rounds):
            if len(symbols) < 2:
                break
            edge = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
            first = np.concatenate([[0], edge])
            if len(first) < len(symbols):  # blocks
                count = np.diff(np.append(first, len(symbols)))
                base = symbols[first]
                symbols = self._name(base, count)
                self._add(symbols, first, base, count)
            left = _classes(symbols, k) == 0
            heads = np.flatnonzero(left[:-1] & ~left[1:])
            if len(heads):  # pairs
                inner = np.ones(len(symbols), bool)
                inner[heads + 1] = False
                first = np.flatnonzero(inner)
                second = np.full(len(symbols), -1, np.int64)
                second[heads] = symbols[heads + 1]
                symbols = self._name(symbols[first], second[first] + 1)
                self._add(symbols, first)

    @staticmethod
    def _name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers for pairs of numbers, equal for equal pairs only."""
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)

    def _add(self, symbols: np.ndarray, first: np.ndarray, base: np.ndarray | None = None, count: np.ndarray | None = None) -> None:
        below = self.levels[-1]
        mark = np.zeros(below.n, np.int64)
        mark[first[1:]] = 1
        below.above = np.cumsum(mark).tolist()
        self.levels.append(Level(symbols, np.append(first, below.n), base, count))

    def forward(self, i: int, j: int) -> int:
        """How many words from ``i`` on equal those from ``j`` on; i < j."""
        at, begin, climbing = 0, i, True
        while True:
            level, up = self.levels[at], self.levels[at + 1] if climbing and at + 1 < len(self.levels) else None
            if j < level.n:
                if up is not None:
                    a, b = level.above[i], level.above[j]
                    if up.first[a] == i and up.first[b] == j:
                        i, j, at = a, b, at + 1
                        continue
                    if up.base is not None and up.base[a] == up.base[b]:  # inside two blocks of one symbol
                        skip = min(up.first[a + 1] - i, up.first[b + 1] - j)
                        i, j = i + skip, j + skip
                        continue
                if level.symbols[i] == level.symbols[j]:
                    i, j = i + 1, j + 1
                    continue
            if at == 0:
                return i - begin
            # symbols differ: what they share at their start is found below, in blocks of one symbol at once
            skip = min(level.count[i], level.count[j]) if level.base is not None and j < level.n and level.base[i] == level.base[j] else 0
            i, j, at, climbing = level.first[i] + skip, level.first[j] + skip, at - 1, False

    def backward(self, i: int, j: int) -> int:
        """How many words before ``i`` equal those before ``j``; i < j."""
        at, begin, climbing = 0, i, True
        while True:
            level, up = self.levels[at], self.levels[at + 1] if climbing and at + 1 < len(self.levels) else None
            if i > 0:
                if up is not None:
                    a, b = level.above[i - 1], level.above[j - 1]
                    if up.first[a + 1] == i and up.first[b + 1] == j:
                        i, j, at = a + 1, b + 1, at + 1
                        continue
                    if up.base is not None and up.base[a] == up.base[b]:
                        skip = min(i - up.first[a], j - up.first[b])
                        i, j = i - skip, j - skip
                        continue
                if level.symbols[i - 1] == level.symbols[j - 1]:
                    i, j = i - 1, j - 1
                    continue
            if at == 0:
                return begin - i
            skip = min(level.count[i - 1], level.count[j - 1]) if level.base is not None and i > 0 and level.base[i - 1] == level.base[j - 1] else 0
            i, j, at, climbing = level.first[i] - skip, level.first[j] - skip, at - 1, False


def grid_candidates(symbols: np.ndarray, counts: np.ndarray, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(periods, points), sorted: grid points from which ``repeats`` words a period apart are equal. ``counts`` are the lengths of the texts laid end to end, longest first."""
    ends, periods, points = np.cumsum(counts), [], []
    longest = int(counts[0]) if len(counts) else 0
    upto = np.searchsorted(-counts, -repeats * np.arange(1, longest // repeats + 1), side="right")  # texts that are long enough for a period
    for q, texts in enumerate(upto.tolist(), 1):
        grid = symbols[: ends[texts - 1] : q]
        same = grid[1:] == grid[:-1]
        chain = same[: len(same) - repeats + 2].copy()
        for k in range(1, repeats - 1):
            chain &= same[k : len(same) - repeats + 2 + k]
        found = np.flatnonzero(chain)
        if found.size:
            periods.append(np.full(found.size, q))
            points.append(found * q)
    none = np.zeros(0, np.int64)
    return (np.concatenate(periods), np.concatenate(points)) if periods else (none, none)


def runs_of(words: list[list], *, least: int = 6, repeats: int = 4) -> list[list[tuple[int, int, int]]]:
    """For each text (a list of words): its runs (start, length, period), by start and then period."""
    out: list[list] = [[] for _ in words]
    order = sorted((k for k, w in enumerate(words) if len(w) >= max(least, repeats)), key=lambda k: -len(words[k]))
    if not order:
        return out
    names: dict = {}
    counts = np.array([len(words[k]) + 1 for k in order])
    symbols = np.empty(counts.sum(), np.int64)
    ends = np.cumsum(counts)
    for k, end, n in zip(order, ends.tolist(), counts.tolist(), strict=True):
        symbols[end - n : end - 1] = [names.setdefault(w, len(names)) for w in words[k]]
    symbols[ends - 1] = len(names) + np.arange(len(ends))  # what parts two texts stands once only
    periods, points = grid_candidates(symbols, counts, repeats)
    inside = points + (repeats - 1) * periods < ends[np.searchsorted(ends, points, side="right")]  # a step may jump into the next text
    periods, points = periods[inside], points[inside]
    if not points.size:
        return out
    # the grammar of the texts with candidates
    has = np.unique(np.searchsorted(ends, points, side="right"))
    starts = ends - counts
    size = counts[has]
    moved = np.concatenate([[0], np.cumsum(size)])[:-1]
    grammar = Grammar(np.concatenate([symbols[starts[t] : ends[t]] for t in has.tolist()]))
    text = np.searchsorted(ends, points, side="right")
    slot = np.searchsorted(has, text)
    place = points - starts[text] + moved[slot]
    mine = np.argsort(slot, kind="stable")  # by text, then period, then place
    cuts = np.searchsorted(slot[mine], np.arange(len(has) + 1))
    for t, base, lo, hi in zip(has.tolist(), moved.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        found = _runs(grammar, periods[mine[lo:hi]], place[mine[lo:hi]], least, repeats)
        out[order[t]] = sorted((start - base, stop - start, q) for (start, stop), q in found.items())
    return out


def _runs(grammar: Grammar, periods: np.ndarray, points: np.ndarray, least: int, repeats: int) -> dict[tuple[int, int], int]:
    """The runs (start, stop) of one text with their periods, from its candidates by period and place."""
    found: dict[tuple[int, int], int] = {}
    of = dict(zip(*(x.tolist() for x in np.unique(periods, return_index=True)), strict=True))
    stops = dict(zip(of, [*list(of.values())[1:], len(periods)], strict=True))
    done, at, last_q, last_stop = bytearray(len(periods)), points.tolist(), 0, -1
    for c, (q, p) in enumerate(zip(periods.tolist(), at, strict=True)):
        if done[c] or q == last_q and p + (repeats - 1) * q < last_stop:
            continue
        start, stop = p - grammar.backward(p, p + q), p + q + grammar.forward(p, p + q)
        if stop - start < max(least, repeats * q):
            continue
        last_q, last_stop = q, stop
        if found.setdefault((start, stop), q) < q:
            continue
        for some in range(2 * q, (stop - start) // repeats + 1, q):  # multiples of the period give this run again
            if some in of:
                a = bisect_left(at, start, of[some], stops[some])
                b = bisect_left(at, stop - (repeats - 1) * some, a, stops[some])
                done[a:b] = b"\1" * (b - a)
    return found


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that some run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, dead in zip(words, (np.cumsum(edge)[:-1] > 0).tolist(), strict=True) if not dead]


def find_runs(docs: DataFrame, *, least: int = 6, repeats: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed_text) for each row; ``runs`` is an array of (start, length, period) by start, then period.

    Words are runs of anything but ASCII white space. Null and empty texts have no words and no runs, and their collapsed text is empty. Each row is judged alone, so ids may be null, of
    any type, or repeated; an empty table gives an empty result. Other columns are not read. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, group = 0, 0, []
            for at, text in enumerate(batch.column(1), 1):
                group.append((text.as_py() or "").encode().split())
                held += len(group[-1])
                if held >= GROUP_WORDS or at == batch.num_rows:
                    found = runs_of(group, least=least, repeats=repeats)
                    texts = [b" ".join(collapsed(words, runs)).decode() for words, runs in zip(group, found, strict=True)]
                    runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in some] for some in found]
                    columns = [batch.column(0).slice(begin, len(group)), pa.array(list(map(len, group)), pa.int64()), pa.array(runs, pa.list_(spans)), pa.array(texts, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed_text"])
                    begin, held, group = at, 0, []

    return rows.mapInArrow(search, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string")
