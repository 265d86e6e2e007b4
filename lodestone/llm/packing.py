"""Best-fit packing of token pieces into fixed-length sequences, improved by swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, ship, text_or_empty
from lodestone.llm.tokenizing import encoder

CAPACITY = 2048
END_ID = 0
#: From one pass of the search to the next, patterns with this many times fewer bins take part.
_STEP = 4
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole capacities but for the first."""
    head = n % capacity or min(n, capacity)
    starts = [0, *range(head, n, capacity)] if n else []
    return [(a, (starts[i + 1] if i + 1 < len(starts) else n) - a) for i, a in enumerate(starts)]


def _pieces(tokenizer_path: str, capacity: int, end_id: int):
    def cut_up(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        enc = encoder(tokenizer_path)
        end = int(end_id).to_bytes(int(enc.dtype[-1]), "little")
        seen: Counter = Counter()  # at most ``capacity`` keys
        for batch in batches:
            out = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(enc.encode(text.as_py()) + end, enc.dtype).astype("<u4")
                for k, (a, n) in enumerate(cut_points(len(ids), capacity)):
                    for column, value in zip(out, (doc_id, k, a, n, zlib.crc32(ids[a : a + n]), seen[n])):
                        column.append(value)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(out, kinds)]
            columns.insert(5, pa.array([task] * len(out[0]), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return cut_up


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces, with ``task`` and ``nth``: the piece is its task's nth of that length."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), _PIECES)


class Bins:
    """Bins as patterns (lengths in descending order) with how many bins have each.

    A corpus has at most ``capacity`` lengths, so patterns stay few however many documents there
    are, and one exchange moves equal items between equal bins all at once.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count: Counter = Counter()
        self._total = 0
        self.by_room: dict[int, set] = {}
        self.rooms: list[int] = []

    def add(self, pattern: tuple, n: int) -> None:
        if not pattern or not n:
            return
        if pattern not in self.count:
            room = self.capacity - sum(pattern)
            if room not in self.by_room:
                self.by_room[room] = set()
                insort(self.rooms, room)
            self.by_room[room].add(pattern)
        self.count[pattern] += n
        self._total += n

    def take(self, pattern: tuple, n: int) -> None:
        self.count[pattern] -= n
        self._total -= n
        if not self.count[pattern]:
            del self.count[pattern]
            room = self.capacity - sum(pattern)
            self.by_room[room].discard(pattern)
            if not self.by_room[room]:
                del self.by_room[room]
                self.rooms.pop(bisect_left(self.rooms, room))

    def total(self) -> int:
        return self._total

    def tightest(self, need: int):
        """A pattern with the least room that holds ``need`` more, or None."""
        i = bisect_left(self.rooms, need)
        return next(iter(self.by_room[self.rooms[i]])) if i < len(self.rooms) else None


def _with(pattern: tuple, out: tuple, into: tuple) -> tuple:
    left = list(pattern)
    for x in out:
        left.remove(x)
    return tuple(sorted([*left, *into], reverse=True))


def best_fit(histogram: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing over a histogram of lengths."""
    bins = Bins(capacity)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room_for = bins.tightest(length)
            if room_for is None:
                k = capacity // length
                if left >= k:
                    bins.add((length,) * k, left // k)
                    left %= k
                else:
                    bins.add((length,) * left, 1)
                    left = 0
                continue
            n = min(left, bins.count[room_for])
            bins.take(room_for, n)
            bins.add(_with(room_for, (), (length,)), n)
            left -= n
    return bins


@lru_cache(maxsize=20_000)
def _choices(pattern: tuple) -> tuple[dict, dict]:
    """A pattern's items, and its pairs of items, by their sums."""
    counts = Counter(pattern)
    sizes = list(counts)
    pairs = {a + b: (a, b) for i, a in enumerate(sizes) for b in sizes[i:] if a != b or counts[a] > 1}
    return {x: (x,) for x in sizes}, pairs


class _Index:
    """Which underfull patterns could give something back, by what they would give and their room.

    ``below[0][s, r]`` counts the patterns with less room than ``r`` that hold an item ``s`` (all
    of them at ``s`` = 0, which stands for giving nothing back), ``below[1][s, r]`` those that hold
    a pair of sum ``s``.  One strided difference then tells for all ``s`` at once whether somebody
    could take what a donor gives, so no pair of patterns is ever tried in vain.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.below = [np.zeros((capacity + 1, capacity + 2), np.int32) for _ in range(2)]
        self.who: tuple[dict, dict] = ({}, {})

    def change(self, pattern: tuple, by: int) -> None:
        room = self.capacity - sum(pattern)
        items, pairs = _choices(pattern)
        for kind, sums in ((0, (0, *items)), (1, pairs)):
            below, who = self.below[kind], self.who[kind]
            for s in sums:
                below[s, room + 1 :] += by
                there = who.setdefault((s, room), set())
                (there.add if by > 0 else there.discard)(pattern)

    def taker(self, kind: int, first: int, size: int, room: int, least: int):
        """For a donor with ``room`` that gives ``size``: the least sum >= ``first`` that somebody
        can give back, and the fullest such pattern; None if less than ``least`` would move.

        Moving ``d`` = size - sum net to a pattern with room ``r`` raises the sum of squared fills
        where 0 < d <= r < d + the donor's room.
        """
        n = size - least - first + 1
        if n <= 0:
            return None
        width = self.capacity + 2
        flat = self.below[kind].ravel()
        begin = first * width + size - first
        low = flat[begin :: width - 1][:n]
        some = flat[begin + room :: width - 1][:n] > low
        i = int(some.argmax())
        if not some[i]:
            return None
        s = first + i
        r = int(np.searchsorted(self.below[kind][s], low[i], side="right")) - 1
        return s, min(self.who[kind][s, r])


def _exchange(index: _Index, donor: tuple, room: int):
    """(other, items out of the donor, items out of the other) that moves most, or None."""
    items, pairs = _choices(donor)
    best, most = None, 0
    for give, kind, first in ((items, 0, 0), (pairs, 0, 1), (items, 1, 1)):
        for size in sorted(give, reverse=True):
            if size - first <= most:
                break
            found = index.taker(kind, first, size, room, most + 1)
            if found:
                back, other = found
                best, most = (other, give[size], (_choices(other)[kind][back] if back else ())), size - back
    return best


class _Rounds:
    """Notices exchanges that come in rounds, so that a round can be made many times at once.

    A few bins can go around: they take from a bin of a pattern that a million bins have, give what
    they took to a third, and are what they were, with one of the million emptied.  One by one that
    takes as many rounds as there are bins.
    """

    #: Exchanges of a round at most.
    LONGEST = 512

    def __init__(self):
        self.made: list[tuple] = []  # (exchange, what it changed)
        self.at: dict[tuple, tuple[int, int]] = {}  # exchange: its last place, and the one before

    def add(self, exchange: tuple, changed: Counter) -> int:
        """Notes an exchange; the length of the round that it has just closed for the second time, or 0."""
        i = len(self.made)
        self.made.append((exchange, changed))
        last, before = self.at.get(exchange, (-1, -1))
        self.at[exchange] = i, last
        n = i - last
        if before >= 0 and n == last - before and n <= self.LONGEST and self.made[i - n + 1 :] == self.made[i - 2 * n + 1 : i - n + 1]:
            return n
        if i > 1_000_000:  # rounds are short, so the notes may go
            self.clear()
        return 0

    def clear(self) -> None:
        self.made, self.at = [], {}

    def again(self, n: int, count: Counter) -> tuple[Counter, int]:
        """What the last round changes, and how often it can be made from these counts."""
        change: Counter = Counter()
        needed: Counter = Counter()  # of each pattern, how far a round goes below where it began
        for _, changed in self.made[-n:]:
            change.update(changed)
            for p in changed:
                needed[p] = max(needed[p], -change[p])
        times = [(count[p] - needed[p]) // -change[p] for p in change if change[p] < 0]
        return change, max(0, min(times, default=0))


def local_search(bins: Bins) -> Bins:
    """Moves one item, or exchanges one for one or two for one, between underfull bins.

    Each exchange makes a fuller bin fuller and an emptier one emptier, so the sum of squared
    fills rises and the search ends; an emptied bin is gone.  It ends where no exchange raises
    the sum any more, or at the lower bound, and has no other limit.  Donors are taken from the
    emptiest on; one that has nothing to give is asked again only once patterns have come up that
    were not there before (or its own has become two bins).  The search is first among patterns
    that very many bins have, then among those that fewer have, down to one, and exchanges that
    repeat in rounds are made all at once: the work follows the patterns and not how many bins
    there are of each.
    """
    capacity = bins.capacity
    fewest = -(-sum(sum(p) * n for p, n in bins.count.items()) // capacity)
    most = max((n for p, n in bins.count.items() if sum(p) < capacity), default=0)
    least = 1
    while least * _STEP <= most:
        least *= _STEP
    while True:
        _search(bins, least, fewest)
        if least == 1:
            return bins
        least //= _STEP


def _search(bins: Bins, least: int, fewest: int) -> None:
    """The local search among patterns that at least ``least`` bins have."""
    capacity = bins.capacity
    index = _Index(capacity)
    waiting = [(sum(p), p) for p, n in bins.count.items() if n >= least and sum(p) < capacity]
    for _, pattern in waiting:
        index.change(pattern, 1)
    heapify(waiting)
    stuck: set = set()

    def put(pattern: tuple, n: int) -> bool:
        """Adds bins; whether the pattern, or a second lot of it, has come up."""
        before = bins.count.get(pattern, 0)
        bins.add(pattern, n)
        if not pattern or sum(pattern) == capacity or before + n < least:
            return False
        if before < least:
            index.change(pattern, 1)
        if before < 2 * least:
            stuck.discard(pattern)
            heappush(waiting, (sum(pattern), pattern))
        return before < least

    def take(pattern: tuple, n: int) -> None:
        before = bins.count[pattern]
        bins.take(pattern, n)
        if before >= least > before - n and sum(pattern) < capacity:
            index.change(pattern, -1)

    rounds = _Rounds()
    fresh = False  # whether patterns came up since donors were found stuck
    while bins.total() > fewest:
        if not waiting:
            if not fresh:
                return
            fresh = False
            waiting = [(sum(p), p) for p in stuck if bins.count.get(p, 0) >= least]
            heapify(waiting)
            stuck.clear()
            continue
        fill, donor = heappop(waiting)
        if bins.count.get(donor, 0) < least or donor in stuck:
            continue
        alone = bins.count[donor] < 2 * least
        if alone:
            index.change(donor, -1)
        found = _exchange(index, donor, capacity - fill)
        if alone:
            index.change(donor, 1)
        if not found:
            stuck.add(donor)
            continue
        other, out, into = found
        n = bins.count[donor] // 2 if other == donor else min(bins.count[donor], bins.count[other])
        given, taken = _with(donor, out, into), _with(other, into, out)
        take(donor, n)
        take(other, n)
        if bins.count.get(donor, 0) >= least:
            heappush(waiting, (fill, donor))
        for pattern in (given, taken):
            fresh = put(pattern, n) or fresh
        changed: Counter = Counter()
        for pattern, by in ((donor, -n), (other, -n), (given, n), (taken, n)):
            if pattern:
                changed[pattern] += by
        length = rounds.add((donor, other, out, into), changed)
        if length:
            change, times = rounds.again(length, bins.count)
            rounds.clear()
            for pattern, by in change.items():
                if times and by < 0:
                    take(pattern, -by * times)
            for pattern, by in change.items():
                if times and by > 0:
                    fresh = put(pattern, by * times) or fresh


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> Bins:
    return local_search(best_fit(histogram, capacity))


def _slots(bins: Bins) -> tuple[np.ndarray, ...]:
    """Runs of places: from the nth piece of a length on, sequences from ``first`` at ``offset``."""
    used: Counter = Counter()
    first, runs = 0, []
    for pattern, n in sorted(bins.count.items(), reverse=True):
        offset = 0
        for length in pattern:
            runs.append((length, used[length], first, offset))
            used[length] += n
            offset += length
        first += n
    runs.sort()
    columns = np.array(runs, dtype=np.int64).reshape(-1, 4).T
    return (columns[0] << 44) + columns[1], columns[1], columns[2], columns[3]


def _place(key: np.ndarray, nth: np.ndarray, first: np.ndarray, offset: np.ndarray):
    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            run = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(first[run] + rank - nth[run]), pa.array(offset[run])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into as few sequences of at most ``capacity`` tokens as it can.

    One pass tokenises whole texts and keeps a short row a piece.  The histogram of lengths (at
    most ``capacity`` rows) is all the driver sees; best fit and the local search run on it and
    give, for each length, runs of places.  A piece's rank among those of its length is its rank
    in its task plus a prefix sum over tasks, so pieces find their places without a sort and
    without a hot key: the join is on (task, length).

    Null texts count as empty and still hold the end id; null ids, repeated rows and other columns
    are allowed (each row is a document); an empty table gives no rows.  Documents of exactly
    ``capacity`` tokens are not cut; longer ones are cut into whole capacities after a shorter
    first piece.  Ties need no order: pieces of equal length are alike.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    counts = cut(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(pack_histogram(histogram, capacity))
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(*slots), _PLACED)
