"""Periodic runs: stretches of words that repeat a shorter stretch, and texts without the repetitions.

Of the words of a text, a suffix automaton is built word by word. Its states, taken from the longest to the shortest, hand the ordered sets of
their end positions up to their suffix links, the smaller set into the larger. Each position put in has at most two new neighbours; a neighbour
at a distance that does not exceed the state's length ends a square. Two end positions first meet in the state of their longest common suffix,
so the state's length says how far the square extends to the left; only the last position of each run is kept, where it can't extend to the right.

A run holds each of its words at least as often as its period fits in. So words that the stretch around them holds fewer times are in no run;
texts are cut at them, again and again, and stretches that are too short left out, before an automaton is built.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_of

MIN_LENGTH = 24
MIN_PERIODS = 3
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class EndPositions:
    """An ordered set of positions in buckets, so that an insertion moves few of them."""

    __slots__ = ("buckets", "lows", "size")
    FULL = 512

    def __init__(self, first: int) -> None:
        self.buckets, self.lows, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int, int]:
        """Puts x in; its neighbours, -1 where there is none."""
        k = max(bisect_right(self.lows, x) - 1, 0)
        bucket = self.buckets[k]
        i = bisect_left(bucket, x)
        before = bucket[i - 1] if i else self.buckets[k - 1][-1] if k else -1
        after = bucket[i] if i < len(bucket) else self.lows[k + 1] if k + 1 < len(self.lows) else -1
        bucket.insert(i, x)
        self.size += 1
        self.lows[k] = bucket[0]
        if len(bucket) > self.FULL:
            half = len(bucket) // 2
            self.buckets[k : k + 1] = [bucket[:half], bucket[half:]]
            self.lows[k : k + 1] = [bucket[0], bucket[half]]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for b in self.buckets:
            yield from b


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton: of each state its length, its suffix link and the position at which it was made (-1: a copy)."""
    length, link, made, follow = [0], [-1], [-1], [{}]
    last = 0
    for at, w in enumerate(words):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        made.append(at)
        follow.append({})
        p = last
        while p != -1 and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p != -1:
            q = follow[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                made.append(-1)
                follow.append(dict(follow[q]))
                while p != -1 and follow[p].get(w) == q:
                    follow[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, made


def runs_of(words: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least min_length words and min_periods periods, two or more, ordered."""
    n = len(words)
    length, link, made = automaton(words)
    ends: list[EndPositions | None] = [EndPositions(at) if at >= 0 else None for at in made]
    found = []
    for state in np.argsort(np.array(length), kind="stable")[:0:-1].tolist():
        above, mine = link[state], ends[state]
        ends[state] = None
        if above == 0:
            continue  # the empty suffix: no square
        into = ends[above]
        if into is None:
            ends[above] = mine
            continue
        if into.size < mine.size:
            into, mine = mine, into
        reach = length[above]
        put = list(mine)
        for last, x, next_ in zip([-1, *put], put, [*put[1:], n], strict=False):
            before, after = into.add(x)
            for a, b in ((before if before != last else -1, x), (x, after if after < next_ else -1)):  # new pairs: one of each set, none between them
                d = b - a
                if a >= 0 and 0 < d <= reach and d * (min_periods - 1) <= reach and reach + d >= min_length and (b + 1 == n or words[b + 1] != words[b + 1 - d]):
                    found.append((b - d - reach + 1, reach + d, d))
        ends[above] = into
    return sorted(set(found))


def cut_stretches(codes: np.ndarray, min_length: int, min_periods: int) -> list[tuple[int, int]]:
    """Where runs can be: the stretches left after cutting at words that their stretch holds fewer than min_periods times, to the end."""
    open_, done = [(0, len(codes))], []
    while open_:
        begin, end = open_.pop()
        if end - begin < min_length:
            continue
        part = codes[begin:end]
        if end - begin < len(codes):
            part = np.unique(part, return_inverse=True)[1]
        rare = np.flatnonzero(np.bincount(part)[part] < min_periods)
        if not len(rare):
            done.append((begin, end))
            continue
        edges = np.concatenate(([-1], rare, [end - begin]))
        wide = np.flatnonzero(np.diff(edges) > min_length)
        open_ += [(begin + int(edges[k]) + 1, begin + int(edges[k + 1])) for k in wide]
    return done


def text_runs(words: list[bytes], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """The runs of a text, ordered by start, then period."""
    if len(words) < min_length:
        return []
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    found = []
    for begin, end in cut_stretches(codes, min_length, min_periods):
        found += [(begin + s, n, p) for s, n, p in runs_of(codes[begin:end].tolist(), min_length, min_periods)]
    return sorted(found)


def without_repetitions(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, n, period in runs:
        edges[start + period] += 1
        edges[start + n] -= 1
    covered = np.cumsum(edges[:-1]).tolist()
    return b" ".join([w for w, c in zip(words, covered, strict=True) if not c])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period in words, by start, then period) and collapsed (the text without what runs hold after
    their first period, words joined by one space), one row for each row of docs.

    A run is a stretch of words with smallest period q of at least min_length words and min_periods * q, that no neighbouring word extends. A null or
    empty text has no words and no runs. Ids play no part: rows with a null or repeated doc_id are rows of their own. Other columns are not read.
    Rows are told apart from no others, so nothing is shuffled; a task holds the automaton of one stretch at a time."""
    if min_periods < 2:
        raise ValueError("a run has two periods at least")
    kind = docs.schema["doc_id"].dataType

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in parts:
            n_words, every, kept = [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = text.split()  # of bytes: at space and the five controls from tab to carriage return
                runs = text_runs(words, min_length, min_periods)
                n_words.append(len(words))
                every.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                kept.append(without_repetitions(words, runs))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(every, pa.list_(run)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    return map_texts(docs.select(docs["doc_id"], text_of(docs).alias("text")), batches, f"doc_id {kind.simpleString()}, n_words bigint, runs array<{RUN}>, collapsed string")


def strongest(runs):
    """Column: of an array of runs, ordered by start and period, the first of the greatest length in periods, compared exactly; null if there is none."""
    longer = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda a, b: F.when(longer(a, b), b).otherwise(a))
