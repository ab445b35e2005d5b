"""Repeated passages by a hash-compared suffix sort.

A byte goes if a string of WINDOW bytes that covers it also starts in a document with a smaller id. To find such strings
without sorting every suffix of the corpus, anchors are chosen by content: of the positions at which a string of ANCHOR
bytes begins within a window, the one with the smallest hash. Equal windows choose equal anchors at equal places, so a
window can only repeat where its anchor does. Anchors meet by their hash:

1. Anchors whose whole surroundings (every window that can hold them) are hashed alike form a class; all but the
   smallest document of a class are covered there.
2. Of classes that share an anchor, the surroundings are fetched and what follows each anchor, and what precedes it, read
   backwards, is sorted as suffixes are: in a merge sort whose comparisons find the longest common extension by binary
   search over prefix hashes. Neighbours are compared byte by byte; should a hash have been wrong, those suffixes are sorted
   again by their bytes. Windows are equal if both their parts are; in each class of equal windows, all but the smallest
   document are covered.

Suffixes are sorted within the group of an anchor: those that can be equal, and no others, meet. Groups are streamed; an anchor with more
classes than a task should hold is resolved by grouping its windows' bytes in Spark instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, map_texts
from .hashing import Prefixes, mix

WINDOW, ANCHOR = 50, 20
CHUNK = 1 << 19
BLOCK = 1 << 21
#: Rows of surroundings sorted at a time, and classes of one anchor from which Spark groups its windows.
BUFFER, HOT = 16_384, 20_000


def _blocks(docs: list[int], datas: list[bytes], window: int, anchor: int) -> Iterator[list[tuple[int, int, bytes, int, int]]]:
    """Runs of (doc, place of its first byte, bytes, first and one past the last window start in them) of about CHUNK bytes.

    Longer documents come in blocks that overlap by what windows and surroundings reach."""
    held, size = [], 0
    for doc, data in zip(docs, datas, strict=True):
        starts = len(data) - window + 1
        for a in range(0, max(0, starts), BLOCK):
            b = min(starts, a + BLOCK)
            low, high = max(0, a - (window - anchor)), min(len(data), b + 2 * window - anchor)
            if held and size + high - low > CHUNK:
                yield held
                held, size = [], 0
            held.append((doc, low, data[low:high], a - low, b - low))
            size += high - low
    if held:
        yield held


def anchors(blocks: list[tuple[int, int, bytes, int, int]], prefixes: Prefixes, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """anchor hash, hash of the surroundings, doc, place of each anchor that a window of the blocks chooses."""
    data = np.frombuffer(b"".join(x[2] for x in blocks), np.uint8)
    lengths = np.array([len(x[2]) for x in blocks])
    begins = np.r_[0, lengths.cumsum()]
    sums = prefixes.of(data)
    n = len(data) - anchor + 1
    at = np.arange(n)
    raw = prefixes.between(sums, at, at + anchor)
    wide = window - anchor + 1
    bits = np.uint64(max(1, int(n).bit_length()))
    # The order of positions: by a hash, then by place. The place is in the lower bits, so the minimum tells it.
    order = ((mix(raw) >> bits) << bits) | at.astype(np.uint64)
    least, reach = order, 1
    while reach * 2 <= wide:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
    chosen = [least[b + x[3] : b + x[4]] for b, x in zip(begins.tolist(), blocks, strict=False)]
    owner = np.repeat(np.arange(len(blocks)), [len(c) for c in chosen])
    place = (np.concatenate(chosen) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]
    place, owner = place[new], owner[new]
    low = np.maximum(begins[owner], place - (window - anchor))
    high = np.minimum(begins[owner + 1], place + window)
    around = mix(prefixes.between(sums, low, high) + mix(((place - low) << 32 | (high - place)).astype(np.uint64)))
    doc = np.array([x[0] for x in blocks], np.int64)[owner]
    where = place - begins[owner] + np.array([x[1] for x in blocks], np.int64)[owner]
    return mix(raw[place] ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64), around.view(np.int64), doc, where


class ClassStream:
    """Splits anchors, sorted by anchor, surroundings and doc, into those covered by a smaller document with equal surroundings
    and those to compare further. Holds the occurrences of one anchor in one document at most from one batch to the next."""

    def __init__(self) -> None:
        self.anchor = self.around = self.least = None
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.doc = None  # the one document of the pending rows
        self.several = False

    def feed(self, anchor: np.ndarray, around: np.ndarray, doc: np.ndarray, where: np.ndarray):
        """covered (doc, where) and open (anchor, doc, where)."""
        n = len(anchor)
        new_group = np.r_[self.anchor is None or anchor[0] != self.anchor, anchor[1:] != anchor[:-1]]
        new_class = new_group | np.r_[self.around is None or around[0] != self.around, around[1:] != around[:-1]]
        first = np.maximum.accumulate(np.where(new_class, np.arange(n), -1))
        least = np.where(first >= 0, doc[np.maximum(first, 0)], doc[0] if self.least is None else self.least)
        covered = doc > least
        heads = ~covered
        group = np.cumsum(new_group)  # 0: goes on from the last batch
        out = []
        if not new_group[0]:
            mine = (group == 0) & heads
            docs = doc[mine]
            if not self.several and len(docs) and (docs != self.doc).any():
                out += self.pending
                self.pending, self.several = [], True
            part = (anchor[mine], doc[mine], where[mine])
            (out if self.several else self.pending).append(part)
        if group[-1] > 0:
            self.pending = []
            inside = heads & (group > 0)
            g, d = group[inside], doc[inside]
            if len(g):
                starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                low, high = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
                size = np.diff(np.r_[starts, len(g)])
                several = np.repeat(low != high, size)
                last = g == group[-1]
                keep = (anchor[inside], d, where[inside])
                out.append(tuple(x[several] for x in keep))
                self.several = bool(several[-1])
                if not self.several:
                    self.pending, self.doc = [tuple(x[last] for x in keep)], d[last][0]
        self.anchor, self.around, self.least = anchor[-1], around[-1], least[-1]
        opened = tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))
        return (doc[covered], where[covered]), opened


def sort_suffixes(data: np.ndarray, sums: np.ndarray, prefixes: Prefixes, start: np.ndarray, segment: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes within each segment by their first length bytes, and how many bytes each shares with the one before
    it (0 for the first of a segment).

    start: of suffixes, grouped by segment; data has length bytes after each. A merge sort of all segments at once: in each
    round, each element finds its place in the run that its own run is merged with, by binary search. Neighbours are then
    compared byte by byte; a segment that a wrong hash has put out of order is sorted again by its bytes."""
    n = len(start)
    order = np.arange(n)
    begin = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[begin, n])
    first, size = np.repeat(begin, sizes), np.repeat(sizes, sizes)
    rank = np.arange(n) - first
    width, largest = 1, int(sizes.max(initial=0))
    while width < largest:
        left = (rank // width) % 2 == 0
        pair = rank // (2 * width) * (2 * width)
        low = np.where(left, np.minimum(pair + width, size), pair)
        high = np.where(left, np.minimum(pair + 2 * width, size), pair + width)
        lo, hi = low.copy(), high.copy()
        act = np.flatnonzero(lo < hi)
        while len(act):
            mid = (lo[act] + hi[act]) // 2
            mine, other = start[order[act]], start[order[first[act] + mid]]
            c = compare(data, sums, prefixes, other, mine, length)
            before = (c < 0) | ((c == 0) & ~left[act])  # equal ones of the left run come first
            lo[act] = np.where(before, mid + 1, lo[act])
            hi[act] = np.where(before, hi[act], mid)
            act = act[lo[act] < hi[act]]
        own = rank - pair - np.where(left, 0, width)
        moved = np.empty(n, order.dtype)
        moved[first + pair + own + (lo - low)] = order
        order = moved
        width *= 2
    shared = np.zeros(n, np.int64)
    inner = np.flatnonzero(rank > 0)
    shared[inner], ordered = bytes_shared(data, start[order[inner - 1]], start[order[inner]], length)
    for s in np.unique(segment[inner[~ordered]]):  # a hash was wrong
        rows = np.flatnonzero(segment == s)
        by = sorted(rows.tolist(), key=lambda i: data[start[i] : start[i] + length].tobytes())
        order[rows] = by
        shared[rows[1:]] = bytes_shared(data, start[order[rows[:-1]]], start[order[rows[1:]]], length)[0]
    return order, shared


def bytes_shared(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of length bytes at x and y agree before the first that does not, and whether x comes before y or equals it."""
    span, shared, ordered = np.arange(length), np.empty(len(x), np.int64), np.empty(len(x), bool)
    for at in range(0, len(x), 16_384):
        part = slice(at, at + 16_384)
        differ = data[x[part][:, None] + span] != data[y[part][:, None] + span]
        some = differ.any(1)
        shared[part] = np.where(some, differ.argmax(1), length)
        k = np.minimum(shared[part], length - 1)
        ordered[part] = ~some | (data[x[part] + k] < data[y[part] + k])
    return shared, ordered


def common(data: np.ndarray, sums: np.ndarray, prefixes: Prefixes, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """The longest common extension of suffixes at x and y, up to length, by binary search over prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), length, np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = prefixes.between(sums, x, x + mid) == prefixes.between(sums, y, y + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def compare(data: np.ndarray, sums: np.ndarray, prefixes: Prefixes, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Negative, 0 or positive as the suffix at x comes before that at y, equals it in length bytes, or comes after."""
    same = common(data, sums, prefixes, x, y, length)
    at = np.minimum(same, length - 1)
    return np.where(same >= length, 0, data[x + at].astype(np.int64) - data[y + at])


def covered_in_groups(anchor: np.ndarray, doc: np.ndarray, where: np.ndarray, left: np.ndarray, around: list[bytes], prefixes: Prefixes, window: int = WINDOW, width: int = ANCHOR):
    """doc, begin, end, anchor's place of what equal windows in smaller documents cover. Rows are whole groups of an anchor; around: the bytes
    near it, of which left come before it."""
    reach, wide = window - width, window - width + 1
    pad = bytes(window)
    data = np.frombuffer(b"".join([pad, *around, pad]), np.uint8)
    sizes = np.array([len(x) for x in around])
    place = window + np.r_[0, sizes.cumsum()[:-1]] + left
    right = sizes - left
    group = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]])
    # From an anchor, windows reach so many bytes to its left and the rest to its right. Both sides are sorted once, with what
    # neighbours share; for each number of bytes, that tells which sides are equal. (Where a text ends, bytes of another one
    # follow here: they do not count, as windows that reach beyond the text are left out.)
    after, after_shared = sort_suffixes(data, prefixes.of(data), prefixes, place, group, window)
    mirrored = np.ascontiguousarray(data[::-1])
    ahead, ahead_shared = sort_suffixes(mirrored, prefixes.of(mirrored), prefixes, len(data) - place, group, reach) if reach else (after, np.zeros(len(place), np.int64))
    heads = np.r_[True, group[1:] != group[:-1]]
    n = len(place)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    found_row, found_offset = [], []
    for offset in range(wide):
        right_class[after] = np.cumsum(heads | (after_shared < window - offset))
        left_class[ahead] = np.cumsum(heads | (ahead_shared < offset))
        rows = np.flatnonzero((offset <= left) & (window - offset <= right))
        if not len(rows):
            continue
        key = right_class[rows] * (n + 1) + left_class[rows]
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        runs = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.repeat(np.minimum.reduceat(doc[rows], runs), np.diff(np.r_[runs, len(rows)]))
        hit = rows[doc[rows] > least]
        found_row.append(hit)
        found_offset.append(np.full(len(hit), offset))
    row = np.concatenate(found_row) if found_row else np.zeros(0, np.int64)
    begin = where[row] - (np.concatenate(found_offset) if found_row else row)
    # The windows of an anchor overlap, so what they cover is one span.
    by = np.argsort(row, kind="stable")
    row, begin = row[by], begin[by]
    if not len(row):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    low, high = np.minimum.reduceat(begin, starts), np.maximum.reduceat(begin, starts) + window
    return doc[row[starts]], low, high, where[row[starts]]


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans, clipped to size."""
    out: list[list[int]] = []
    for b, e in sorted((max(0, b), min(size, e)) for b, e in spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out if e > b]


def _numbered(docs: DataFrame) -> DataFrame:
    """doc (null: the smallest of all), part, text. part tells apart the rows that share a doc_id; it is 0 where none do."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "text")
    repeated = cut(rows.groupBy("doc").count().filter("count > 1").select("doc"), "repeated")
    plain = rows.withColumn("part", F.lit(0).cast("long"))
    if repeated.isEmpty():
        return plain
    several = rows.join(repeated, "doc", "left_semi").groupBy("doc", "text").count()
    several = several.withColumn("part", F.row_number().over(W.partitionBy("doc").orderBy("text")).cast("long"))
    several = several.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).select("doc", "text", "part")
    return cut(plain.join(repeated, "doc", "left_anti").unionByName(several), "numbered")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc, part, begin, end of what is covered in numbered documents (doc, part, text); spans may overlap and exceed the text."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = Prefixes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                high = (part.column(1).to_numpy(zero_copy_only=False) << 40).tolist()  # the part, in the upper bits of the place
                doc = part.column(0).to_numpy(zero_copy_only=False)
                datas = [t.encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()]
                for blocks in _blocks(list(range(len(datas))), datas, window, anchor):
                    a, c, d, w = anchors(blocks, prefixes, window, anchor)
                    w = w + np.array(high, np.int64)[d]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, c, doc[d], w)], names=["anchor", "around", "doc", "place"])

    chosen = map_texts(docs.select("doc", "part", "text"), choose, "anchor long, around long, doc long, place long")
    met = chosen.repartition("anchor").sortWithinPartitions("anchor", "around", "doc", "place")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ClassStream()
        for b in batches:
            if b.num_rows:
                covered, opened = stream.feed(*(c.to_numpy(zero_copy_only=False) for c in b.columns))
                kinds = np.r_[np.zeros(len(covered[0]), bool), np.ones(len(opened[0]), bool)]
                rows = [np.r_[np.zeros(len(covered[0]), np.int64), opened[0]], np.r_[covered[0], opened[1]], np.r_[covered[1], opened[2]]]
                yield pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, rows)], names=["open", "anchor", "doc", "place"])

    table = cut(met.mapInArrow(split, "open boolean, anchor long, doc long, place long"), "anchors")
    where = F.col("place").bitwiseAND((1 << 40) - 1)
    covered = table.filter("not open").select("doc", F.shiftright("place", 40).alias("part"), (where - (window - anchor)).alias("begin"), (where + window).alias("end"))
    opened = table.filter("open").select("anchor", "doc", F.shiftright("place", 40).alias("part"), where.alias("place"))
    per_doc = opened.groupBy("doc", "part").agg(F.collect_list(F.struct("anchor", "place")).alias("a"))  # no more than a document has

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "doc", "part", "place", "before", "around"]
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                found = b.column(3)[i].values
                at = found.field("place").to_numpy(zero_copy_only=False)
                low = np.maximum(0, at - (window - anchor))
                near = [data[x:y] for x, y in zip(low.tolist(), (at + window).tolist(), strict=True)]
                cols = [found.field("anchor"), pa.array([b.column(0)[i].as_py()] * len(at), pa.int64()), pa.array([b.column(1)[i].as_py()] * len(at), pa.int64()), pa.array(at), pa.array(at - low), pa.array(near, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    near = map_texts(docs.join(per_doc, ["doc", "part"]).select("doc", "part", "text", "a"), fetch, "anchor long, doc long, part long, place long, before long, around binary")
    crowded = cut(opened.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor"), "crowded")
    some = not crowded.isEmpty()
    if some:
        near = cut(near, "surroundings")
    usual = near.join(crowded, "anchor", "left_anti") if some else near
    usual = usual.repartition("anchor").sortWithinPartitions("anchor", "doc")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, held = Prefixes(), []

        def flush(rows: pa.Table):
            part = rows.column("part").to_numpy()
            a, d, p, left = (rows.column(c).to_numpy() for c in ("anchor", "doc", "place", "before"))
            # place and part travel together, as one number
            out = covered_in_groups(a, d, p + (part << 40), left, rows.column("around").to_pylist(), prefixes, window, anchor)
            if len(out[0]):
                doc, low, high, at = out
                base = (at >> 40) << 40
                return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at >> 40), pa.array(low - base), pa.array(high - base)], names=["doc", "part", "begin", "end"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BUFFER:
                rows = pa.Table.from_batches(held)
                a = rows.column("anchor").to_numpy()
                whole = int(np.searchsorted(a, a[-1]))  # the last group may go on
                if whole:
                    if out := flush(rows.slice(0, whole)):
                        yield out
                    held = rows.slice(whole).to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows and (out := flush(rows)):
            yield out

    found = covered.unionByName(usual.mapInArrow(resolve, "doc long, part long, begin long, end long"))
    if some:
        windows = near.join(crowded, "anchor", "left_semi").withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(window - anchor))))
        windows = windows.filter((F.col("offset") <= F.col("before")) & (F.octet_length("around") - F.col("before") + F.col("offset") >= window))
        windows = windows.select("anchor", "doc", "part", "place", "offset", F.expr(f"substring(around, cast(before - offset + 1 as int), {window})").alias("bytes"))
        first = windows.groupBy("anchor", "offset", "bytes").agg(F.min("doc").alias("least"))
        hit = windows.join(first, ["anchor", "offset", "bytes"]).filter("doc > least")
        spans = hit.groupBy("anchor", "doc", "part", "place").agg(F.min(F.col("place") - F.col("offset")).alias("begin"), F.max(F.col("place") - F.col("offset") + window).alias("end"))
        found = found.unionByName(spans.select("doc", "part", "begin", "end"))
    return found


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin, end of each maximal removed run), kept (the bytes that
    stay): a row per row of docs(doc_id, text, ...).

    Texts are their UTF-8 bytes, null is empty; matches lie within one document each. Windows are judged on the input, so a
    text that a smaller doc_id also holds goes whole if it has window bytes or more, and a shorter one stays. Rows that share
    a doc_id do not count for each other; a null doc_id is the smallest. An empty table gives no rows; other columns are
    ignored."""
    rows = _numbered(docs)
    spans = repeated_spans(rows, window, anchor, hot).groupBy("doc", "part").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = rows.join(spans, ["doc", "part"], "left").select("doc", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out = []
            for doc, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                runs = merged([(s["begin"], s["end"]) for s in found or ()], len(data))
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"begin": x, "end": y} for x, y in runs], kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pair, pa.binary())
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names) if out else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)

    out = map_texts(joined, remove, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:bigint,end:bigint>>, kept binary")
    return out.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
