"""Sum-of-squares packing of tokenized documents into sequences of fixed length.

A piece goes where the sum over gaps g of (open bins with gap g)**2 becomes smallest: into an open bin it fits in, or
into a new one. Pieces are dealt to groups by a hash, and each group is packed by itself in one task; a group has some
ten thousand pieces whatever the size of the corpus, so the loss at the groups' ends is a fixed small share.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts

CAPACITY = 2048
GROUP_PIECES = 40_000
END_ID = 0
#: Longer words go through the tokenizer itself, whose time does not grow with the square of a word.
LONG_WORD = 1_000

# In texts of these characters alone, splitting into the tokenizer's words needs no normalisation but lower case, and
# the pattern of the tokenizer means the same in the re module. Other texts go through the tokenizer whole.
_OTHER = re.compile("[^\x20-\x7e\t\n\r\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: printable bytes as themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """The ids of a text as bytes, little-endian unsigned 32-bit.

    Words are merged by a second encoder of the same vocabulary, without normalisation, patterns and offsets: it reads words
    that a zero byte ends, and the tokens that end a word end with that byte."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary, byte_of, last = self.tokenizer.get_vocab(), _byte_of(), "</w>"
        ranks = {bytes([b]): b for b in range(256)}
        self.ids = np.zeros(256 + max(vocabulary.values()) + 1, "<u4")
        for token, i in sorted(vocabulary.items(), key=lambda x: x[1]):
            if not token.startswith("<|"):
                data = bytes(byte_of[c] for c in token.removesuffix(last)) + b"\0" * token.endswith(last)
                ranks.setdefault(data, 256 + i)
                self.ids[ranks[data]] = i
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if _OTHER.search(text) or "<|" in text:
            return self.whole(text)
        words = _WORDS.findall(text.lower())
        if not words:
            return b""
        if max(map(len, words)) > LONG_WORD:
            return self.whole(text)
        return self.ids[self.merger.encode_to_numpy("\0".join(words) + "\0", disallowed_special=())].tobytes()


def cut_pieces(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int]]:
    """start, length, crc32 of each piece of a document's ids."""
    for at in range(0, len(ids), 4 * capacity):
        part = ids[at : at + 4 * capacity]
        yield at // 4, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of docs(doc_id, text): null text is empty; each document ends with end_id."""
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                doc, out = part.column(0).to_pylist(), []
                for i, text in zip(doc, part.column(1).to_pylist(), strict=True):
                    out += [(i, k, *p) for k, p in enumerate(cut_pieces(encoder(text or "") + end, capacity))]
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return map_texts(rows, encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each length, in the order given.

    Filling a bin of gap g with s changes the sum by 2 (open[g - s] - open[g] + 1), or 1 - 2 open[g] if it is then
    full; a new bin by 2 open[capacity - s] + 1. Of equal changes the smallest gap wins, a new bin last."""
    opened = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    change = np.empty(capacity + 1, np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        view = change[: capacity - s]  # gaps s to capacity - 1
        np.subtract(opened[: capacity - s], opened[s:capacity], out=view)
        view += 1
        view *= 2
        if len(view):
            view[0] = 1 - 2 * opened[s]
            view[opened[s:capacity] == 0] = never
            g = int(view.argmin())
            best = int(view[g])
            g += s
        else:
            best, g = never, capacity
        if best > (2 * int(opened[capacity - s]) + 1 if s < capacity else 0):
            b, g, n = n, capacity, n + 1
        else:
            b = stacks[g].pop()
            opened[g] -= 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            stacks[g - s].append(b)
            opened[g - s] += 1
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """parts(doc_id, piece, length, ...) with sequence_id and offset. Each part has 1 to capacity tokens.

    Longer pieces come first within a group; ties go by doc_id and piece, null first. Parts that repeat a doc_id and piece are
    parts of their own. A group goes through Arrow, so ids of any size, and null ones, come out as they went in. No parts, no rows."""
    groups = max(1, -(-parts.count() // group_pieces))
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")

    def one(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")], null_placement="at_start")
        rows = rows.take(order)
        b, o = sum_of_squares(rows.column("length").to_numpy(), capacity)
        group = rows.column("_group")[0].as_py()
        return rows.drop_columns(["_group"]).append_column("sequence_id", pa.array(b + (group << 32))).append_column("offset", pa.array(o))

    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(one, schema)


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece of docs(doc_id, text, ...).

    Documents longer than capacity are cut into pieces of capacity tokens, the last may be shorter; no other document is
    cut. Null and empty texts are one end_id. Rows that repeat a doc_id are documents of their own, also where it is null; an empty
    table gives no rows; other columns are ignored. Sequences hold pieces of similar rank by length, not neighbours in the
    table: an order of documents decides which are packed, not where. Offsets within a sequence are gapless from 0."""
    return pack(cut(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity, group_pieces)
