"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection. numpy only.

A text's vector is the mean of the embeddings of its character n-grams, which are hashed to buckets; a linear softmax
over it gives the languages. Embeddings and softmax are trained together by stochastic gradient descent on short pieces
of labelled documents. As the softmax is linear, each bucket's share of the logits is a row of a small table, and a
whole text is scored by summing rows. A temperature fitted on held-back pieces calibrates the probabilities, and a
threshold, the probability that all but a small share of them exceed, tells when to reject.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: The bound of what is learned from, in labelled rows, and how many pieces a row gives, spread evenly over its whole text.
#: Nothing that is predicted is bounded.
FIT_ROWS = 4_000
FIT_PIECES = 12
BUCKETS, DIM = 1 << 16, 16
GRAMS = (1, 2, 3)
PIECE = 120
EPOCHS, MIN_STEPS, RATE = 4, 600, 0.5
REJECTED_SHARE = 0.01
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
CHUNK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def gram_buckets(codes: np.ndarray, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """For each length of n-grams: the bucket of the n-gram that begins at each position."""
    x = codes.astype(np.uint64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    h = np.zeros(len(x), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(x) < n:
            return
        h = (h[: len(x) - n + 1] + x[n - 1 :] + np.uint64(n)) * _ODD
        h ^= h >> np.uint64(29)
        if n in GRAMS:
            yield ((h * _ODD) >> shift).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): a bucket's share of the logits
    bias: np.ndarray
    temperature: float
    threshold: float


def spread(text: Column, pieces: int = FIT_PIECES, piece: int = PIECE) -> Column:
    """Pieces of a text from its beginning to its end, at equal distances; all of it where that is no more."""
    n = F.length(text)
    count = F.least(F.lit(pieces), F.greatest(F.lit(1), F.ceil(n / piece))).cast("int")
    step = F.greatest(n - piece, F.lit(0)) / F.greatest(count - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(piece)))


def _bags(pieces: list[str], labels: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    kept = [(p.strip(), y) for p, y in zip(pieces, labels, strict=True) if p.strip()]
    return [np.concatenate(list(gram_buckets(code_points(f" {p} ")))) for p, _ in kept], np.array([y for _, y in kept], np.int64)


def fit(pieces: list[str], langs: list[str], seed: int = 7) -> Model:
    """Trains on pieces of texts and their languages."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0)
    index = {x: i for i, x in enumerate(languages)}
    bags, y = _bags(pieces, [index[x] for x in langs])
    if not bags:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    back = rng.random(len(bags)) < 0.1
    if back.all() or not back.any():
        back[:] = False
    rows = np.flatnonzero(~back)
    size = 32
    share = np.bincount(y, minlength=len(languages)) / max(1, len(y))
    each, done = max(1, -(-len(rows) // size)), 0
    epochs = max(EPOCHS, -(-MIN_STEPS // each))
    steps = epochs * each
    for _ in range(epochs):
        rng.shuffle(rows)
        for k in range(0, len(rows), size):
            some = rows[k : k + size]
            flat = np.concatenate([bags[i] for i in some])
            n = np.array([len(bags[i]) for i in some])
            starts = np.r_[0, n[:-1]].cumsum()
            mean = np.add.reduceat(emb[flat], starts) / n[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= (1 / np.sqrt(np.maximum(share[y[some]] * len(languages), 1e-3)))[:, None] / len(some)  # rare languages count more
            rate = RATE * (1 - done / steps)
            done += 1
            back_prop = (p @ out.T) / n[:, None]
            out -= rate * mean.T @ p
            bias -= rate * p.sum(0)
            # The embedding of every n-gram of a piece moves alike. What moves one bucket is summed first, in the order of buckets.
            order = np.argsort(flat, kind="stable")
            moved = flat[order]
            turn = np.flatnonzero(np.r_[True, moved[1:] != moved[:-1]])
            steps_of = (rate * len(some) * back_prop).astype(np.float32)[np.repeat(np.arange(len(some)), n)[order]]
            emb[moved[turn]] -= np.add.reduceat(steps_of, turn)
    table = (emb @ out).astype(np.float32)
    judged = np.flatnonzero(back) if back.any() else np.arange(len(bags))
    z = np.array([table[bags[i]].mean(0) + bias for i in judged])
    temperature = min(np.geomspace(0.05, 5, 60), key=lambda t: _loss(z / t, y[judged]))
    sure = _softmax(z / temperature).max(1)
    return Model(languages, table, bias, float(temperature), float(np.quantile(sure, REJECTED_SHARE)))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.maximum(_softmax(z)[np.arange(len(y)), y], 1e-12)).mean())


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[bool]]:
    """language, probability and whether it is rejected, of whole texts: texts without any letter are UNKNOWN, probability 0.

    Texts are scored together in runs of CHUNK characters; longer ones in pieces that overlap by the longest n-gram."""
    n, width = len(texts), max(1, len(model.languages))
    sums, counts, letters = np.zeros((n, width)), np.zeros(n), np.zeros(n, bool)
    pending, owners, held = [], [], 0

    def flush() -> None:
        nonlocal pending, owners, held
        if not pending:
            return
        codes = np.concatenate(pending)
        lengths = np.array([len(p) for p in pending])
        begins = np.r_[0, lengths[:-1]].cumsum()
        owner = np.array(owners)
        for size, b in zip(range(1, max(GRAMS) + 1), gram_buckets(codes), strict=False):
            # n-grams that reach into the next text do not count
            valid = np.ones(len(b), bool)
            for k in range(1, size):
                ends = begins[1:] - k
                valid[ends[(ends >= 0) & (ends < len(b))]] = False
            for j in range(width):
                v = model.table[:, j][b]
                v[~valid] = 0
                total = np.r_[0.0, np.cumsum(v, dtype=np.float64)]
                ends = np.minimum(begins + lengths, len(b))
                np.add.at(sums[:, j], owner, total[ends] - total[np.minimum(begins, ends)])
            count = np.r_[0, np.cumsum(valid)]
            ends = np.minimum(begins + lengths, len(b))
            np.add.at(counts, owner, count[ends] - count[np.minimum(begins, ends)])
        pending, owners, held = [], [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        letters[i] = _has_letter(text)
        codes = code_points(text)
        for k in range(0, len(codes), CHUNK):
            part = codes[k : k + CHUNK + max(GRAMS) - 1]
            if held + len(part) > 2 * CHUNK:
                flush()
            pending.append(part)
            owners.append(i)
            held += len(part)
    flush()
    p = _softmax((sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature)
    best = p.argmax(1)
    known = letters & bool(model.languages)
    sure = np.where(known, p[np.arange(n), best], 0.0) if n else np.zeros(0)
    langs = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
    return langs, sure.tolist(), (~known | (sure < model.threshold)).tolist()


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:]))


def fold(doc_id):
    """crc32 of doc_id as text, mod FOLDS."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits on at most rows documents with a language outside the held-out fold, of about the smallest hashes of doc_id.

    Ids are thinned by their hash to about twice as many before they meet on the driver, so that what tasks send there is
    bounded whatever their number; texts follow for the chosen ids alone."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null").filter(fold(F.col("doc_id")) != HELD_OUT)
    ids = known.select("doc_id", F.xxhash64("doc_id").alias("_at"))
    share = min(1.0, 2.0 * rows / max(1, ids.count()))
    ids = ids.filter(F.shiftrightunsigned("_at", 33) <= int(share * (1 << 31)))
    chosen = ids.orderBy("_at", "doc_id").limit(rows).select("doc_id").distinct()
    # rows rows at most: this broadcast does not grow with the data.
    sample = known.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", spread(F.col("text")).alias("pieces"))
    sample = sample.orderBy("doc_id", "lang", "pieces").limit(2 * rows).collect()
    return fit([p for r in sample for p in r.pieces], [r.lang for r in sample for _ in r.pieces])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected: a row per row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, sure, rejected = predict(b.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def languages(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: a row per row of docs(doc_id, text, lang, ...).

    lang_pred is a learned language, whatever its score, or und where the text is null or has no letter, or where
    nothing could be learned; rejected tells where the calibrated score is too low to rely on. A null doc_id is in no
    fold (held_out false); rows that repeat are predicted alike; an empty table gives no rows; other columns are ignored."""
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return identify(docs, train(docs, rows)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
