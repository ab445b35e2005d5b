"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of word n-grams, held as 64-bit hashes. Two sets whose Jaccard similarity reaches the threshold
differ in a number of elements that their sizes bound. Sizes are cut into bands; each band parts the domain of elements into
so many first-level parts that sets that are similar enough differ by at most one element in slack + 1 of them, and each
of those into three second-level parts. A signature is the hash of the elements in two of the three: one element that
differs leaves two of them equal, so sets that are similar enough share slack + 1 signatures. A set signs for its own band
and for the bands above that hold sets it can be similar to; as sets of smaller size differ by less, they sign fewer parts.
A signature of one frequent element would say little, so a set does not sign the subsets with the fewest elements, as far as
these are in no more than slack of its parts: of slack + 1 parts that agree, one is left, and as subsets that agree are of one size,
the set that asks for more elements decides for both.

Sets that are equal are one class, found by grouping. Of classes that share a signature:

1. each is compared with the smallest; what that links is one component, so a large group of near copies costs one
   comparison for each of its members;
2. those that still share a signature across components are compared with one that a hash chooses for each signature;
3. those outside the most frequent component of a signature are compared with all of other components in it.

Each time, a bound from sizes and parity bits, two for each element, goes before the comparison of the sets, and no link between different
texts is lost. Texts that are a little too different share many signatures: of signatures that the same classes have, one is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, release
from .graph import components, joined
from .hashing import WordHasher, mix, shingle_hashes

SHINGLE, PERCENT = 5, 80
CHUNK = 1 << 20
#: 64-bit words of parity bits, at least and at most: two bits for each element between.
PARITY, MOST_PARITY = 8, 1024
#: First-level parts beyond those that links need, as a share of the elements that may differ.
SLACK = 0.08
#: The pairs of second-level parts of a first-level part.
_PAIRS = ((0, 1), (0, 2), (1, 2))


class Signer:
    """Signatures of a set for a threshold of percent / 100."""

    def __init__(self, percent: int, slack: float = SLACK):
        self.slack = slack
        self.p, self.q = 100 - percent, 100 + percent
        self.percent = percent
        self.least = [1, 2]  # the smallest size of each band

    def _bands(self, size: int) -> None:
        while self.least[-1] <= size:
            low = self.least[-1]
            self.least.append(int(low * (1.3 if low < 100 else 1.6)) + 1)

    def instances(self, n: int) -> Iterator[tuple[int, int, int, int]]:
        """band, its number of first-level parts, the number of them that a set of n elements signs, slack."""
        most = n * 100 // self.percent  # the largest size that is similar enough
        self._bands(2 * most + 2)
        i = int(np.searchsorted(self.least, n, "right")) - 1
        while self.least[i] <= most:
            top = self.least[i + 1] - 1
            differ = (n + min(most, top)) * self.p // self.q
            if differ:  # else only equal sets are similar enough, and they are one class
                bound = 2 * top * self.p // self.q
                slack = int(bound * self.slack)
                # At most differ // 2 of the parts signed hold two elements or more that differ.
                yield i, bound // 2 + 1 + slack, differ // 2 + 1 + slack, slack
            i += 1

    def sign(self, u: np.ndarray) -> np.ndarray:
        """Of a sorted array of distinct hashes."""
        sums = np.zeros(len(u) + 1, np.uint64)
        np.cumsum(mix(u), out=sums[1:])
        high = u >> np.uint64(32)
        out = []
        for band, parts, signed, slack in self.instances(len(u)):
            # Second-level part j holds the hashes whose upper half is in the j-th of equal ranges: a stretch of the sorted array.
            edges = (np.arange(3 * signed + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(3 * parts)
            at = np.searchsorted(high, edges)
            held = np.diff(at).reshape(signed, 3)
            cells = mix((sums[at[1:]] - sums[at[:-1]]).reshape(signed, 3) + held.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
            part = np.arange(signed, dtype=np.uint64) * np.uint64(4) + np.uint64(band << 32)
            elements = np.stack([held[:, a] + held[:, b] for a, b in _PAIRS], 1)
            signatures = np.stack([mix(mix(cells[:, a] + mix(part + np.uint64(k))) + cells[:, b]) for k, (a, b) in enumerate(_PAIRS)], 1)
            # No more than slack parts have a subset of fewer elements than this.
            least = np.partition(elements.min(1), slack)[slack]
            out.append(signatures[elements >= least])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _texts(texts: list[str | None]) -> Iterator[tuple[int, int, bytes]]:
    """Runs of whole texts of about CHUNK bytes, joined by spaces: first, one past the last, the bytes in lower case."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A to Z only
        if held and size + len(b) > CHUNK:
            yield first, i, b" ".join(held)
            held, size, first = [], 0, i
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, first + len(held), b" ".join(held)


def shingle_sets(texts: list[str | None], size: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, last, data in _texts(texts):
        lengths = np.array([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts[first:last]])
        begins = np.r_[0, lengths.cumsum()]
        at, words = hasher(data)
        cuts = np.searchsorted(at, begins)
        every = shingle_hashes(words, size) if len(words) >= size else None
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield np.unique(every[a : b - size + 1] if b - a >= size else shingle_hashes(words[a:b], size))


def parity(u: np.ndarray) -> np.ndarray:
    """For each value of the lowest bits, whether an odd number of elements has it. Two sets differ in at least as many elements
    as their parities differ in bits. Sets of similar sizes have as many bits, or one twice as many as the other."""
    size = 64 * min(MOST_PARITY, max(PARITY, 1 << (len(u) * 2 // 64).bit_length()))
    return np.packbits(np.bincount((u & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).view(np.int64)


_SET = "doc_id long, n_shingles long, h1 long, h2 long, parity array<long>, signatures array<long>"


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def signed_sets(docs: DataFrame, size: int, percent: int, slack: float = SLACK) -> DataFrame:
    """Of each row: its set's size, 128-bit hash and parity, and its signatures; equal sets of one batch sign once. Rows with a null doc_id, which are linked with nothing, do not sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, signer = WordHasher(), Signer(percent, slack)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows, parities, signatures, done = [], [], [], set()
                named = part.column(0).is_valid().to_pylist()
                for has_id, u in zip(named, shingle_sets(part.column(1).to_pylist(), size, hasher), strict=True):
                    h1 = int(mix(u).sum(dtype=np.uint64).astype(np.int64)) if len(u) else 0
                    h2 = int(mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) if len(u) else 0
                    signs = has_id and len(u) and (h1, h2) not in done
                    rows.append((len(u), h1, h2))
                    parities.append(parity(u))
                    signatures.append(signer.sign(u).view(np.int64) if signs else np.zeros(0, np.int64))
                    if has_id:
                        done.add((h1, h2))
                cols = [part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), _lists(parities), _lists(signatures)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "h1", "h2", "parity", "signatures"])

    return map_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), run, _SET)


def _similar_enough(percent: int) -> str:
    """Of a row with sizes a_n, b_n and parities: whether the bounds allow the pair."""
    half = lambda x: f"zip_with(slice({x}, 1, cast(size({x}) div 2 as int)), slice({x}, cast(size({x}) div 2 as int) + 1, size({x})), (p, q) -> p ^ q)"
    same = lambda x, y: f"if(size({x}) > size({y}), {half(x)}, {x})"
    differ = f"aggregate(zip_with({same('a_parity', 'b_parity')}, {same('b_parity', 'a_parity')}, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)"
    return f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) and {differ} * {100 + percent} <= (a_n + b_n) * {100 - percent}"


def _hashes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, elements: the sorted shingle hashes of each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                sets = list(shingle_sets(part.column(1).to_pylist(), size, hasher))
                ends = pa.array(np.r_[0, np.cumsum([len(u) for u in sets])].astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], names=["doc_id", "elements"])

    return map_texts(docs, run, "doc_id long, elements array<long>")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """u, v: those of pairs(a, b) of doc_ids whose texts' sets reach the threshold. The sets of documents in a pair, and no others,
    are computed again from their whole texts, once."""
    pairs = cut(pairs, "pairs")
    # In order, ids take little room: Spark broadcasts them if that is small enough, and texts stay where they are.
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().orderBy("doc_id"), "ids")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    sets = cut(_hashes(texts.join(ids, "doc_id", "left_semi"), size).filter("size(elements) > 0"), "elements")
    rows = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").withColumn("both", F.size(F.array_intersect("x", "y")))
    links = cut(rows.filter(f"100 * both >= {percent} * (size(x) + size(y) - both)").select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    release(pairs, ids, sets)
    return links


def _apart(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """signature, class_id, component of those rows of shared(signature, class_id) whose signature is in several components."""
    rows = shared.select("signature", "class_id").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    rows = rows.select("signature", "class_id", F.coalesce("component", "class_id").alias("component"))
    mixed = rows.groupBy("signature").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
    return cut(rows.join(mixed.select("signature"), "signature", "left_semi"), "apart")


def _unlike(shared: DataFrame) -> DataFrame:
    """shared(signature, class_id, ...) with one of the signatures that have the same classes, told by 128 bits and their number: the others would
    give the same pairs."""
    of = [F.bit_xor(F.xxhash64("class_id", F.lit(k))).alias(f"x{k}") for k in range(2)]
    groups = shared.groupBy("signature").agg(F.count("*").alias("n"), *of).groupBy("n", "x0", "x1").agg(F.min("signature").alias("signature"))
    return shared.join(groups.select("signature"), "signature", "left_semi")


def jaccard_links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, slack: float = SLACK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sets(doc_id, n_shingles, h1, h2, ...), classes(n_shingles, h1, h2, class_id, ...) and labels(node, component) of classes.

    Classes are equal sets, class_id the smallest doc_id. The components are those that links between all pairs of classes
    make: of pairs that share a signature, those are compared that other links have not put into one component."""
    signed = cut(signed_sets(docs, size, percent, slack), "signed")
    sets = cut(signed.select("doc_id", "n_shingles", "h1", "h2"), "sets")
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(known.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("class_id"), F.first("parity").alias("parity")), "classes")
    # Signatures meet by the rows that signed, of which a class has one for each batch that holds it; only those that meet are
    # told their class.
    exploded = known.select(F.col("doc_id").alias("row_id"), F.explode("signatures").alias("signature")).repartition("signature")
    several = exploded.groupBy("signature").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last")).filter("first <> last")
    met = cut(exploded.join(several.select("signature").hint("shuffle_hash"), "signature"), "met")
    signers = known.filter("size(signatures) > 0").select(F.col("doc_id").alias("row_id"), "n_shingles", "h1", "h2")
    signers = cut(signers.join(classes.select("n_shingles", "h1", "h2", "class_id"), ["n_shingles", "h1", "h2"]).select("row_id", "class_id"), "signers")
    release(signed)
    placed = met.join(signers, "row_id").select("signature", "class_id").distinct()
    several = placed.groupBy("signature").agg(F.min("class_id").alias("leader"), F.max("class_id").alias("last")).filter("leader <> last")
    shared = cut(placed.join(several.select("signature", "leader"), "signature"), "shared")
    release(met, signers)
    about = classes.select("class_id", F.col("n_shingles").alias("n"), "parity")
    side = lambda x: about.toDF(x, f"{x}_n", f"{x}_parity")
    bounded = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").filter(_similar_enough(percent)).select("a", "b").distinct()
    stars = shared.filter("leader <> class_id").select(F.col("leader").alias("a"), F.col("class_id").alias("b")).distinct()
    links = verified(bounded(stars), docs, size, percent)
    labels = components(links)
    apart = _apart(shared, labels)
    release(shared, links)
    if apart.isEmpty():
        return sets, classes, labels
    chosen = apart.groupBy("signature").agg(F.min(F.struct(F.xxhash64("class_id", "signature").alias("h"), "class_id", "component")).alias("l"))
    stars = apart.join(chosen, "signature").filter("component <> l.component")
    stars = stars.select(F.least("class_id", "l.class_id").alias("a"), F.greatest("class_id", "l.class_id").alias("b")).distinct()
    links = verified(bounded(stars), docs, size, percent)
    labels = joined(labels, links)
    left = _apart(apart, labels)
    release(apart, links)
    if left.isEmpty():
        return sets, classes, labels
    rest = cut(_unlike(left), "rest")
    release(left)
    per = rest.groupBy("signature", "component").agg(F.count("*").alias("n"))
    most = per.groupBy("signature").agg(F.max(F.struct("n", "component")).alias("m")).select("signature", F.col("m.component").alias("most"))
    placed = cut(rest.join(most, "signature").join(about, "class_id").withColumn("minor", F.col("component") != F.col("most")).drop("most"), "placed")
    one = lambda x: placed.select("signature", *[F.col(c).alias(f"{x}_{c}") for c in ("class_id", "component", "minor", "n", "parity")])
    pairs = one("a").filter("a_minor").join(one("b"), "signature").filter(f"a_component <> b_component and (not b_minor or a_class_id < b_class_id) and {_similar_enough(percent)}")
    pairs = pairs.select(F.col("a_class_id").alias("a"), F.col("b_class_id").alias("b")).distinct()
    links = verified(pairs, docs, size, percent)
    labels = joined(labels, links)
    release(rest, placed, links)
    return sets, classes, labels


def jaccard_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of docs(doc_id, text, ...).

    Words are runs of characters other than white space, A to Z in lower case. A text of fewer than size words is one
    shingle; a null or empty text has none and is linked with nothing. component_id is the smallest doc_id that links
    lead to, itself included. Rows that repeat a doc_id are one document, linked with all that either is linked with; a
    null doc_id is linked with nothing, whatever its text, and has a null component_id. An empty table gives no rows; other columns are ignored."""
    sets, classes, found = jaccard_links(docs, size, percent)
    of_row = F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")
    members = sets.join(classes.select("n_shingles", "h1", "h2", "class_id"), ["n_shingles", "h1", "h2"], "left")
    members = cut(members.select("doc_id", "n_shingles", of_row), "members")
    release(sets)
    # A doc_id that is repeated with other texts joins their classes.
    ids = cut(members.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("class_id").alias("u")).filter("n > 1").select("doc_id", "u"), "repeated")
    if not ids.isEmpty():
        several = members.filter("class_id is not null").join(ids, "doc_id").select("u", F.col("class_id").alias("v"))
        met = members.filter("class_id is not null").join(ids.select("doc_id"), "doc_id", "left_semi")
        own = met.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v"))
        found = joined(found, several.unionByName(own).filter("u is not null and u <> v"))
    out = members.join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id"))
    if ids.isEmpty():
        return out
    # Of a repeated doc_id, a row without words takes the component of the others.
    least = out.join(ids.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("_least"))
    return out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_least", "component_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without the documents of a group but its smallest doc_id. Rows that repeat a doc_id stay or go together; rows whose doc_id
    is null, or that have no words, stay. An empty table gives no rows; extra columns are kept, whatever their names."""
    gone = cut(jaccard_groups(docs, size, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct().orderBy("_gone"), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
