"""The registered queries and their operators against plain versions."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestrata.llm import ego_join, exact_dedup, graph, langid, licenses, mixing, ngram_join, packing, queries, repeats, shards, toxicity

from . import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


def table(spark, rows, extra=True):
    """doc_id, text, lang, source of rows (doc_id, text[, source]), with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", s[0] if s else "s0", 1, 2.0, "x") for i, t, *s in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, score double, part string")


HARD = [
    (1, None),
    (2, ""),
    (3, " \t "),
    (4, "one"),
    (5, "one  two"),
    (6, "one two"),
    (7, "ONE two"),
    (8, "x" * 300_000),
    (9, "é" * 70 + " tail"),
    (10, "é" * 70 + " other"),
    (11, "Same words here and there again and again until the end of it"),
    (12, "Same words here and there again and again until the end of it"),
    (13, "same words here and there again and again until the end of IT"),
    (None, "Same words here and there again and again until the end of it"),
    (14, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40),
    (14, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40),
    (15, "日本語の文章。" * 30),
    (-5, "Same words here and there again and again until the end of it all"),
]


def test_jaccard_on_documents(spark, sf, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_ngram_jaccard(spark, sf).collect()}
    assert got == brute.jaccard_components(dict(zip(docs.doc_id, docs.text, strict=True)), 4, 85)


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_jaccard_on_near_copies(spark, percent):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60, 150]))]
        for _ in range(10):
            copy = [rng.choice(words) if rng.random() < 0.02 else w for w in text]
            rows.append((len(rows) * 7 % 331, " ".join(copy) + (" " + passage if rng.random() < 0.3 else "")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(table(spark, rows), 4, percent).collect()}
    assert got == brute.jaccard_components(dict(rows), 4, percent)


def test_jaccard_hard_rows(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(table(spark, HARD), 4, 85).collect()]
    assert len(got) == len(HARD)
    by = {i: (n, c) for i, n, c in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4)
    assert by[6] == (1, 5) and by[7] == (1, 5)
    assert by[12] == by[13] == (10, -5) and by[-5][1] == -5
    assert by[None] == (10, None)  # linked with nothing, though its text is that of 11
    kept = ngram_join.one_of_each_group(table(spark, HARD), 4, 85)
    assert kept.columns == table(spark, HARD).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, -5, 1, 2, 3, 4, 5, 8, 9, 10, 14, 14, 15], key=str)
    assert ngram_join.jaccard_groups(table(spark, HARD).filter("false")).count() == 0


def test_jaccard_null_id_before_equal_text(spark):
    text = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(text)), (1, " ".join(text)), (2, " ".join([*text, "tail"])), (None, " ".join(text)), (3, " ".join(text))]
    got = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_groups(table(spark, rows).coalesce(1), 4, 85).collect()}
    assert got >= {(1, 1), (2, 1), (3, 1)}


def test_jaccard_repeated_ids(spark):
    near = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(near)), (9, " ".join([*near, "tail"])), (9, "something else that is much shorter than it"), (7, "something else that is much shorter than it"), (5, ""), (5, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(table(spark, rows), 4, 85).collect()}
    assert got == {(5, 57, 5), (5, 0, 5), (9, 58, 5), (9, 5, 5), (7, 5, 5)}


def test_jaccard_group_without_a_centre(spark):
    """Chains of near copies, where few are similar to the smallest: every step is needed to find the links."""
    rng = random.Random(12)
    text = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = []
    for i in range(150):
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
        rows.append((i * 53 % 1009, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(table(spark, rows), 4, 85).collect()}
    want = brute.jaccard_components(dict(rows), 4, 85)
    assert got == want and 1 < len({c for _, c in want.values()}) < 150


def test_common_passages_alone_make_no_pairs(spark):
    """Documents that share passages and little else sign next to nothing in common."""
    rng = random.Random(3)
    passages = [" ".join(f"p{k}x{i}" for i in range(60)) for k in range(5)]
    rows = [(i, " ".join([" ".join(f"u{rng.randrange(10**7)}" for _ in range(700)), *rng.sample(passages, 2)])) for i in range(300)]
    signed = ngram_join.signed_sets(table(spark, rows), 5, 80).collect()
    held = defaultdict(int)
    for r in signed:
        for x in set(r.signatures):
            held[x] += 1
    # All pairs would be 44,850; these count once for each signature that they share.
    assert sum(n * (n - 1) // 2 for n in held.values()) < 4_485


def test_signatures_are_complete():
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        signer = ngram_join.Signer(percent)
        for n in [*range(1, 60), 100, 333, 700]:
            u = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            for drop in range(0, n * (100 - percent) // 100 + 1, max(1, n // 12)):
                for add in range(0, n * (100 - percent) // 100 + 1, max(1, n // 12)):
                    a, b = np.unique(u[:n]), np.unique(np.r_[u[drop:n], u[n : n + add]])
                    both = len(np.intersect1d(a, b))
                    if drop + add and 100 * both >= percent * (len(a) + len(b) - both):
                        assert len(np.intersect1d(signer.sign(a), signer.sign(b)))


def ego_brute(ids, vectors, labels, cosine):
    ok = [v is not None and len(v) > 0 and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for v, l in zip(vectors, labels, strict=True)]
    links, n = [], defaultdict(int)
    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                    links.append((ids[i], ids[j]))
                    n[i] += 1
                    n[j] += 1
    root = brute.smallest_reachable(ids, links)
    return {i: (n[k], root[i], root[i] == i) for k, i in enumerate(ids)}


def test_ego_join_on_embeddings(spark, sf):
    p = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op2_ego_join(spark, sf).collect()}
    assert got == ego_brute(p.vec_id.tolist(), p.embedding.tolist(), p.label.tolist(), 0.98)


def test_ego_join_hard_rows(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + 0.08 * rng.normal(size=8)).tolist(), i % 2 if i % 11 else None) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)] + [(2000 + i, [2 * x for x in rows[1][1]], 1) for i in range(3)]
    rows += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * 8, 0), (3003, [float("nan")] + [1.0] * 7, 0), (3004, [None] + [1.0] * 7, 0), (3005, [float("inf")] + [1.0] * 7, 0), (3006, [1.0, 2.0], 0), (3007, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ego_join.near_duplicates(df, 0.98, interval=64).collect()}
    assert got == ego_brute([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], 0.98)
    assert ego_join.near_duplicates(df.filter("false")).count() == 0


def test_ego_join_repeated_and_null_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 0, "x"), (None, a, 0, "x"), (1, b, 0, "x"), (2, b, 0, "x"), (2, None, 0, "x"), (3, c, 0, "x"), (4, [0.0, 1e-3, 1.0], 0, "x"), (None, None, 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, class_id string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in ego_join.near_duplicates(df, 0.98).collect())
    assert got == sorted([("1", 1, "None"), ("None", 1, "None"), ("1", 1, "None"), ("2", 1, "None"), ("2", 0, "None"), ("3", 1, "3"), ("4", 1, "3"), ("None", 0, "None")])


def test_near_intervals_by_levels(spark):
    rng = np.random.default_rng(8)
    low = rng.random((300, 3)) * 4
    rows = [(i, int(i >= 200), 3, low[i].tolist(), (low[i] + rng.random(3) * 0.3).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "interval long, label int, dim int, low array<double>, high array<double>")
    got = sorted((r.a, r.b) for r in ego_join.near_pairs(df, 0.98, leading=3, fanout=4).collect())
    epsilon = math.sqrt(2 - 2 * 0.98) + ego_join.MARGIN

    def near(x, y):
        gap = [max(0, x[3][k] - y[4][k], y[3][k] - x[4][k]) for k in range(3)]
        return x[1] == y[1] and sum(g * g for g in gap) <= epsilon**2

    assert got == [(i, j) for i in range(300) for j in range(i, 300) if near(rows[i], rows[j])]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = brute.smallest_reachable({x for e in edges for x in e}, edges)
    assert got == {i: r for i, r in root.items() if i != r}


def test_toxicity(spark, sf, docs):
    got = queries.op3_toxicity(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()


def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet").toPandas()
    got = queries.op3_toxicity(spark, path).toPandas().merge(labels, on="doc_id")
    got = got[got.held_out]
    assert ((got.predicted == 1) == (got.toxic == 1)).mean() > 0.93


def test_toxicity_misspelled_and_quoted(spark):
    words = [f"filler{i}" for i in range(50)]
    rng = random.Random(1)
    say = lambda *extra: " ".join([*(rng.choice(words) for _ in range(30)), *extra])
    rows = [(i, say("imbecile", "you", "imbecile") if i % 4 == 0 else say()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    test = [(1000, say("imbecille", "imbecile", "imbecyle")), (1001, say()), (1002, None), (1003, "")]
    out = {r.doc_id: r for r in toxicity.score(table(spark, test), toxicity.train(table(spark, rows), labels)).collect()}
    assert out[1000].score > 0.5 > out[1001].score and out[1002].score == out[1003].score < 0.5
    assert [(h.word, h.edits) for h in out[1000].hits] == [("imbecille", 1), ("imbecile", 0), ("imbecyle", 1)]
    matcher = toxicity.Matcher(toxicity.LexiconAutomaton({"imbecile": 5.0}))
    long = 'they wrote "' + "a " * 900 + "imbecile " + "b " * 900 + '" at last imbecile ' + "c " * 20 + '" imbecile'
    assert [s[-1] for s in toxicity.spans(long, matcher)] == [True, False, False]  # closed far away, outside, never closed
    assert [s[-1] for s in toxicity.spans('they said "imbecile" . a b c d e f g h imbecile', matcher)] == [True, False]


def test_lexicon_of_texts_with_a_common_header():
    header = "This message was posted to the public forum and archived by the moderators. " * 2
    clean = [header + f"filler{i} and more" for i in range(40)]
    toxic = [header + f"filler{i} imbecile" for i in range(10)]
    assert "imbecile" in toxicity.learn_lexicon(clean + toxic, [0] * 40 + [1] * 10)
    # Copies of one text are still one.
    assert not toxicity.learn_lexicon(clean + toxic[:1] * 10, [0] * 40 + [1] * 10)


def test_lexicon_has_no_largest_size():
    """Each of 700 terms is in the toxic texts as often as any other, and all are learned."""
    terms = ["".join(chr(97 + (k // 26**j) % 26) for j in range(3)) + "qx" for k in range(700)]
    toxic = [" ".join(terms[(i * 70 + j) % 700] for j in range(140)) + f" u{i}" for i in range(60)]
    clean = [f"filler{i} and more" for i in range(300)]
    lexicon = toxicity.learn_lexicon(clean + toxic, [0] * 300 + [1] * 60)
    automaton = toxicity.LexiconAutomaton(lexicon)
    assert len(lexicon) > 512 and all(automaton.match(t)[0] for t in terms)


def test_toxicity_hard_rows(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (14, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(table(spark, HARD), labels).collect()
    assert len(out) == len(HARD) and all(0 <= r.score <= 1 for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert len({(r.score, r.predicted) for r in out if r.doc_id == 14}) == 1
    assert toxicity.toxicity(table(spark, HARD).filter("false"), labels).count() == 0
    assert toxicity.toxicity(table(spark, HARD), labels.filter("false")).filter("predicted = 1").count() == 0
    kept = toxicity.without_toxic(table(spark, HARD), labels.filter("false"))
    assert kept.columns == table(spark, HARD).columns and kept.count() == len(HARD)


def test_automaton_is_levenshtein():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *row[1:]] if False else [i] + [0] * len(b) if not b else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
        return out

    lexicon = {"abcab": 5.0, "bbacc": 4.5, "cabcab": 6.0, "aabb": 5.0}
    automaton = toxicity.LexiconAutomaton(lexicon)
    rng = random.Random(4)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(3, 8)))
        exact = w in lexicon
        near = any(distance(w, e) == 1 and len(e) >= toxicity.FUZZY for e in lexicon)
        weight, edits = automaton.match(w)
        assert (weight > 0, edits) == ((True, 0) if exact else (True, 1) if near else (False, 0)), w


def test_languages(spark, docs):
    path = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").toPandas()
    got = queries.op6_langid(spark, path).toPandas().merge(truth, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    got = got[got.held_out]
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_languages_hard_rows(spark):
    rows = [("the cat and the dog were here", "en"), ("le chat et le chien sont ici", "fr"), ("der hund und die katze sind hier", "de")] * 40
    model = langid.fit([r[0] for r in rows], [r[1] for r in rows])
    texts = [None, "", "123 !!", "the dog and the cat " * 200_000, "le chien et le chat"]
    langs, score, rejected = langid.predict(texts, model)
    assert langs == ["und", "und", "und", "en", "fr"] and score[:3] == [0, 0, 0] and rejected[:3] == [True] * 3
    alone = [langid.predict([t], model) for t in texts]
    assert [a[0][0] for a in alone] == langs and np.allclose([a[1][0] for a in alone], score)
    assert langid.predict(["text"], langid.fit([], []))[0] == ["und"]


def test_languages_are_learned_from_whole_texts(spark):
    """The first characters of all texts are alike; what tells the languages apart comes late."""
    rng = random.Random(5)
    words = {"en": "the cat and dog were here with some friends", "fr": "le chat et chien sont ici avec des amis"}
    rows = []
    for i in range(160):
        lang = ("en", "fr")[i % 2]
        text = "0123 4567 " * 400 + " ".join(rng.choice(words[lang].split()) for _ in range(1500))
        rows.append((i, text, lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert langid.predict(["the dog and the cat", "le chien et le chat"], model)[0] == ["en", "fr"]


def test_languages_hard_table(spark):
    df = table(spark, HARD)
    out = langid.languages(df).collect()
    assert len(out) == len(HARD) and all(0 <= r.score <= 1 for r in out)
    assert [(r.held_out, r.lang_pred) for r in out if r.doc_id is None] == [(False, "en")]
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"} and len({r.score for r in out if r.doc_id == 14}) == 1
    assert langid.languages(df.filter("false")).count() == 0


def test_repeats_on_documents(spark, sf, docs):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_suffix_dedup(spark, sf).collect()}
    assert got == brute.without_repeats(dict(zip(docs.doc_id, docs.text, strict=True)), 50)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats_on_small_alphabet(spark, hot):
    rng = random.Random(hot)
    lines = ["".join(rng.choice("ab") for _ in range(rng.randrange(20, 90))) for _ in range(12)]
    rows = [(i * 37 % 101, "".join(rng.choice(lines) if rng.random() < 0.7 else "".join(rng.choice("abé") for _ in range(30)) for _ in range(rng.randrange(0, 8)))) for i in range(101)]
    rows += [(200, None), (201, "z" * 200), (202, "z" * 120), (203, "z" * 49)]
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.without_repeats(table(spark, rows), hot=hot).collect()}
    assert got == brute.without_repeats(dict(rows), 50)


def test_repeats_hard_rows(spark):
    out = repeats.without_repeats(table(spark, HARD))
    rows = out.collect()
    assert len(rows) == len(HARD)
    by = {r.doc_id: r for r in rows if r.doc_id not in (14, None)}
    text = {i: t for i, t in HARD}
    for i, r in by.items():
        data = (text[i] or "").encode()
        edges = [0, *(x for s in r.spans for x in (s.begin, s.end)), len(data)]
        assert b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) == bytes(r.kept)
    assert by[11].n_removed == by[11].n_bytes and by[8].n_removed == 0 and by[10].n_removed == 141
    assert all(r.n_removed == 0 for r in rows if r.doc_id in (14, None))
    assert repeats.without_repeats(table(spark, HARD).filter("false")).count() == 0


def test_suffix_sort_with_colliding_hashes():
    class Weak(repeats.Prefixes):
        def between(self, sums, begin, end):
            return super().between(sums, begin, end) & np.uint64(1)

    rng = random.Random(0)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(600)), np.uint8)
    weak = Weak()
    start = np.arange(0, 500, 5)
    order, shared = repeats.sort_suffixes(data, weak.of(data), weak, start, np.zeros(len(start), np.int64), 8)
    texts = [data[start[i] : start[i] + 8].tobytes() for i in order]
    assert texts == sorted(texts)
    for i in range(1, len(texts)):
        assert shared[i] == next((k for k in range(8) if texts[i][k] != texts[i - 1][k]), 8)


def check_packing(rows, ids_of, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for r in rows:
        part = ids_of(r.doc_id)[r.start : r.start + r.length]
        assert r.start == r.piece * capacity and len(part) == r.length and 0 < r.length <= capacity
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
    return len(by)


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    rows = queries.op8_sum_of_squares(spark, sf).collect()
    n = check_packing(rows, ids.__getitem__, 2048)
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert n <= 1.02 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_packing_hard_rows(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = [(1, None), (2, ""), (3, "It's ΣΑΣ İ ﬁ ½ x² don't <|endoftext|> “quoted” ǅ"), (4, "a'b''s !!? 12é ß\x0b\x1c x"), (5, "word " * 5000), (6, "é Ñ")]
    rows = packing.packed(table(spark, texts), queries.tokenizer_path(), capacity=16, group_pieces=100).collect()
    text = dict(texts)
    check_packing(rows, lambda i: [*tokenizer.encode(text[i] or "", add_special_tokens=False).ids, 0], 16)
    assert packing.packed(table(spark, texts).filter("false"), queries.tokenizer_path()).count() == 0


def test_packing_null_and_large_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    big = (1 << 60) + 1
    texts = [(big, "a b c"), (None, "one two"), (None, None), (5, "x " * 40), (5, "x " * 40), (-(1 << 62) - 1, "")]
    rows = packing.packed(table(spark, texts), queries.tokenizer_path(), capacity=16).collect()
    assert {r.doc_id for r in rows} == {big, None, 5, -(1 << 62) - 1}
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert sum(r.length for r in rows) == total
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 16


def test_packing_in_groups(spark):
    """Each group is packed by the rule by itself, longest first."""
    rng = random.Random(4)
    parts = [(i, 0, rng.randrange(1, 65)) for i in range(500)]
    rows = packing.pack(spark.createDataFrame(parts, "doc_id long, piece int, length long"), capacity=64, group_pieces=120).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.sequence_id >> 32].append(r)
    assert len(groups) == 5 and sorted((r.doc_id, r.piece, r.length) for r in rows) == parts
    for mine in groups.values():
        mine.sort(key=lambda r: (-r.length, r.doc_id, r.piece))
        bins, offsets = packing.sum_of_squares(np.array([r.length for r in mine]), 64)
        assert [(r.sequence_id & 0xFFFFFFFF, r.offset) for r in mine] == list(zip(bins.tolist(), offsets.tolist(), strict=True))


def test_encoder_on_both_sides_of_long_words():
    encoder = packing.Encoder(queries.tokenizer_path())
    rng = random.Random(2)
    for n in (packing.LONG_WORD - 1, packing.LONG_WORD, packing.LONG_WORD + 1):
        word = "".join(rng.choice("abcdefgh") for _ in range(n))
        for text in (word, f"the {word} end", f"É {word}!", word.upper()):
            assert encoder(text) == encoder.whole(text)


def test_sum_of_squares_rule():
    rng = random.Random(6)
    capacity, lengths = 20, [rng.randrange(1, 21) for _ in range(300)]
    bins, offsets = packing.sum_of_squares(np.array(lengths), capacity)
    level, opened = defaultdict(int), defaultdict(int)
    for s, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        assert level[b] == o
        change = {}
        for g in [*[g for g in range(s, capacity) if opened[g]], capacity]:
            after = dict(opened)
            if g < capacity:
                after[g] -= 1
            if g > s:
                after[g - s] = after.get(g - s, 0) + 1
            change[g] = sum(x * x for x in after.values())
        assert change[capacity - o] == min(change.values())
        if o:
            opened[capacity - o] -= 1
        level[b] += s
        if capacity > level[b]:
            opened[capacity - level[b]] += 1


def test_exact_duplicates(spark, sf, docs):
    rows = [*zip(docs.doc_id, docs.text, strict=True), *((i, t) for i, t in HARD if i not in (14, None) and i >= 0)]
    rows = [(i + 10_000 * (k >= len(docs)), t) for k, (i, t) in enumerate(rows)]
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    want = {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    df = table(spark, rows)
    assert {r.doc_id: tuple(r)[1:] for r in exact_dedup.exact_duplicates(df).collect()} == want
    # A key that collides for most texts, and buckets that must split.
    from pyspark.sql import functions as F

    weak = F.length("norm").cast("long") % 7 * (1 << 59)
    for step in (3, 10):
        assert {r.doc_id: tuple(r)[1:] for r in exact_dedup.exact_duplicates(df, weak, capacity=2, step=step).collect()} == want
    index, narrow = exact_dedup.build_index(df, capacity=16, step=2)
    held = index.entries.groupBy("depth", "prefix").count().collect()
    assert all(r["count"] <= 16 for r in held) and len(held) > 8 and len({r.depth for r in held}) > 1
    assert index.directory.count() == len(held)
    # Rows find their entry through the directory alone: without one of its buckets, the rows of that bucket are not found.
    lost = held[0]
    wrong = exact_dedup.Index(index.directory.filter(~((F.col("depth") == lost.depth) & (F.col("prefix") == lost.prefix))), index.entries, index.chained)
    found = exact_dedup.probe(df, narrow, wrong).count()
    of_bucket = exact_dedup.located(narrow, index.directory).filter((F.col("depth") == lost.depth) & (F.col("prefix") == lost.prefix)).count()
    assert found == len(rows) - of_bucket < len(rows)


def test_directory_splits_at_any_depth(spark):
    """Keys that differ in their last bits alone, beyond any one pass; each bucket holds no more than its capacity."""
    keys = [(1 << 40) + i for i in range(40)] + [-(1 << 62) + (i << 50) for i in range(30)] + [7]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    directory = exact_dedup.directory_of(df, capacity=4, step=10)
    buckets = exact_dedup.located(df, directory).groupBy("depth", "prefix").count().collect()
    assert sum(r["count"] for r in buckets) == len(keys) and max(r["count"] for r in buckets) <= 4
    assert max(r.depth for r in buckets) > 50 and min(r.depth for r in buckets) < 20
    assert exact_dedup.directory_of(df.filter("false")).count() == 0


def test_exact_duplicates_hard_rows(spark):
    rows = [(7, "a  b"), (7, "a b"), (9, "a\tb"), (None, "a b"), (None, None), (None, ""), (3, " "), (4, "\n")]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_duplicates(table(spark, rows)).collect())
    want = [("7", "7", 4, True), ("7", "7", 4, True), ("9", "7", 4, False), ("None", "7", 4, False), ("None", "None", 2, True), ("None", "None", 2, True), ("3", "3", 2, True), ("4", "3", 2, False)]
    assert got == sorted(want)


def test_drop_duplicates_hard_rows(spark):
    df = table(spark, HARD)
    out = exact_dedup.drop_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.filter("doc_id is not null").collect()) == [-5, 1, 3, 4, 5, 7, 8, 9, 10, 11, 13, 14, 15]
    assert exact_dedup.exact_duplicates(df.filter("false")).count() == 0


def test_drop_duplicates_of_repeated_and_null_ids(spark):
    rows = [(7, "A"), (7, "B"), (8, "C c"), (8, "C  c"), (9, "C c"), (None, "N"), (None, "N"), (None, "A"), (None, "M"), (10, "M"), (11, None), (None, "")]
    got = [(r.doc_id, re.sub(" +", " ", r.text or "")) for r in exact_dedup.drop_duplicates(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(7, "A"), (7, "B"), (8, "C c"), (None, "N"), (10, "M"), (11, "")], key=str)


def test_mixing(spark, sf, docs):
    got = queries.op5_curriculum_mix(spark, sf).toPandas().set_index("doc_id")
    size = docs.set_index("doc_id").text.map(lambda t: len(brute.WORD.findall(t or "")))
    assert (got["size"] == size.loc[got.index]).all() and (got.taken <= 2 * got["size"]).all()
    source = docs.set_index("doc_id").source.loc[got.index]
    per = got.assign(source=source).groupby("source").agg(s=("size", "sum"), t=("target", "first"), k=("taken", "sum"))
    assert abs(per.t.sum() - 1.5 * per.s.sum()) < 1e-6 and (abs(per.k - per.t) <= 1).all() and (per.t <= 2 * per.s).all()


def water(sizes, weights, share):
    """Targets by resharing the excess until none is above."""
    total, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > 2 * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
            open_.discard(i)
            left -= target[i]
    return target


def test_mixing_hot_source_and_small_slots(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "hot" if i % 3 == 0 else rng.choice(["a", "b", "ü", "zz", None])) for i in range(900)]
    rows += [(1, "again", "hot"), (None, "no id", "a"), (2000, None, "empty")]
    out = mixing.mix(table(spark, rows), rows_per_slot=4).collect()
    assert len(out) == len(rows)
    names = sorted({r.source for r in out if r.source is not None}) + [None]
    sizes = [sum(r.size for r in out if r.source == n) for n in names]
    want = water(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5)
    for n, s, t in zip(names, sizes, want, strict=True):
        mine = [r for r in out if r.source == n]
        assert all(r.source_size == s and abs(r.target - t) < 1e-6 for r in mine)
        assert sum(r.taken for r in mine) == round(t) or abs(sum(r.taken for r in mine) - t) <= 0.5
    assert all(r.taken <= 2 * r.size for r in out)
    again = mixing.mix(table(spark, rows).repartition(7), rows_per_slot=64).collect()
    key = lambda r: tuple((x is None, x) for x in (r.doc_id, r.source, r.size, r.taken, r.target))
    assert sorted(map(key, out)) == sorted(map(key, again))
    positions = [r.position for r in out if r.position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert mixing.mix(table(spark, rows).filter("false")).count() == 0
    assert all(r.target == r.taken == 0 for r in mixing.mix(table(spark, [(1, None), (2, " ")])).collect())


def test_curriculum_times(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 1001).select((F.col("id") / 1000).alias("u")).crossJoin(spark.range(3).toDF("k"))
    for r in rows.select("u", "k", mixing.time_of(F.col("u"), F.col("k")).alias("t")).collect():
        knots = mixing.SCHEDULES[r.k]
        x = np.linspace(0, r.t, 400)
        y = np.interp(x, np.linspace(0, 1, len(knots)), knots) / np.mean([(a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)])
        assert abs(float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()) - r.u) < 1e-3


def test_mixed_documents(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 4}") for i in range(200)]
    out = mixing.mixed_documents(table(spark, rows))
    plan = {r.doc_id: r.repeats for r in mixing.mix(table(spark, rows)).collect()}
    counts = defaultdict(int)
    for r in out.collect():
        counts[r.doc_id] += 1
    assert dict(counts) == {i: n for i, n in plan.items() if n}


def test_each_pass_has_its_position(spark):
    rows = [(i, "w " * (1 + i % 9), "small" if i % 10 == 0 else "large") for i in range(300)]
    df = table(spark, rows)
    plan = mixing.mix(df, weights=(1.0, 5.0)).collect()
    small = [r for r in plan if r.source == "small" and r.repeats == 2]
    assert small and all(r.positions[0] == r.position < r.positions[1] <= 1 for r in small)
    assert max(r.positions[1] for r in small) > 0.9 and max(r.position for r in small) < 0.8
    out = [r.doc_id for r in mixing.mixed_documents(df, weights=(1.0, 5.0)).collect()]
    assert out == [i for _, i in sorted((p, r.doc_id) for r in plan for p in r.positions[: r.repeats])]


def dice_brute(text, dice):
    """n_notices, license, dice, licenses of a text."""

    def coefficient(a, b):
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0

    grams = lambda words: {f"{x} {y}" for x, y in zip(words, words[1:], strict=False)}
    bodies = [(name, licenses.words_of(body)) for name, every in sorted(licenses.TEMPLATES.items()) for body in every]
    units, found = {*(text or "").split("\n"), *re.split(r"\n[\x20\t\r]*\n", text or "")}, defaultdict(list)
    for u in units:
        met = [(-d, name) for name, body in bodies if (d := coefficient(grams(licenses.words_of(u)), grams(body))) >= dice]
        if met:
            d, name = min(met)
            found[name].append((-d, 1))
    words = licenses.words_of(text or "")
    for i, w in enumerate(words):
        for name, body in bodies:
            for at in [k for k, x in enumerate(body) if x == w and w in licenses.ANCHORS]:
                d = coefficient(grams(words[max(0, i - at) : max(0, i - at + len(body))]), grams(body))
                if d >= dice:
                    found[name].append((d, 0))
    best = min(((-max(d for d, _ in v), k) for k, v in found.items()), default=None)
    return (sum(max(1, sum(n for _, n in v)) for v in found.values()), best and best[1], best and -best[0], ",".join(sorted(found)))


def test_licenses(spark, docs):
    rng = random.Random(9)
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)) + [(10_000, None), (10_001, "")]
    bodies = [b for bs in licenses.TEMPLATES.values() for b in bs]
    for i in range(300):
        words = rng.choice(bodies).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["the", "license", "version", "words", "UNDER"])
        if rng.random() < 0.3:
            del words[rng.randrange(len(words))]
        width, lead = rng.choice([5, 9, 500]), rng.choice(["", "// ", "* ", "Some prose before it. "])
        wrapped = "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))
        rows.append((20_000 + i, "some text\n" + lead + wrapped + rng.choice(["\n\nmore", "\nmore", "", " and prose after it"])))
    got = {r.doc_id: (r.n_notices, r.license, r.dice, r.licenses) for r in licenses.licensed(table(spark, rows)).collect()}
    assert got == {i: dice_brute(t, licenses.DICE) for i, t in rows}
    assert sum(1 for v in got.values() if v[0]) > 100
    assert licenses.licensed(table(spark, rows).filter("false")).count() == 0


def test_licenses_where_they_stand(spark):
    mit, header = licenses.TEMPLATES["MIT"][3], licenses.TEMPLATES["Apache-2.0"][3]
    wrapped = "\n".join(" * " + mit[k : k + 60] for k in range(0, len(mit), 60))
    rows = [(1, f"Prose. {licenses.TEMPLATES['Apache-2.0'][0]} More prose that goes on and on."), (2, "/*\n" + wrapped + "\n*/ code();"), (3, "x " * 5000 + header + " y" * 5000), (4, "// SPDX-License-Identifier: MIT"),
            (4, "nothing"), (None, "Released under the MIT License."), (5, "license " * 3000), (6, "By the license of the poet, under no conditions")]
    got = sorted((str(r.doc_id), r.licenses) for r in licenses.licensed(table(spark, rows)).collect())
    assert got == sorted([("1", "Apache-2.0"), ("2", "MIT"), ("3", "Apache-2.0"), ("4", "MIT"), ("4", "MIT"), ("None", "MIT"), ("5", ""), ("6", "")])


def test_shards(spark, tmp_path, docs):
    df = table(spark, [*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True), (1, "again"), (None, None)])
    t = shards.ShardTable(spark, f"file://{tmp_path}/t")
    for part in range(3):
        t.append(df.filter(f"pmod(coalesce(doc_id, 0), 3) = {part}").repartition(3), arrival_rows=20)
    assert t.version() == 3 and t.manifest().count() >= 9
    before = sorted((str(r.doc_id), r.text) for r in t.rows().collect())
    v = t.compact(target=1 << 18)
    live = t.manifest().collect()
    assert v > 3 and sum(r.n_rows for r in live) == df.count() and len(live) < t.manifest(3).count()
    assert before == sorted((str(r.doc_id), r.text) for r in t.rows().collect()) == sorted((str(r.doc_id), r.text) for r in df.collect())
    assert sorted((str(r.doc_id), r.text) for r in t.rows(3).collect()) == before  # older versions stay readable
    with pytest.raises(shards.Conflict):
        t.commit(t.manifest(), base=v - 1)
    assert t.vacuum() == 0 and t.vacuum(older_than_s=0, keep_versions=1) > 0 and sorted((str(r.doc_id), r.text) for r in t.rows().collect()) == before
    from pyspark.sql import functions as F

    clash = df.withColumnsRenamed({"part": "Shard", "lang": "merge", "source": "into"}).withColumns({"__SHARD": F.lit(1), "__bytes": F.lit("b"), "_bytes": F.lit(2), "tier": F.lit(3)})
    assert shards.set_aside(clash).columns == [*clash.columns[:-4], "__SHARD_of_row", "__bytes_of_row", "_bytes", "tier"]
    assert shards.sharded(clash.drop("__SHARD", "__bytes"), arrival_rows=10, target=1 << 17)[0].rows().select(*clash.drop("__SHARD", "__bytes").columns).count() == df.count()
    out = shards.shard_of_documents(clash, arrival_rows=10, target=1 << 17)
    assert out.count() == df.count() and out.filter("shard_bytes > 131072 * 2").count() == 0
    assert shards.shard_of_documents(df.filter("false")).count() == 0


def plain_merges(live, target, min_runs):
    """Sets of shards that go into one file."""
    out = set()
    for tier in {r[1] for r in live}:
        runs = sorted(r for r in live if r[1] == tier and r[2] <= target // 2)
        if len(runs) < min_runs:
            continue
        parts, at = defaultdict(set), 0
        for shard, _, size in runs:
            parts[at // target].add(shard)
            at += size
        out |= {frozenset(p) for p in parts.values() if len(p) > 1}
    return out


def test_merge_plan(spark):
    rng = random.Random(6)
    for n, target in ((0, 1000), (3, 1000), (200, 1000), (200, 150_000)):
        live = [(rng.randrange(1 << 40), rng.choice([0, 0, 1, 2]), rng.randrange(0, 700)) for _ in range(n)]
        got = shards.merges(spark.createDataFrame(live, "shard long, tier int, n_bytes long"), target, 4).collect()
        into = defaultdict(set)
        for r in got:
            into[r.merge].add(r.shard)
        assert {frozenset(x) for x in into.values()} == plain_merges(live, target, 4)
        assert not into or 0 <= min(into) <= max(into) < n


def test_session_keeps_its_settings(spark):
    before = spark.conf.getAll
    langid.identify(table(spark, HARD), langid.fit(["a b c"], ["en"])).count()
    assert spark.conf.getAll == before


def test_vacuum_leaves_what_is_not_committed_yet(spark, tmp_path):
    """A second writer cleans up between the files of an append and its commit."""
    t = shards.ShardTable(spark, f"file://{tmp_path}/t")
    t.append(table(spark, [(1, "a"), (2, "b")]))
    commit = shards.ShardTable.commit

    class Slow(shards.ShardTable):
        def commit(self, manifest, base):
            removed.append(shards.ShardTable(spark, self.root).vacuum(**how))
            return commit(self, manifest, base)

    removed, how = [], {}
    Slow(spark, t.root).append(table(spark, [(3, "c")]))
    assert removed == [0] and sorted(r.doc_id for r in t.rows().collect()) == [1, 2, 3]
    how = {"older_than_s": -1}
    with pytest.raises(shards.Conflict):  # not a table that cannot be read
        Slow(spark, t.root).append(table(spark, [(4, "d")]))
    assert sorted(r.doc_id for r in t.rows().collect()) == [1, 2, 3]


@pytest.mark.parametrize("ids", [[None] * 400, [7] * 400, [None, 7] * 200])
def test_rows_that_share_an_id_have_plans_of_their_own(spark, ids):
    rows = [(i, f"w{k} " * 10, "a") for k, i in enumerate(ids)] + [(1000 + k, "x y z", "b") for k in range(5)]
    docs = table(spark, rows)
    plan = mixing.mix(docs, weights=(1.0, 5.0), max_repeats=2).collect()
    out = mixing.mixed_documents(docs, weights=(1.0, 5.0), max_repeats=2).collect()
    for source in "ab":
        times = sorted(r.repeats for r in plan if r.source == source and r.repeats)
        got = Counter(r.text if source == "a" else r.doc_id for r in out if r.source == source)
        assert sorted(got.values()) == times
    taken, written = (sum(10 * n for n in x) for x in ([r.repeats for r in plan if r.source == "a"], [1 for r in out if r.source == "a"]))
    assert taken == written
