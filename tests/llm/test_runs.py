"""Periodic runs against a plain search of every period."""

import random

import pytest

from lodestrata.llm import runs

from .test_contracts import HARD, table


def plain_runs(words, min_length, min_periods):
    n, out = len(words), {}
    for q in range(1, n // min_periods + 1):
        i = q
        while i < n:
            begin = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - begin >= max(min_length, min_periods * q):
                out.setdefault((begin, i - begin), q)  # a longer period of the same stretch is not its smallest
            i += 1
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_rest(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize(("min_length", "min_periods"), [(24, 3), (2, 2), (5, 2), (6, 3)])
def test_runs_of_random_words(min_length, min_periods):
    rng = random.Random(min_length)
    for _ in range(400):
        words = [b"%d" % rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 70))]
        if words and rng.random() < 0.5:
            p, at = rng.randint(1, 9), rng.randrange(len(words))
            words[at:] = [words[at + (i - at) % p] if at + p <= len(words) else words[i] for i in range(at, len(words))]
        assert runs.text_runs(words, min_length, min_periods) == plain_runs(words, min_length, min_periods)


def test_end_positions_keep_their_order():
    rng = random.Random(3)
    xs = rng.sample(range(10**6), 5000)
    s, seen = runs.EndPositions(xs[0]), {xs[0]}
    for x in xs[1:]:
        lower, higher = [y for y in seen if y < x], [y for y in seen if y > x]
        if len(seen) < 600 or len(seen) % 500 == 0:
            assert s.add(x) == (max(lower, default=-1), min(higher, default=-1))
        else:
            s.add(x)
        seen.add(x)
    assert list(s) == sorted(xs) and s.size == len(xs) and len(s.buckets) > 1


def test_hard_rows(spark):
    rows = [*HARD, (20, "tick tock " * 12), (21, "tick tock " * 11 + "tick"), (22, " " * 30), (23, " ".join(f"w{i % 3}" for i in range(60_000)) + " end"), (None, "a " * 30), (None, "a " * 30)]
    got = runs.periodic_runs(table(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda x: (str(x[0]), x[1])
    expected = []
    for i, text in rows:
        words = (text or "").split(" ") if "\t" not in (text or "") else []
        words = [w for w in words if w]
        found = [(0, 60_000, 3)] if i == 23 else plain_runs(words, 24, 3)
        expected.append((i, len(words), found, "w0 w1 w2 end" if i == 23 else plain_rest(words, found)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(expected, key=key)
    assert {r.doc_id: len(r.runs) for r in got if r.doc_id in (20, 21, 22)} == {20: 1, 21: 0, 22: 0}
    assert runs.periodic_runs(table(spark, []).limit(0)).collect() == []


def test_strongest_is_exact_and_the_first_of_ties(spark):
    rows = [([(0, 30, 3), (5, 40, 4), (9, 24, 8)],), ([(1, 2 * 10**9 + 1, 10**9), (2, 2 * 10**9 + 2, 10**9)],), ([],)]
    df = spark.createDataFrame(rows, f"runs array<{runs.RUN}>")
    assert [tuple(r.best) if r.best else None for r in df.select(runs.strongest(df.runs).alias("best")).collect()] == [(0, 30, 3), (2, 2 * 10**9 + 2, 10**9), None]
