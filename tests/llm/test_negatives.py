"""Hard negatives against all products."""

import math

import numpy as np
import pytest

from lodestrata.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, slot int"


def plain(rows, every=10, n_positives=5, n_negatives=3, low=50, high=95):
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, v, label in good:
        if i % every:
            continue
        scored = sorted(((-dot(v, w), j, k == label) for j, w, k in good if j != i))
        for s, j, _ in [x for x in scored if x[2]][:n_positives]:
            fits = [(n, -t) for t, n, same in scored if not same and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, r, n, -s, t) for r, (n, t) in enumerate(fits[:n_negatives], 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize(("dim", "spread"), [(1, 1.0), (5, 3.0), (24, 0.4)])
def test_against_all_products(spark, dim, spread):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(4, dim))
    rows = [(int(i) - 300, (centres[i % 3] * 2 + spread * rng.normal(size=dim)).astype(np.float32).tolist(), int(i) % 4, "x", 1) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows)
    assert want
    assert found(negatives.hard_negatives(df, anchor_every=10)) == want
    assert found(negatives.hard_negatives(df, anchor_every=10, anchors_block=7, rows_block=64)) == want


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.25 * (i % 5)], i % 3, "x", 1) for i in range(40)]
    rows += [(50, None, 1, "x", 1), (60, [1.0, None], 1, "x", 1), (70, [nan, 1.0], 1, "x", 1), (80, [1.0, inf], 1, "x", 1), (90, [1.0, 1.0], None, "x", 1), (None, [1.0, 1.0], 1, "x", 1)]
    rows += [(100, [], 0, "x", 1), (110, [0.0, 0.0], 0, "x", 1), (120, [1.0], 2, "x", 1), (130, [1.0, 0.5, 0.5], 2, "x", 1), (20, [1.0, 1.0], 2, "x", 1), (20, [1.0, 1.0], 2, "x", 1)]
    rows += [(200 + i, [1.0, 1.0], 1, "x", 1) for i in range(60)]  # copies: ties go by vec_id
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(negatives.hard_negatives(df, anchor_every=10)) == plain(rows)
    assert found(negatives.hard_negatives(df.filter("false"))) == []
    assert found(negatives.hard_negatives(df.filter("vec_id % 10 <> 0"), anchor_every=10)) == []
    assert found(negatives.hard_negatives(df.filter("label = 1"), anchor_every=10)) == []
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(1, [1e30], 1, "x", 1)], SCHEMA))


def test_no_pair_is_lost_and_most_are_discarded():
    """Bounds keep every pair of a score in reach; with a leading direction few pairs get to whole products."""
    rng = np.random.default_rng(1)
    m = (rng.normal(size=(600, 32)) * np.linspace(60, 1, 32)).astype(np.int32)
    axes = negatives.directions(m.astype(float), 32)
    assert np.allclose(axes.T @ axes, np.eye(32))
    ids = np.arange(600)
    block = negatives.Rotated(m.tobytes(), np.zeros(600, np.int64).tobytes(), ids.tobytes(), axes)
    exact = m.astype(np.int64) @ m.astype(np.int64).T
    low, high = np.sort(exact, 1)[:, -20], np.sort(exact, 1)[:, -4]
    got = {(a, b): s for i, j, score in negatives.near_pairs(block, block, ids, ids, low, high) for a, b, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True)}
    assert got == {(int(i), int(j)): int(exact[i, j]) for i, j in zip(*np.nonzero((exact >= low[:, None]) & (exact <= high[:, None])), strict=True)}
