"""Bounds that go before the comparison of sets."""

from __future__ import annotations

import tempfile
import time
from pathlib import Path

import numpy as np

from lodestrata.llm import common, ngram_join


def test_bound_of_large_sets_tells_texts_that_are_a_little_too_different(spark):
    rng = np.random.default_rng(7)
    u = np.unique(rng.integers(0, 1 << 63, 4200, dtype=np.uint64))
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near, far = (np.unique(np.r_[u[k:], fresh(k)]) for k in (300, 700))
    longer = np.unique(np.r_[u, fresh(400)])  # of twice as many bits
    assert len(ngram_join.parity(longer)) == 2 * len(ngram_join.parity(u[:4000]))
    rows = [(name, len(u), ngram_join.parity(u).tolist(), len(v), ngram_join.parity(v).tolist()) for name, v in (("near", near), ("far", far), ("longer", longer))]
    rows.append(("fold", 4000, ngram_join.parity(u[:4000]).tolist(), len(longer), ngram_join.parity(longer).tolist()))
    found = spark.createDataFrame(rows, "name string, a_n long, a_parity array<long>, b_n long, b_parity array<long>").filter(ngram_join._similar_enough(80))
    assert {r.name for r in found.collect()} == {"near", "longer", "fold"}  # far: 71 percent


def test_signatures_of_the_same_classes_are_joined_once(spark):
    rows = [(s, c, 0) for s in range(50) for c in (1, 2, 3)] + [(50, 1, 0), (50, 2, 0), (51, 2, 0), (51, 3, 0)]
    kept = ngram_join._unlike(spark.createDataFrame(rows, "signature long, class_id long, component long"))
    assert sorted((r.signature, r.class_id) for r in kept.collect()) == [(0, 1), (0, 2), (0, 3), (50, 1), (50, 2), (51, 2), (51, 3)]


def test_shuffle_files_go_as_soon_as_a_table_is_written(spark):
    """Else they stay until the driver happens to collect its garbage, beside all that later steps shuffle."""

    def files() -> set[Path]:
        return set(Path(spark.conf.get("spark.local.dir", tempfile.gettempdir())).glob("**/blockmgr-*/*/shuffle_*"))

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(name)
    rows = spark.range(0, 20_000, 1, 8).repartition(4, "id")
    table = common.cut(rows, "spent")
    until = time.monotonic() + 10
    while (left := files() - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(name) == setting
    assert table.count() == 20_000 and rows.count() == 20_000
    assert files() - before  # the place is the right one: the last count, which is not a cut, has left its own
