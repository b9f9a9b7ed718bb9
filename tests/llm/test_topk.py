"""Exact top-k against all pairs in Python integers."""

import math
import random

import numpy as np
import pytest

from tavolo.llm import topk


def plain(rows, k=5, every=50):
    """Each query row's list: rows (id, vector); every kept row but itself is a candidate."""
    kept = [(i, v) for i, v in rows if i is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[int(x) * 256 if abs(x) >= 2**52 else math.floor(x * 256) for x in v] for _, v in kept]
    out = []
    for a, (qid, _) in enumerate(kept):
        if qid % every:
            continue
        scored = [(-sum(x * y for x, y in zip(ints[a], ints[b])), kept[b][0]) for b in range(len(kept)) if b != a]
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            out.append((qid, rank, i, -s if -2**63 <= -s < 2**63 else None))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<double>, norm double, data string")
    return sorted((tuple(r) for r in topk.top_inner_products(df, **options).collect()), key=str)


@pytest.fixture()
def small_blocks(monkeypatch):
    for name, value in (("BLOCK_ROWS", 64), ("QUERY_ROWS", 4), ("CHUNK_VALUES", 256), ("TASK_BLOCKS", 2)):
        monkeypatch.setattr(topk, name, value)


def test_near_equal_lengths_ties_and_repeated_ids(spark, small_blocks):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]             # equal lengths: length prunes nothing
    x[200:300] = x[50]                                  # one vector in many rows
    rows = [(i % 480, v.tolist()) for i, v in enumerate(x)]     # ids 0 to 19 twice
    rows += [(50, x[3].tolist()), (50, x[3].tolist()), (None, x[0].tolist()), (601, None), (602, [1.0, None]),
             (603, [float("nan")]), (650, []), (651, x[1].tolist()[:5])]
    assert found(spark, rows) == plain(rows)


def test_long_vectors_prune_and_lists_of_few(spark, small_blocks):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8)) * np.exp(rng.normal(size=(400, 1)) * 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:3]) == plain(rows[:3])
    assert found(spark, rows[:1]) == []
    assert found(spark, rows[1:9]) == []
    assert found(spark, [(-50, [1.0]), (0, [2.0]), (7, [-1.0])], k=1) == plain([(-50, [1.0]), (0, [2.0]), (7, [-1.0])], 1)


def test_components_of_any_size(spark, small_blocks):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([1e300, -1e300, 2.0**60, -5.5, 1.7e308, 0.1]) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(80)]
    assert found(spark, rows) == plain(rows)
    middle = [(i, [rnd.uniform(-2.0**20, 2.0**20) for _ in range(4)]) for i in range(150)]    # products over 2^52
    assert found(spark, middle) == plain(middle)


def test_places_sort_as_integers():
    rnd = random.Random(4)
    numbers = [0, 1, -1, 9, 10, -9, -10] + [rnd.choice([1, -1]) * rnd.randrange(10 ** rnd.randrange(1, 700)) for _ in range(300)]
    assert sorted(numbers) == sorted(numbers, key=topk.place)
