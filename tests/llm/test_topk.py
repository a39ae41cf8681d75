import math
import random

import pytest

from quernel.llm import topk


def brute(rows, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def result(spark, rows, k=5, every=10):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    return sorted(tuple(r) for r in topk.search(df.repartition(3), k, every).collect())


def test_ties_nulls_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = random.Random(1)
    same = [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(i, same if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(8)]) for i in range(120)]
    rows = [(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    rows += [(200, None), (210, [None] * 8), (220, [float("nan")] * 8), (230, [float("inf")] + [0.0] * 7)]
    assert result(spark, rows) == brute(rows, 5, 10)


def test_few_rows_and_none(spark):
    assert result(spark, []) == []
    assert result(spark, [(0, [1.0, 0.5])]) == []
    rows = [(0, [1.0, 0.5]), (3, [-1.0, 0.25]), (10, [0.5, 0.5])]
    assert result(spark, rows) == brute(rows, 5, 10)


def test_out_of_range_is_refused(spark):
    with pytest.raises(ValueError):
        result(spark, [(0, [1e30, 1.0]), (1, [1e30, 1.0])])


def test_invalid_vectors_of_a_query_and_repeated_rows(spark):
    rows = [(0, [None, 3.0]), (0, [1.0, 2.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [0.5, float("nan")])]
    assert result(spark, rows, 5) == [(0, 1, 3, 3 * 65536), (0, 2, 3, 3 * 65536)]
