import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import ngram_join as nj

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    label = {k: i for k, (i, _) in enumerate(rows)}
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return sorted((i, len(sets[k]), label[k], sum(k in link for link in links)) for k, (i, _) in enumerate(rows))


def result(spark, rows, **extra):
    docs = spark.createDataFrame([(i, t, *extra.values()) for i, t in rows], "doc_id long, text string" + "".join(f", {k} string" for k in extra))
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in nj.join(docs).collect())


def sample(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    boiler = " ".join(rng.choices(words, k=12))
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([3, 7, 30, 60, 150]))
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k, " ".join(copy) + (" " + boiler if rng.random() < 0.4 else "")))
            k += 1
    return rows


def test_matches_brute_force(spark):
    rows = sample()
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "One  two"), (1004, "oNE\ttwo"), (1005, "a " * 30), (1006, "A " * 9), (1007, "É b"), (1008, "é b")]
    assert result(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(260):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    assert result(spark, rows) == brute(rows)


def test_empty_table_repeated_rows_and_extra_columns(spark):
    assert result(spark, []) == []
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f")]
    assert result(spark, rows, label="x", rep="y", cls="z", task="t") == [(5, 2, 5, 2), (5, 2, 5, 2), (9, 2, 5, 2)]


def test_bound_never_hides_a_link():
    rng = np.random.default_rng(0)
    tokens, at = [], [0]
    for _ in range(200):
        pick = np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        tokens.append(pick)
        at.append(at[-1] + len(pick))
    at = np.array(at)
    counts, n = nj.count_vectors(np.concatenate(tokens), at, 64), np.diff(at)
    tree = nj.CountTree(counts, n)
    for a in range(200):
        near = set(tree.search(counts[a], int(n[a])).tolist())
        for b in range(200):
            if nj.linked(len(np.intersect1d(tokens[a], tokens[b])), n[a], n[b]):
                assert b in near


@pytest.mark.parametrize("side", [1, 2])
def test_extreme_signature_is_order_free(side):
    data = np.frombuffer(b"a b c d e f g" * side, np.uint8)
    tokens, at = nj.shingle_sets(data, np.array([0, len(data)]))
    assert nj.signatures(tokens, at).shape == (1,)


def test_few_members_in_many_blocks(spark):
    sets = {k: np.arange(k, k + 100, dtype=np.uint64) for k in range(4)}
    members = spark.createDataFrame([(k, 0, 1 << 22, 1) for k in sets], "rep long, label long, n long, copies long").withColumn("cls", F.col("rep") + 100)
    dealt = nj._tasks(members).selectExpr("doc_id", "cls", "copies", "explode(tasks) AS t").collect()
    sides = {}
    for r in dealt:
        sides.setdefault(r.t.task, set()).add(r.t.side)
    assert {1} in sides.values()  # the pair of a block with members and an empty one
    rows = [(r.t.task, r.t.side, r.cls, r.copies, bytearray(sets[r.doc_id].tobytes())) for r in dealt]
    tasks = spark.createDataFrame(rows, "task long, side int, cls long, copies long, tokens binary")
    found = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(nj._verify(True), "u long, v long, links long").collect()
    links = {}
    for r in found:
        if r.v is None:
            links[r.u] = links.get(r.u, 0) + r.links
    assert links == dict.fromkeys([k + 100 for k in sets], 3)


def test_no_pairs_with_an_empty_side():
    tokens, at, one = np.arange(9, dtype=np.uint64), np.array([0, 9]), np.ones(1, np.int64)
    for left, right in (([0], []), ([], [0])):
        edges, links = nj.join_block(tokens, at, one, np.array(left, np.int64), np.array(right, np.int64))
        assert edges == [] and links.tolist() == [0]


def test_ids_that_repeat_with_other_texts(spark):
    rng = random.Random(8)
    a, b = ([f"w{rng.randrange(10**6)}" for _ in range(150)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "z"])), (3, " ".join(["y", *b[1:]])), (7, "other words than these here")]
    for order in (rows, rows[::-1]):
        assert [(r[0], r[2], r[3]) for r in result(spark, order)] == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (7, 7, 0)]


def test_without_counting_the_components_are_the_same(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(k, " ".join([*base[: 120 - k % 9], *(f"x{rng.randrange(10**6)}" for _ in range(k % 9))])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in nj.join(docs, count_links=False).collect())
    assert got == [r[:3] for r in brute(rows)]
