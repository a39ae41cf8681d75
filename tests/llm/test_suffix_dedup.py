import hashlib
import random

import numpy as np
import pyarrow as pa

from quernel.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        flags = gone[:-1]
        spans = int(flags[:1].sum() + (flags[1:] & ~flags[:-1]).sum())
        kept = bytes(x for x, g in zip(b, flags, strict=True) if not g)
        out.append((-1 if i is None else i, len(b), int(flags.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, row_hash string, spans int")
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in sd.digest(docs.repartition(3)).collect())


def sample(seed, n=90):
    rng = random.Random(seed)
    words = ["the", "of", "Äther", "ab", "cdé", "日本", "x", "lorem", "ipsum", "dolor"]
    passages = [" ".join(rng.choices(words, k=rng.randrange(8, 40))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 30)))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randrange(1, 200)], " ".join(rng.choices(words, k=rng.randrange(0, 10)))]
        rows.append((k * 7 % n, rng.choice(["", " "]).join(parts)))
    return rows


def test_matches_brute_force(spark):
    rows = sample(1) + [(500, None), (501, ""), (502, "a" * 49), (503, "a" * 50), (504, "a" * 300), (505, "ab" * 100), (506, "xa" + "ab" * 60), (507, sample(1)[0][1])]
    assert result(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "one line that is clearly longer than fifty bytes, so that it counts"
    rows = [(3, text), (3, text), (9, "zz " + text + " tail"), (None, text), (2, text[:40])]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_pieces_and_slices_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(sd, "ROWS_PER_PIECE", 97)
    data = np.frombuffer(" ".join(t for _, t in sample(2, 20)).encode(), np.uint8)
    small = sd.runs_of(data, np.array([0, len(data) // 2, len(data)]))
    monkeypatch.setattr(sd, "ROWS_PER_PIECE", 1 << 22)
    whole = sd.runs_of(data, np.array([0, len(data) // 2, len(data)]))
    spread = lambda r: sorted((int(a), int(s) + k) for a, s, n, _ in zip(*r, strict=True) for k in range(n))
    assert spread(small) == spread(whole)


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_construction_gives_the_order_and_the_common_prefixes():
    rng = random.Random(0)
    for alphabet in (b"ab\x00\xff", b"a", bytes(range(256))):
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + [b"a" * 300, bytes(range(256))]
        size = np.array([len(t) for t in texts])
        body = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum(size) - size
        order, lcp = sd.construct(body, at, size)
        ends = np.repeat(at + size, size)
        suffixes = [bytes(body[p : ends[p]]) for p in order]
        assert suffixes == sorted(suffixes) and sorted(order.tolist()) == list(range(len(body)))
        assert lcp[1:].tolist() == [shared(a, b) for a, b in zip(suffixes[:-1], suffixes[1:], strict=True)]


def test_common_prefixes_decide(spark, monkeypatch):
    rows = sample(3, 40)
    honest = sd.construct
    monkeypatch.setattr(sd, "construct", lambda *a: (honest(*a)[0], np.zeros_like(honest(*a)[1])))
    text = np.frombuffer("".join(t for _, t in rows).encode()[:200], np.uint8)
    at, size, least = np.array([0, 100, 0]), np.array([80, 80, 80]), np.array([9, 8, 3])
    assert sd.first_documents(text, at, size, least).reshape(3, -1)[0].tolist() == [9] * 31
    monkeypatch.setattr(sd, "construct", honest)
    assert sd.first_documents(text, at, size, least).reshape(3, -1)[0].tolist() == [3] * 31


def test_small_collections_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(sd, "SLICE", 1)
    blobs = {}
    rows = sample(5, 30)
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in rows])])
    anchors, start, n, doc = sd.runs_of(data, at)
    ids = np.array([i for i, _ in rows])[doc]
    text = b"".join(data[s : s + k + sd.SPAN - 1].tobytes() for s, k in zip(start, n, strict=True))
    blob = sd.packed(anchors, n.astype(np.uint8), np.frombuffer(text, np.uint8), np.arange(len(n), dtype=np.uint32), ids, ids, start - at[doc])
    batch = pa.RecordBatch.from_pydict({"home": [0], "blob": pa.array([blob], pa.binary())})
    for slice_ in (1, 7, 1 << 20):
        monkeypatch.setattr(sd, "SLICE", slice_)
        blobs[slice_] = list(zip(*(np.concatenate(x).tolist() for x in zip(*sd._found(iter([batch])), strict=True)), strict=True))
    assert blobs[1] == blobs[7] == blobs[1 << 20] and blobs[1]


def test_copies_are_left_out_and_texts_move_once(spark, monkeypatch):
    rows = [(1000 * k + i, t) for k in range(8) for i, t in sample(6, 40)] + [(17, "another text of an id that is there already " * 3)]
    kept, honest = [], sd.bucketed
    monkeypatch.setattr(sd, "bucketed", lambda *a: kept.append(honest(*a)) or kept[-1])
    assert result(spark, rows) == brute(rows)
    assert kept[0].count() == len({t for _, t in rows if len(t.encode()) >= 50})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        plan = sd.cut(docs)[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # of the spans, not of the texts


def test_places_do_not_depend_on_how_a_buffer_is_cut(monkeypatch):
    texts = [t.encode() for _, t in sample(4, 20)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    runs = lambda d, o, shift=0: {(int(x) + shift, int(p), int(a)) for a, _, _, x, p in zip(*sd.placed_runs(d, o), strict=True)}
    alone = set().union(*(runs(np.frombuffer(t, np.uint8), np.array([0, len(t)]), k) for k, t in enumerate(texts)))
    assert runs(data, offsets) == alone
    monkeypatch.setattr(sd, "ROWS_PER_PIECE", 61)
    assert runs(data, offsets) == alone
