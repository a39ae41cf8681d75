import random
import zlib

import numpy as np

from quernel.llm import toxicity as tx


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    rows = []
    for k in range(n):
        text = rng.choices(words, k=rng.randrange(5, 160))
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                text.insert(rng.randrange(len(text)), rng.choice(["vermin", "Foulmouth,", "foulling"]))
        rows.append((k, " ".join(text), toxic))
    return rows


def test_held_out_accuracy_and_cases(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(10_000, None, "x"), (10_001, "", "x"), (10_002, "... !!", None), (10_003, "word " * 3000 + "vermin foulling vermin", "x"), (1, rows[1][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (99_999, 1)], "doc_id long, toxic int")
    got = tx.score(docs, tx.fit(docs, labels)).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = np.mean([(score[i] >= tx.THRESHOLD) == y for i, y in held])
    assert right >= 0.95
    assert score[10_000] == score[10_001] == score[10_002] < 0.5 < score[10_003]


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tx.score(docs, tx.fit(docs, labels)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.score for r in tx.score(docs, tx.fit(docs, one)).collect()] == [1.0, 1.0]
    assert tx.score(docs.limit(0), tx.fit(docs, labels)).count() == 0


def prepared(n, seed=4):
    texts = [t.encode() for _, t, _ in corpus(n, seed)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = tx.Words(np.frombuffer(b"".join(texts), np.uint8), at)
    starts, owner = tx.windows(words.doc, len(texts))
    place, mask = tx.window_words(starts, owner, words.doc, len(texts))
    net = tx.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return texts, words, words.at[place], mask, owner, net


def test_gradient_matches_differences():
    _, words, ids, mask, owner, net = prepared(6)
    target = (owner % 2).astype(np.float32)

    def loss():
        q = tx.sigmoid(net.logits(net.inputs(words), ids, mask).astype(np.float64))
        return -np.mean(target * np.log(q) + (1 - target) * np.log(1 - q))

    g = net.gradient(words, ids, mask, target)
    for name in ("Wf", "Ub", "cb", "att", "out", "bias", "word", "gram"):
        if isinstance(g[name], tuple):
            rows, values = g[name]
            assert len(np.unique(rows)) == len(rows)
            k, j = np.unravel_index(np.abs(values).argmax(), values.shape)
            spot, want = (rows[k], j), values[k, j]
        else:
            spot = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
            want = g[name][spot]
        keep, step = net.p[name][spot], 1e-2
        net.p[name][spot] = keep + step
        up = loss()
        net.p[name][spot] = keep - step
        down = loss()
        net.p[name][spot] = keep
        assert abs((up - down) / (2 * step) - want) < 0.05 * abs(want) + 1e-4, name


def by_loops(text, net):
    """The logit of each window of a text: words, n-grams, gates and attention one at a time."""
    s = lambda x: 1 / (1 + np.exp(-x))
    h = tx.HIDDEN
    plain = bytes(tx.PLAIN[b] for b in text)
    vectors = []
    for word in plain.split():
        found = tx.Words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        grams = [word[k : k + size] for size in tx.GRAMS for k in range(len(word) - size + 1)] or [word]
        assert len(found.gram) == len(grams)
        vectors.append(np.concatenate([net.p["word"][found.word[0]], sum(net.p["gram"][g] for g in found.gram) / np.sqrt(len(grams))]))
    out, start = [], 0
    while True:
        part = vectors[start : start + tx.WINDOW]
        states = []
        for side, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            state, seen = np.zeros(h), {}
            for t in order:
                a, b = part[t] @ net.p[f"W{side}"] + net.p[f"c{side}"], state @ net.p[f"U{side}"]
                z, r = s(a[:h] + b[:h]), s(a[h : 2 * h] + b[h : 2 * h])
                state = (1 - z) * state + z * np.tanh(a[2 * h :] + r * b[2 * h :])
                seen[t] = state
            states.append(seen)
        both = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(part))]
        weight = np.exp([x @ net.p["att"] for x in both])
        out.append(sum(w * x for w, x in zip(weight / weight.sum(), both, strict=True)) @ net.p["out"] + net.p["bias"][0])
        if start + tx.WINDOW >= len(vectors):
            return out
        start += tx.STRIDE


def test_windows_gates_and_pooling_match_loops():
    texts, words, ids, mask, owner, net = prepared(5, seed=8)
    net.p["bias"] += 0.3
    got = net.logits(net.inputs(words), ids, mask)
    for k, text in enumerate(texts):
        assert np.allclose(got[owner == k], by_loops(text, net), atol=1e-6)
    model = object.__new__(tx.Model)
    model.fitted, model.net, model.scale, model.shift = True, net, 1.5, -0.2
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert np.allclose(model.scores(data, at), [tx.sigmoid(1.5 * max(by_loops(t, net)) - 0.2) for t in texts], atol=1e-6)


def test_both_inputs_are_learned_and_nothing_else_helps():
    rows = corpus(500, seed=11)
    model = tx.Model([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]))
    fresh = corpus(200, seed=12)
    data = np.frombuffer("".join(t for _, t, _ in fresh).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t, _ in fresh])])
    toxic = np.array([y for *_, y in fresh]) == 1

    def order():
        score = model.scores(data, at)
        return np.mean(score[toxic][:, None] > score[~toxic]) + 0.5 * np.mean(score[toxic][:, None] == score[~toxic])

    assert order() > 0.95
    for name in ("word", "gram"):
        model.net.p[name][:] = 0
    assert abs(order() - 0.5) < 0.1  # without the learned vectors windows differ by their length only


def test_sample_is_filled_with_usable_rows(spark):
    docs = spark.createDataFrame([(k, "a text" if k % 5 == 0 else None) for k in range(100)] + [(200, "w " * 60_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    rows = tx.training_rows(docs, labels, 4, 5).collect()
    assert sorted(r.toxic for r in rows) == [0] * 5 + [1] * 4 and {r.text for r in rows} == {"a text"}


def test_long_texts_take_part_in_passages():
    assert tx.passages(b"a few words") == b"a few words" and tx.passages(b"") == b""
    words = [f"w{k}" for k in range(50_000)]
    part = tx.passages(" ".join(words).encode()).decode().split()
    assert len(part) == tx.MAX_WORDS // tx.WINDOW * tx.WINDOW and part[0] == "w0" and part[-1] == "w49999"
    assert all(part[k : k + tx.WINDOW] == words[int(part[k][1:]) : int(part[k][1:]) + tx.WINDOW] for k in range(0, len(part), tx.WINDOW))
