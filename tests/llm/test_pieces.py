import random

import numpy as np
import pytest

from quernel.llm import pieces

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.from_model(PATH)


def encode(vocabulary, texts):
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, out = pieces.encode_buffer(vocabulary, pieces.Remembered(limit=50), np.frombuffer(b"".join(raw), np.uint8), at)
    return ids, out


def test_ids_are_the_librarys(vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    texts = ["", " ", "a", "  a  b\n\n c", "日本語 テキスト", "🙂 x", "x" * 300, "Hello, world! 1234"]
    texts += ["".join(rng.choice("aabbcc  \nethé1日🙂") for _ in range(rng.randrange(0, 200))) for _ in range(200)]
    ids, at = encode(vocabulary, texts)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [model.encode(t) for t in texts]


def test_unigram_scores_match_brute_force():
    names = ["a", "b", "c", "ab", "bc", "abc", "▁a", "▁", "▁ab", "ca"]
    scores = [-1.5, -2.5, -2.25, -3.1, -2.9, -5.4, -2.2, -1.1, -4.2, -3.3]
    vocabulary = pieces.Vocabulary(["<unk>", *names], [0.0, *scores], {}, {0}, merges=False)
    rng = random.Random(2)

    def best(text):
        top = [(0.0, [])] + [(-1e18, None)] * len(text)
        for end in range(1, len(text) + 1):
            for k, name in enumerate(names):
                piece = name.replace("▁", " ")
                if text[:end].endswith(piece):
                    gain = top[end - len(piece)][0] + scores[k]
                    if gain > top[end][0] + 1e-12:
                        top[end] = (gain, [*top[end - len(piece)][1], k + 1])
        return top[-1][0]

    for _ in range(100):
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 120)))
        ids, _ = encode(vocabulary, [text])
        assert abs(sum(scores[i - 1] for i in ids) - best(" " + text)) < 1e-9


def test_round_trip_with_spark(spark, vocabulary):
    texts = [None, "", "a ▁ literal mark", "tabs\tand\r\nlines", "日本 \x00 x", "same", "same"]
    docs = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)], "doc_id long, text string, decoded string")
    rows = pieces.decode(pieces.encode(docs, vocabulary), vocabulary, text="decoded").collect()
    assert {r.doc_id: r.decoded for r in rows} == {k: t or "" for k, t in enumerate(texts)}
    assert pieces.encode(docs.limit(0), vocabulary).count() == 0


def test_one_pass_equals_encode_and_decode(spark, vocabulary):
    texts = [None, "", "a ▁ literal mark", "日本 \x00 x", "word " * 20_000, "same", "same"]
    docs = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)], "doc_id long, text string, round_trip string")
    want = {r.doc_id: r.ids for r in pieces.encode(docs, vocabulary).collect()}
    for r in pieces.encode_checked(docs, vocabulary).collect():
        assert (r.ids, r.n_bytes, r.round_trip) == (want[r.doc_id], len((texts[r.doc_id] or "").encode()), True)
    broken = pieces.Vocabulary.from_model(PATH)
    broken.bytes = np.where(broken.bytes == ord("m"), ord("n"), broken.bytes).astype(np.uint8)
    got = {r.doc_id: r.round_trip for r in pieces.encode_checked(docs, broken).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: False}
    short = pieces.Vocabulary.from_model(PATH)
    short.at = short.at.copy()
    short.at[1:] = short.at[1:] - (np.arange(len(short.at) - 1) >= len(short.at) - 2)
    assert pieces.encode_checked(docs.limit(0), short).count() == 0
