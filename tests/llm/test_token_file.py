import random
import zlib

import numpy as np
import pytest

from quernel.llm import token_file as tf

public = pytest.importorskip("public_tokenizers")
library = pytest.importorskip("tokenizers")
PATH = public.path("word_bpe_49k.json")
TEXTS = [None, "", "  ", "a.b 3.14 x!? The THE the. \"q\". o's.", "É é é “z”, don't", "x<|startoftext|>y <|endoftext|> <|EndOfText|>", "日本語 \x00 ?", "same text", "same text", "word, " * 400]


def brute(rows):
    tokenizer = library.Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_ids_start_and_checksums(spark):
    rows = list(enumerate(TEXTS)) + [(None, "no id")]
    docs = spark.createDataFrame([(i, t, 0, b"x") for i, t in rows], "doc_id long, text string, shard int, body binary")
    got = [tuple(r) for r in tf.digest(docs.repartition(3), PATH).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(rows)
    assert tf.digest(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("segment", [1, 60, 100_000])
def test_many_segments_and_documents_longer_than_one(spark, segment, tmp_path):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choices(["alpha", "beta,", "Gamma", "the"], k=rng.randrange(0, 40)))) for k in range(300)] + [(120_000, "long words " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in tf.digest(df, PATH, segment).collect())
    assert got == brute(docs)
    tf.write(df, PATH, str(tmp_path / "ids"), segment)
    pieces = spark.read.parquet(str(tmp_path / "ids")).groupBy("shard").count().agg({"count": "max"}).first()[0]
    assert pieces == 1 if segment == 100_000 else pieces > 5


def coded(ids, block):
    start, x = tf.Start.of(ids)
    again = tf.Start(start.symbols, start.counts, start.ahead[:, :-1])
    blocks = tf.encode_blocks(x, start, block)
    return blocks, again.symbols[tf.decode_blocks(blocks, len(x), again, block)]


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 9000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    sure = np.concatenate([np.tile([1, 2, 3], n // 3 + 1)[: n - n // 4], rng.integers(0, 5, n // 4)])  # all orders are sure, and then wrong
    for ids in (sure, np.where(rng.random(n) < 0.6, rng.integers(0, 12, n), rng.integers(0, 1 << 32, n)), np.zeros(n, np.int64), np.arange(n), rng.integers(0, 2, n)):
        assert (coded(ids, 1024)[1] == ids).all()


def test_blocks_are_independent_and_turns_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    ids = rng.zipf(1.3, 7000) % 700
    blocks, _ = coded(ids, 1024)
    start, x = tf.Start.of(ids)
    for k in (0, 3, 6):
        part = x[k * 1024 : (k + 1) * 1024]
        assert tf.encode_blocks(part, start, 1024) == [blocks[k]]
        assert (tf.decode_blocks([blocks[k]], len(part), start, 1024) == part).all()
    monkeypatch.setattr(tf, "CELLS", 1)
    assert coded(ids, 1024)[0] == blocks


def test_predictions_of_all_orders_shorten_the_code():
    rng = np.random.default_rng(6)
    follow = rng.permutation(3000)
    ids = [0, 1]
    for _ in range(60_000):
        ids.append(int(follow[ids[-1]]) if rng.random() < 0.4 else int(rng.zipf(1.4)) % 3000)
    ids = np.array(ids)
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    entropy = -(share * np.log2(share)).sum()
    bits = 8 * len(tf.segment_bytes([1], np.array([len(ids)]), ids)) / len(ids)
    assert bits < entropy < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 1)) / len(ids)
    flat = rng.integers(0, 1000, 60_000)  # nothing to learn: little is lost
    assert 8 * sum(map(len, coded(flat, 2048)[0])) / len(flat) < 1.08 * np.log2(1000)


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.int32)
    body = tf.segment_bytes([7, None], np.array([4000, 1000]), ids)
    docs, sizes, again = tf.read_segment(body)
    assert docs == [7, None] and sizes.tolist() == [4000, 1000] and (again == ids).all()
    for at in (60, len(body) // 2, len(body) - 9):
        with pytest.raises(ValueError):
            tf.read_segment(body[:at] + bytes([body[at] ^ 1]) + body[at + 1 :])


def test_too_many_distinct_ids_are_refused(monkeypatch):
    monkeypatch.setattr(tf, "MOST_IDS", 10)
    with pytest.raises(ValueError):
        tf.segment_bytes([1], np.array([11]), np.arange(11))


def test_order_1_shares_out_several_successors():
    rng = np.random.default_rng(7)
    follow = rng.permuted(np.tile(np.arange(1000), (4, 1)), axis=1)  # four for each id, and nothing else to learn
    ids, last = [], 0
    for k in rng.integers(0, 4, 100_000):
        ids.append(last := int(follow[k, last]))
    ids = np.array(ids)
    body = tf.segment_bytes([1], np.array([len(ids)]), ids)
    assert (tf.read_segment(body)[2] == ids).all()
    assert 8 * len(body) / len(ids) < 3.2  # 2 bits, and the segment's 4000 pairs


def test_words_of_letters_go_the_short_way_and_get_the_same_ids():
    with open(PATH, encoding="utf-8") as f:
        words = tf.WordIds(f.read())
    texts = ["plain words, été ñandú ÿ ß straße", "Ünder İI ﬁ ǆ é œuvre ÷ ª º x_y 1st it's </w> a</w>b", "ŉͅ Ÿ ſ K"]
    data = [t.encode() for t in texts]
    ids, at = words.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    tokenizer = library.Tokenizer.from_file(PATH)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    long_way = words.tokenizer
    words.tokenizer = None
    new = np.frombuffer("newletterséñß".encode(), np.uint8)
    assert words.look_up(new, np.array([0, 3, 10]), np.array([3, 10, len(new)]))[0].tolist() == long_way.encode("new letters éñß", add_special_tokens=False).ids
