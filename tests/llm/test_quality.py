import random
import re
from collections import Counter

import numpy as np
import zstandard

from quernel.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    many = Counter(grams)
    inside = set()
    for k, g in enumerate(grams):
        if many[g] > 1:
            inside |= set(range(k, k + 8))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def cases():
    rng = random.Random(8)
    vocab = ["the", "Äther", "of", "x", "日本", "a|b", "#tag", "lorem", "ipsum,"]
    texts = [None, "", " \n\t\x0b ", "one", "a b \x1c c", "x " * 100, "line one\nline one\n\n\nline one \nLine one", "word " * 20000]
    for _ in range(60):
        lines = [" ".join(rng.choices(vocab, k=rng.randrange(0, 14))) for _ in range(rng.randrange(1, 12))]
        texts.append("\n".join(rng.choices(lines, k=len(lines))))
    return texts


def test_base_counts_match_brute_force(spark):
    texts = cases()
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)] + [(0, texts[0], "z")], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}
    assert quality.judge(docs.limit(0)).count() == 0


def test_small_chunks_change_nothing(monkeypatch):
    raw = [(t or "").encode() for t in cases()]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    whole = quality.base_counts(np.frombuffer(b"".join(raw), np.uint8), at)
    for k, r in enumerate(raw):
        one = quality.base_counts(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert all(one[name][0] == whole[name][k] for name in whole)


def test_bands_reject_repetition_and_noise(spark):
    rng = random.Random(2)
    syllables = [a + b + c for a in "bdfglmnprst" for b in "aeiou" for c in "nrst"]
    prose = " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(900))
    noise = " ".join("".join(chr(rng.randrange(33, 126)) for _ in range(12)) for _ in range(900))
    few = " ".join(rng.choices(["aa", "bb", "cc"], k=6000))
    docs = spark.createDataFrame([(0, prose), (1, few), (2, noise)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.judge(docs).collect()} == {0: True, 1: False, 2: False}


def clean_text(n_bytes, seed=4):
    """Words of a Zipf vocabulary, as compressible as prose."""
    rng = np.random.default_rng(seed)
    letters = list("etaoinshrdlucmfwypvbgkjqxz")
    vocab = ["".join(rng.choice(letters, k)) for k in rng.integers(2, 8, 9000)]
    chance = 1.0 / np.arange(3, 9003) ** 1.04
    words = rng.choice(len(vocab), n_bytes // 3, p=chance / chance.sum())
    return " ".join(vocab[k] for k in words)[:n_bytes]


def verdicts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in quality.judge(docs).collect()}


def test_long_clean_texts_stay_and_long_copies_go(spark):
    text = clean_text(3 << 20)
    texts = [text[: 48 << 10], text[: 200 << 10], text[: 512 << 10], text[: 1 << 20], text]
    got = verdicts(spark, [*texts, text[: 100 << 10] * 12])
    assert [got[k].kept for k in range(6)] == [True] * 5 + [False]
    assert any(got[k].ratio < 0.375 for k in range(5))


def test_script_does_not_change_the_verdict(spark):
    text = clean_text(300 << 10)
    lower = "abcdefghijklmnopqrstuvwxyz"
    scripts = [str.maketrans(lower, "".join(chr(first + k) for k in range(26))) for first in (0x61, 0x3B1 - 0x11, 0x430, 0x5D0, 0x621, 0x905, 0xE01, 0x10D0)]
    for size in (300, 1500, 6000, 30_000, 300_000):
        got = verdicts(spark, [text[:size].translate(script) for script in scripts])
        assert all(r.kept for r in got.values()), (size, got)
        assert max(r.ratio for r in got.values()) - min(r.ratio for r in got.values()) < 0.05


def test_letters_fold_alphabets_only():
    texts = ["", "plain", "é Ж अ ạ", "日本 한글 😀", "", "ж"]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    body, cut = quality.letters(np.frombuffer(b"".join(raw), np.uint8), at)
    got = [body[cut[k] : cut[k + 1]].tobytes() for k in range(len(raw))]
    assert got == [b"".join(bytes([0x80 | ord(c) & 0x7F]) if 0x80 <= ord(c) < 0x2000 else c.encode() for c in t) for t in texts]


def brute_verdict(text):
    """(ratio, bad chunks, chunks, kept) by loops."""
    packer = zstandard.ZstdCompressor(level=3)
    body = b"".join(bytes([0x80 | ord(c) & 0x7F]) if 0x80 <= ord(c) < 0x2000 else c.encode() for c in text or "")
    pieces, at = [], 0
    while at + 4096 <= len(body):
        pieces.append(body[at : at + 4096])
        at += 4096
    if pieces and at < len(body):
        pieces.append(body[-4096:])
    bad = sum(not 0.38 <= len(packer.compress(p)) / 4096 <= 0.65 for p in pieces)
    ratio = len(packer.compress(body)) / len(body) if body else 0.0
    low, high = next((lo, hi) for limit, lo, hi in quality.BANDS if len(body) < limit)
    return ratio, bad, len(pieces), not brute(text)[5] and low <= ratio <= high and bad <= len(pieces) / 2


def test_verdicts_match_brute_force(spark):
    rng = np.random.default_rng(9)
    clean = clean_text(40_000, 6)
    noise = " ".join("".join(chr(c) for c in rng.integers(33, 126, 9)) for _ in range(2500))
    texts = [None, "", "few words here"] + [clean[a : a + int(n)] for a, n in zip(rng.integers(0, 20_000, 25), rng.integers(1, 20_000, 25), strict=True)]
    texts += [clean[:4096], clean[:4095], clean[:8192], clean[:5000].translate(str.maketrans("abcdefgh", "абвгдежз")), clean[:4096] + noise[:3000], noise[:4096] + clean[:3000], noise[:12_000] + clean[:9000], clean[:9000] + noise[:12_000]]
    got = verdicts(spark, texts)
    for k, text in enumerate(texts):
        assert (got[k].ratio, got[k].bad_chunks, got[k].n_chunks, got[k].kept) == brute_verdict(text), k
    assert {r.kept for r in got.values()} == {True, False} and got[len(texts) - 4].bad_chunks == 1  # the tail
