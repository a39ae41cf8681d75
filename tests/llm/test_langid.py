import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import langid

VOCAB = {"aa": "kata moro lipu sena", "bb": "zhwq grof brt schlump"}


def text(lang, n, rng):
    return " ".join(rng.choices(VOCAB[lang].split(), k=n))


def model(rng):
    langs = ["aa", "bb"] * 30
    return langid.TextModel.of([text(x, 30, rng).encode() for x in langs], langs)


def run(spark, rows, fitted):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    ready = langid.evidence_rows(pages, "html", langid.host_of(F.col("url")), langid.declared_language(F.col("html")))
    return {r.page_id: r for r in langid.identify(ready, fitted, ["page_id"]).collect()}


def test_evidence_is_fused(spark):
    rng = random.Random(1)
    rows = []
    for k in range(120):
        lang = "aa" if k % 3 else "bb"
        rows.append((k, f"http://www.site-{lang}.example.{'net' if lang == 'aa' else 'org'}/p{k}", f'<!DOCTYPE html><html lang="{lang}"><body><p class="zhwq grof">{text(lang, 25, rng)}</p></body></html>'))
    rows += [(500, "http://www.site-bb.example.org/x", "<p>123</p>"), (501, None, None), (502, "https://new.elsewhere.com/", '<html lang="bb"><p></p></html>'), (503, "odd", text("bb", 40, rng)), (504, "http://www.site-aa.example.net/", "<html lang='aa'>" + text("bb", 200, rng))]
    got = run(spark, rows, model(rng))
    assert all(got[k].lang == ("aa" if k % 3 else "bb") for k in range(120))
    assert got[500].lang == "bb" and got[500].text_lang is None and got[500].host == "www.site-bb.example.org"
    assert got[501].lang == "aa" and 0.5 < got[501].probability < 0.9  # the prior of all rows
    assert got[502].declared == "bb" and got[502].lang == "bb"
    assert got[503].lang == "bb" and got[503].suffix == "" and got[504].lang == "bb"


def test_text_likelihoods_match_brute_force():
    rng = random.Random(2)
    fitted = model(rng)
    texts = [b"", b"12 !!", text("aa", 9, rng).encode(), b"Kata MORO x"]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = fitted.likelihoods(np.frombuffer(b"".join(texts), np.uint8), at)
    for k, t in enumerate(texts):
        plain = "".join(chr(c).lower() if chr(c).isalpha() else " " for c in t)
        want = np.zeros(2)
        for j in range(len(plain) - 2):
            g = plain[j : j + 3]
            if g[1] != " ":
                code = (ord(g[0]) << 16) | (ord(g[1]) << 8) | ord(g[2])
                want += fitted.table[((code * 2654435761) % 2**32) >> 14]
        want *= langid.TEMPERATURE
        assert np.allclose(got[k], want - want.max(), atol=1e-4)


def test_markup_is_skipped():
    raw = b'x <a href="y">z</a> 3 < 4 <b unclosed'
    for after in (b"", b"p > q"):  # the next row's > closes nothing
        both = np.frombuffer(raw + after, np.uint8)
        assert langid.without_markup(both, np.array([0, len(raw), len(both)])).tobytes().split()[:7] == [b"x", b"z", b"3", b"<", b"4", b"<b", b"unclosed" + after[:1]]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    fitted = langid.fit(docs)
    assert fitted.languages == ["und"]
    assert run(spark, [], fitted) == {}
    assert run(spark, [(1, None, "abc def")], fitted)[1].lang == "und"
    assert math.isfinite(run(spark, [(1, None, "abc def")], fitted)[1].probability)


def brute(rows, fitted):
    """Posterior of each row, by loops over rows and languages."""
    k = len(fitted.languages)
    logs, shares, facts = [], [], []
    for _, url, html in rows:
        data = np.frombuffer((html or "").encode(), np.uint8)
        at = np.array([0, len(data)])
        log = fitted.likelihoods(langid.without_markup(data, at), at)[0]
        logs.append(log)
        shares.append(np.exp(log) / np.exp(log).sum())
        host = (url or "").split("://")[1].split("/")[0].lower() if "://" in (url or "") else ""
        head = (html or "").split("<html lang=", 1)
        facts.append((host, ".".join(host.split(".")[-2:]), host.split(".")[-1] if "." in host else "", head[1].strip("\"'")[:2].lower() if len(head) > 1 else ""))
    whole = np.sum(shares, axis=0)
    base = (whole + 1) / (whole.sum() + k)
    out = []
    for n, (host, domain, suffix, declared) in enumerate(facts):
        same = lambda place, value: np.sum([s for s, f in zip(shares, facts, strict=True) if f[place] == value], axis=0)  # noqa: E731, B023
        score = logs[n].copy()
        if host:
            in_host, in_domain = np.maximum(same(0, host) - shares[n], 0), np.maximum(same(1, domain) - shares[n], 0)
            own = (in_domain + langid.DOMAIN_WEIGHT * base) / (max(same(1, domain).sum() - 1, 0) + langid.DOMAIN_WEIGHT)
            score += np.log((in_host + langid.HOST_WEIGHT * own) / (max(same(0, host).sum() - 1, 0) + langid.HOST_WEIGHT))
        else:
            score += np.log(base)
        for place, value in ((3, declared), (2, suffix)):
            if value:
                with_value = same(place, value)
                score += np.log((with_value + langid.VALUE_WEIGHT * with_value.sum() / max(whole.sum(), 1) + langid.FLOOR) / (whole + langid.VALUE_WEIGHT))
        weight = np.exp(score - score.max())
        out.append((fitted.languages[int(score.argmax())], 1 / weight.sum()))
    return out


def test_fusion_matches_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        lang = rng.choice(["aa", "bb"])
        url = rng.choice([None, "", "no address", f"http://h{k % 5}.d{k % 3}.{lang}/x", f"https://d{k % 3}.net/"])
        body = rng.choice(["", "12 ?", text(lang, rng.randrange(1, 4), rng)])
        rows.append((k, url, rng.choice([None, body, f'<html lang="{rng.choice(["aa", "bb", "zz"])}"><p>{body}</p>'])))
    fitted = model(rng)
    got = run(spark, rows, fitted)
    for (k, _, _), (lang, probability) in zip(rows, brute(rows, fitted), strict=True):
        assert got[k].probability == pytest.approx(probability, rel=1e-6) and (got[k].lang == lang or probability < 0.5 + 1e-6)


def test_grouped_counts_long_texts_and_clashing_names(spark):
    rng = random.Random(9)
    rows = [(k, f"http://s{k}.net/", text("aa" if k % 2 else "bb", 20, rng)) for k in range(12)] + [(99, None, text("aa", 40_000, rng))]
    labelled = [(("aa" if k % 2 else "bb"), t) for k, _, t in rows]
    docs = spark.createDataFrame([*labelled, (None, "no label"), ("aa", None)], "lang string, text string")
    fitted = langid.fit(docs.repartition(3), per_language=1 << 40)
    assert fitted.languages == ["aa", "bb"] and np.allclose(fitted.table, langid.TextModel.of([t.encode() for _, t in labelled], [x for x, _ in labelled]).table)
    pages = spark.createDataFrame([(k, 1, 2.0, u, h, "x") for k, u, h in rows], "page_id long, log int, share double, url string, html string, lang string")
    ready = langid.evidence_rows(pages, "html", langid.host_of(F.col("url")), F.lit(""), markup=False)
    out = langid.identify(ready, fitted, ["page_id", "log", "share", "lang"])
    assert out.columns == ["page_id", "log", "share", *langid.RESULTS]
    assert {r.page_id: r.lang for r in out.collect()} == {k: x for (k, _, _), (x, _) in zip(rows, labelled, strict=True)}


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame([(x, "words of it") for x in "abc"], "lang string, text string"))
