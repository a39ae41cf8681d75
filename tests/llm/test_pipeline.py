import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quernel.llm import mixing
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_quality import brute as brute_quality

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(cp.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    good = stages["quality_rules"](spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert all(not brute_quality(text)[5] for text in kept.values())
    assert len(kept) >= 0.6 * len(rows)

    lines = stages["line_dedup"](spark, good, SF)
    assert lines.columns == docs.columns
    after = {r.doc_id: r.text for r in lines.collect()}
    assert after == {i: t for i, _, _, t in brute_lines(list(kept.items()))}
    assert lines.filter(F.col("n_chars") != F.char_length("text")).count() == good.filter(F.col("n_chars") != F.char_length("text")).count()

    near = stages["ngram_join"](spark, lines, SF)
    assert near.columns == docs.columns
    left = {r.doc_id: r.text for r in near.collect()}
    assert set(left) == {i for i, _, c, _ in brute_groups(list(after.items())) if i == c}

    mixed = stages["mixing"](spark, near, SF)
    assert mixed.columns == docs.columns
    chances = {r.doc_id: r.selected for r in mixing.probabilities(near).collect()}
    drawn = {r.doc_id: r.text for r in mixed.collect()}
    assert set(drawn) == {i for i, yes in chances.items() if yes} and len(drawn) >= 0.5 * len(left)

    model = sentencepiece.SentencePieceProcessor(model_file=cp.piece_model())
    ids = stages["sentencepiece"](spark, mixed, SF).collect()
    assert {r.doc_id: r.ids for r in ids} == {i: model.encode(t) for i, t in drawn.items()} and all(r.round_trip for r in ids)
    assert {r.doc_id for r in cp.run(spark, SF).collect()} == set(drawn)


def cases():
    rng = __import__("random").Random(5)
    words = [a + b for a in ("lor", "ips", "dol", "sit", "ame", "con", "adi", "eli", "sed", "tem") for b in ("em", "um", "or", "et", "ti", "na", "qua", "ver")]
    good = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(k, good(60 + k)) for k in range(20)]
    rows += [(100, None), (101, ""), (102, "  \n "), (103, "few words"), (None, good(70)), (None, None), (5, rows[5][1]), (105, rows[5][1]), (106, rows[5][1] + " more"), (107, good(30_000))]
    line = "this line stands in many documents and is longer than forty characters"
    return rows + [(200 + k, good(50) + "\n" + line + "\n" + good(30)) for k in range(6)]


@pytest.mark.parametrize("name", [name for name, _ in cp.STAGES])
def test_cases_of_each_stage(spark, name):
    stage = dict(cp.STAGES)[name]
    clash = ["n_words", "kept", "ratio", "n_lines", "n_dropped", "_nj", "label", "component_id", "rep", "cls", "factor", "draws", "selected", "topic2", "ids", "round_trip", "value"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    rows = [(i, t, [None, "en", "de"][k % 3], ["a", None][k % 2], len(t or ""), *(f"{c}-{k}" for c in clash)) for k, (i, t) in enumerate(cases())]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs.repartition(3), SF)
    got = out.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "sentencepiece":
        assert len(got) == len(rows) and all(r.round_trip and r.n_ids == len(r.ids) for r in got) and {r.n_ids for r in got if r.doc_id in (100, 101)} == {0}
        return
    assert out.schema.names == docs.schema.names
    for r in got:  # the columns' own values
        k = int(r.kept.split("-")[1])
        assert [r[c] for c in clash] == [f"{c}-{k}" for c in clash] and r.doc_id == rows[k][0] and r.lang == rows[k][2]
        assert (r.text or "") == (rows[k][1] or "") or (name == "line_dedup" and r.n_chars == len(r.text) < rows[k][4])
    ids = sorted((r.doc_id for r in got), key=str)
    every = sorted((r[0] for r in rows), key=str)
    if name == "quality_rules":
        assert not {100, 101, 102, 103} & set(ids) and {0, 5, 105, None} <= set(ids) and ids.count(5) == 2
    if name == "line_dedup":
        assert ids == every and sum(r.n_chars < rows[int(r.kept.split("-")[1])][4] for r in got) == 5
    if name == "ngram_join":
        assert 105 not in ids and 106 not in ids and ids.count(5) == 2 and ids.count(None) == 2 and {100, 101, 102, 103, 107} <= set(ids)
    if name == "mixing":
        assert set(ids) <= set(every) and ids.count(5) % 2 == 0
