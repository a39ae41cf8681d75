import random

from quernel.llm import line_dedup as ld

LOWER = str.maketrans(ld.UPPER, ld.UPPER.lower())


def brute(rows, min_chars=40, min_docs=5):
    holders = {}
    key = lambda line: line.strip(ld.STRIPPED).translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def result(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_lines int")
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in ld.dedup_lines(docs, **options).collect())


def sample():
    rng = random.Random(6)
    lines = [f"Common line number {k} with enough characters É" + "x" * k for k in range(8)] + ["short", "", "   ", "Z" * 39, "Z" * 40]
    rows = []
    for k in range(80):
        some = [rng.choice([x, x.upper() if "É" not in x else x, f" \t{x}\r"]) for x in rng.choices(lines, k=rng.randrange(0, 9))]
        rows.append((k * 13 % 80 + 5, "\n".join(some)))
    return rows


def test_matches_brute_force(spark):
    rows = sample() + [(900, None), (901, ""), (None, "\n".join(x for x in sample()[0][1].split("\n"))), (7, sample()[3][1]), (902, "long " * 30000)]
    assert result(spark, rows) == brute(rows)


def test_any_number_of_batches_gives_the_same(spark):
    rows = sample()
    assert result(spark, rows, batches=1) == result(spark, rows, batches=7) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_levels_are_compacted(spark):
    runs = ld.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, 10 - k), (2, k, 10 - k)], f"{ld.HASH[0]} long, {ld.HASH[1]} long, _ld_doc long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {(r[0], r[1]): (r[2], r[3]) for r in runs.single().collect()}
    assert got[1, 1] == (5, 10) and got[2, 4] == (1, 6)
