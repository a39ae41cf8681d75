import numpy as np

from quernel.llm import mixing
from quernel.session import Scratch


def brute_rake(cells, goals, sweeps=200):
    w = {k: float(v) for k, v in cells.items()}
    total = sum(w.values())
    w = {k: v / total for k, v in w.items()}
    for _ in range(sweeps):
        for d in range(3):
            sums = {}
            for k, v in w.items():
                sums[k[d]] = sums.get(k[d], 0) + v
            w = {k: v * goals[d].get(k[d], 0) / sums[k[d]] if sums[k[d]] else 0 for k, v in w.items()}
    return w


def test_marginals_and_factors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): int(rng.integers(1, 1000)) for a in range(4) for b in range(3) for c in range(3)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    goals = [{"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1}, {"l0": 0.5, "l1": 0.3, "l2": 0.2}, {"t0": 0.2, "t1": 0.2, "t2": 0.6}]
    tables = {d: mixing.target_table(df, d, g, 1.0) for d, g in zip(mixing.DIMS, goals, strict=True)}
    got = {(r.source, r.lang, r.topic): r.tokens * r.factor for r in mixing.rake(df, tables, Scratch(spark, "t"), tolerance=1e-9).collect()}
    want = brute_rake(cells, goals)
    assert all(abs(got[k] - want[k]) < 1e-7 for k in want)


def docs(spark):
    rows = [(k, " ".join(["word"] * (k % 50 + 1)), ["en", "de", None][k % 3], f"s{min(k % 7, 3)}", "x") for k in range(700)]
    rows += [(1000, None, "en", "s0", "x"), (1001, "", None, None, "x"), (None, "a b", "en", "s1", "x"), (3, "again three words", "de", "s1", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, factor string")


def test_probabilities_keep_the_share(spark):
    rows = mixing.probabilities(docs(spark), keep=0.5).collect()
    assert len(rows) == 704 and all(0 <= r.probability <= 1 for r in rows)
    total = sum(r.n_tokens for r in rows)
    assert abs(sum(r.n_tokens * r.probability for r in rows) - 0.5 * total) < 1e-6 * total
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (5, 1000, 1001)} == {5: 6, 1000: 0, 1001: 0}


def test_sampling_is_by_id_and_repeatable(spark):
    first = sorted(r.doc_id or -1 for r in mixing.sample(docs(spark)).collect())
    again = sorted(r.doc_id or -1 for r in mixing.sample(docs(spark).repartition(5)).collect())
    assert first == again and first.count(3) in (0, 2)
    kept = mixing.sample(docs(spark), targets={"lang": {"de": 1.0}})
    assert {r.lang for r in kept.filter("doc_id <> 3").select("lang").distinct().collect()} == {"de"}


def test_empty_table_own_topic_and_no_tokens(spark):
    assert mixing.probabilities(docs(spark).limit(0)).count() == 0
    own = docs(spark).limit(3).selectExpr("*", "'mine' AS topic")
    assert {r.topic for r in mixing.probabilities(own).collect()} == {"mine"}
    blank = spark.createDataFrame([(1, None, "en", "a"), (2, "", "de", "b")], "doc_id long, text string, lang string, source string")
    assert all(r.selected for r in mixing.probabilities(blank).collect())


def skewed(spark):
    rng = np.random.default_rng(3)
    langs = rng.choice(["en", "de", "fr"], 3000, p=[0.85, 0.1, 0.05])
    rows = [(k, " ".join(["word"] * int(rng.integers(5, 40))), str(langs[k]), ["hot", "rare", "other"][0 if k % 3 == 0 else 1 if k % 50 == 1 else 2]) for k in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_delivered_shares_are_the_targets(spark):
    goal = {"en": 0.4, "de": 0.3, "fr": 0.3}
    rows = mixing.probabilities(skewed(spark), targets={"lang": goal}).collect()
    total = sum(r.n_tokens for r in rows)
    share = lambda name, weight: sum(r.n_tokens * weight(r) for r in rows if r.lang == name) / sum(r.n_tokens * weight(r) for r in rows)
    for name, want in goal.items():
        assert abs(share(name, lambda r: r.expected) - want) < 1e-3
        assert abs(share(name, lambda r: r.draws) - want) < 0.03
    assert abs(sum(r.n_tokens * r.expected for r in rows) - mixing.KEEP * total) < 1e-6 * total
    assert max(r.expected for r in rows) > 1 and all(r.calibrated for r in rows)
    assert all(r.draws - r.expected < 1 and r.expected - r.draws < 1 and r.selected == (r.draws > 0) for r in rows)


def test_sample_repeats_what_is_weighted_up(spark):
    data, options = skewed(spark), {"targets": {"lang": {"en": 0.4, "de": 0.3, "fr": 0.3}}}
    want = {r.doc_id: r.draws for r in mixing.probabilities(data, **options).collect() if r.draws}
    got = [r.doc_id for r in mixing.sample(data, **options).collect()]
    assert max(want.values()) > 1 and {k: got.count(k) for k in set(got)} == want
    assert mixing.sample(data, **options).columns == data.columns


def test_targets_out_of_reach_are_reported(spark):
    targets = {"lang": {"en": 0.25, "de": 0.25, "fr": 0.25, "xx": 0.25}}
    shares = {(r.dim, r.value): r for r in mixing.report(skewed(spark), targets).collect()}
    assert (shares["lang", "xx"].asked, shares["lang", "xx"].reached) == (0.25, 0.0)
    assert abs(shares["lang", "en"].reached - 1 / 3) < 1e-3 and abs(sum(r.reached for (d, _), r in shares.items() if d == "lang") - 1) < 1e-6
    assert not any(r.calibrated for r in mixing.probabilities(skewed(spark), targets=targets).collect())
    # a language of one source only: both targets cannot hold
    tied = spark.createDataFrame([(k, "some words here", ["en", "de"][k % 2], ["a", "b"][k % 2]) for k in range(100)], "doc_id long, text string, lang string, source string")
    rows = mixing.probabilities(tied, targets={"lang": {"en": 0.9, "de": 0.1}, "source": {"a": 0.1, "b": 0.9}}).collect()
    assert not any(r.calibrated for r in rows) and min(r.miss for r in rows) > 0.1


def test_raking_takes_no_job_for_a_sweep_and_tables_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(0, 9)) * 10**a) for a in range(5) for b in range(4) for c in range(3) if (a + b + c) % 4], "source string, lang string, topic string, tokens long")
    tables = {d: mixing.target_table(cells, d, {"l0": 0.7, "l1": 0.2, "zz": 0.1} if d == "lang" else None, 0.5) for d in mixing.DIMS}

    def raked(group, cells=cells):
        spark.sparkContext.setJobGroup(group, group)
        out = {tuple(r[d] for d in mixing.DIMS): r.factor for r in mixing.rake(cells, tables, Scratch(spark, "t")).collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    held, jobs = raked("held-cells")
    assert jobs < 15 and raked("no-cells", cells.limit(0))[0] == {}
    monkeypatch.setattr(mixing, "HELD_CELLS", 0)
    wide, more = raked("wide-cells")
    assert more > jobs and held.keys() == wide.keys() and len(held) == cells.count()
    assert all(abs(held[k] - wide[k]) <= 1e-9 * wide[k] for k in wide) and any(f == 0 for f in held.values())
