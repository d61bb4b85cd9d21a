import math

import pytest
from pyspark.sql import functions as F

from sameword.llm.mixing import bisect_exponent, mix, mix_order

ROWS = [(i, "w " * 10, "big") for i in range(300)] + [(1000 + i, "a b c d e", "small") for i in range(20)] + [(2000, None, None), (2001, "", None), (None, " ", None), (5, "w " * 10, "big"), (5, "w " * 10, "big")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("mix") / "t")
    spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 as id", "2 as tokens", "3 as weight", "4 as budget", "5 as block", "6 as seq", "7 as turn").write.parquet(at)
    return spark.read.parquet(at)


def test_no_source_repeats_more_than_allowed_and_every_row_comes(docs):
    got = mix_order(docs, block_tokens=200, repeats=2.0).collect()
    share = {}
    for r in got:
        share.setdefault(r.source, []).append(r.tokens)
    total = {"big": 3020, "small": 100, None: 3}
    # the last row of a budget may stand over its end, by less than its own tokens
    assert all(0.99 <= sum(v) / total[s] < 2.0 + {"big": 10, "small": 5, None: 1}[s] / total[s] for s, v in share.items())
    assert len({(r.at_file, r.at_row) for r in got}) == len(ROWS)
    for s in total:  # an epoch holds a row once
        places = [(r.at_file, r.at_row, r.epoch) for r in got if r.source == s]
        assert len(places) == len(set(places))
    assert sum(r.weight for r in {r.source: r for r in got}.values()) == pytest.approx(1)


def entropy_of(tokens, x):
    w = [t**x for t in tokens]
    return -sum(v / sum(w) * math.log(v / sum(w)) for v in w if v)


def test_any_entropy_is_met_or_refused(spark):
    tokens = [1000, 500, 30, 1, 1]
    totals = spark.createDataFrame([(str(i), t) for i, t in enumerate(tokens)], "source string, tokens long")
    for wanted in (0.05, 0.3, 0.65, entropy_of(tokens, 1.0), 1.2, 1.5):  # 0.7 is what they have by themselves
        assert abs(entropy_of(tokens, bisect_exponent(totals, entropy=wanted)) - wanted) < 1e-3
    for wanted in (-0.1, 1.7):
        with pytest.raises(ValueError, match="no exponent"):
            bisect_exponent(totals, entropy=wanted)
    same = totals.withColumn("tokens", F.lit(7).cast("long"))
    assert bisect_exponent(same, entropy=math.log(5)) == 1.0
    with pytest.raises(ValueError, match="no exponent"):
        bisect_exponent(same, entropy=1.0)


def test_mix_above_one_takes_from_small_sources(spark):
    docs = spark.createDataFrame([(i, "big" if i < 30 else "small", "one two three four") for i in range(40)], "doc_id long, source string, text string")
    got = mix_order(docs, entropy=0.3, block_tokens=40).groupBy("source").agg(F.sum("tokens").alias("n"), F.first("weight").alias("w")).collect()
    n, w = {r.source: r.n for r in got}, {r.source: r.w for r in got}
    assert abs(-sum(x * math.log(x) for x in w.values()) - 0.3) < 1e-3
    assert all(abs(n[s] - 160 * w[s]) <= 4 for s in n) and n["small"] < 40 < 120 < n["big"]


def test_exponent_meets_the_entropy(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    x = bisect_exponent(totals, entropy=0.9)
    w = [n**x for n in (900, 90, 10)]
    assert -sum(v / sum(w) * math.log(v / sum(w)) for v in w) == pytest.approx(0.9, abs=1e-4)
    x = bisect_exponent(totals, repeats=3.0)
    assert (900 / 10) ** (1 - x) == pytest.approx(3.0, rel=1e-4)
    assert bisect_exponent(totals.where("source = 'a'"), repeats=2.0) == 0.0


def test_columns_stay_and_empty(docs):
    mixed = mix(docs, block_tokens=200)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {r[0] for r in ROWS}
    assert mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("how", [{"repeats": 2.0}, {"repeats": 3.5}, {"entropy": 0.4}, {"repeats": 2.0, "budget": 5000.0}])
def test_order_and_budget_as_brute_force(spark, docs, how):
    """The whole mix again, row by row: weights, budgets, blocks in hashed order in every epoch, and where each stops."""
    block, seed = 200, 17
    got = mix_order(docs, block_tokens=block, **how).collect()
    rows = {(r.at_file, r.at_row): (r.source, r.tokens) for r in mix_order(docs, block_tokens=block, budget=1e6).collect()}
    totals = {}
    for s, n in rows.values():
        totals[s] = totals.get(s, 0) + n
    every = sum(totals.values())
    weights = lambda x: {s: n**x / sum(m**x for m in totals.values()) for s, n in totals.items()}
    if "entropy" in how:
        fits = lambda x: -sum(v * math.log(v) for v in weights(x).values()) >= how["entropy"]
    else:
        fits = lambda x: (lambda r: max(r) / min(r) <= how["repeats"])([w / (totals[s] / every) for s, w in weights(x).items()])
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if fits(mid) == ("entropy" in how):
            low = mid
        else:
            high = mid
    w = weights(low if "entropy" in how else high)
    whole = how.get("budget") or max(totals[s] / w[s] for s in totals)
    own = {r.source: r.weight for r in got}
    assert all(own[s] == pytest.approx(w[s], rel=1e-4) for s in totals)
    keys = spark.createDataFrame([(f, r, e) for f, r in rows for e in range(60)], "f long, r long, e int")
    turn = {(x.f, x.r, x.e): x.t for x in keys.select("f", "r", "e", F.xxhash64("f", "r", "e", F.lit(seed)).alias("t")).collect()}
    place = {(x.f, x.r): x.h for x in keys.where("e = 0").select("f", "r", F.xxhash64("f", "r", F.lit(seed)).alias("h")).collect()}
    blocks = spark.createDataFrame([(b, e) for b in range(40) for e in range(60)], "b long, e int")
    block_turn = {(x.b, x.e): x.t for x in blocks.select("b", "e", F.xxhash64("e", "b", F.lit(seed)).alias("t")).collect()}
    want = {}
    for s, n in totals.items():
        budget, count, start = max(1, math.floor(own[s] * (how.get("budget") or max(totals[k] / own[k] for k in totals)) + 0.5)), -(-n // block), 0
        assert abs(budget - w[s] * whole) <= 1 + 1e-3 * budget
        mine = [k for k in rows if rows[k][0] == s]
        for e in range(-(-budget // n)):
            for k in sorted(mine, key=lambda k: (block_turn[place[k] % count, e], place[k] % count, turn[(*k, e)], k)):
                if start < budget:
                    want[(*k, e)] = (place[k] % count, start / budget)
                start += rows[k][1]
    assert {(r.at_file, r.at_row, r.epoch): r.block for r in got} == {k: v[0] for k, v in want.items()} and len(got) == len(want)
    assert all(r.seq == pytest.approx(want[r.at_file, r.at_row, r.epoch][1], abs=1e-9) for r in got)


def test_names_that_clash(spark, tmp_path):
    rows = [(i, "a b c " * (i + 1), "x" if i % 3 else "y", i) for i in range(30)]
    names = "doc_id long, text string, source string, _metadata long"
    for extra in ("_at_file", "_at_row", "_mix_seq", "at_file", "seq"):
        names += f", `{extra}` long"
    table = spark.createDataFrame([(*r, *[r[0]] * 5) for r in rows], names)
    table.write.parquet(str(tmp_path / "t"))
    for docs in (table, spark.read.parquet(str(tmp_path / "t"))):
        mixed = mix(docs)
        got = mixed.collect()
        assert mixed.columns == docs.columns and {r.doc_id for r in got} == set(range(30))
        assert all(r._metadata == r.doc_id == r._at_file == r._mix_seq == r.seq for r in got)
