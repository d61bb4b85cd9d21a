import numpy as np
from pyspark.sql import functions as F

from sameword.llm.hnsw import nearest


def brute(rows, k, every):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in good.items():
        if q % every == 0:
            s = [(-float(a @ b) / np.sqrt(a @ a) / np.sqrt(b @ b), i) for i, b in good.items() if i != q and len(a) == len(b)]
            out[q] = sorted(s)[:k]
    return out


def test_recall_copies_and_odd_vectors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 24)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5010, []), (5020, [0.0] * 24), (5030, [float("nan")] * 24), (5040, [None] + [1.0] * 23), (5050, [1.0, 2.0]), (5060, [2.0, 4.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as shard", "3 as v")
    got = {}
    for row in nearest(df, F.col("vec_id") % 50 == 0, shard_size=1000).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.score, row.id))
    want = brute(rows, 5, 50)
    assert set(got) == set(want) and got[5050][0][1] == 5060 and len(got[5050]) == 1
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert [i for _, i in got[200]] == [100, 101, 102, 103, 104]
    for q in got:
        exact = {i: -s for s, i in brute([(i, v) for i, v in rows if i == q or i in {j for _, j in got[q]}], 9, 50)[q]}
        assert all(abs(exact[i] - s) < 1e-12 for s, i in got[q])


def test_empty(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_recall_on_the_tables_vectors(spark):
    """64 dimensions, in one shard and in several; and by the rule that counts cores."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    want = brute([(i, v.tolist()) for i, v in x.items()], 5, 50)
    for size in (None, 700, 250):
        got = {}
        for r in nearest(df, F.col("vec_id") % 50 == 0, shard_size=size, block=16).collect():
            got.setdefault(r.query_id, set()).add(r.id)
        hits = sum(len({i for _, i in want[q]} & got[q]) for q in want)
        assert set(got) == set(want) and hits >= 0.97 * sum(map(len, want.values()))


def test_identifiers_of_several_vectors(spark):
    """7 is a candidate once, by its nearer vector; 50 asks with the lesser of its two."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [0.0, 2.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.id, round(r.score, 6)) for r in nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(1, 7, 1.0), (2, 8, 0.707107), (3, 9, 0.0)]
