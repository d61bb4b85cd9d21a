"""Windows without a key, range search with bounds, and groups that meet in parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sameword.functions import text as T
from sameword.operators import ingest, order, salted, sketch, windowed

HOUR = 3_600_000_000


def crowd(n, seed=1):
    """(id, time): half of the rows in one hour, many of them at one moment."""
    draw = random.Random(seed)
    return [(f"{i:04d}", 10 * HOUR + draw.choice([0, 0, draw.randrange(HOUR)]) if i % 2 else draw.randrange(100 * HOUR)) for i in range(n)] + [("late", None)]


def timed(spark, rows):
    return spark.createDataFrame(rows, "id string, t long").select("id", F.timestamp_micros("t").alias("at"))


def pairs(rows, width):
    t = sorted((t, i) for i, t in rows if t is not None)
    return [(a[1], b[1]) for k, a in enumerate(t) for b in t[k + 1 :] if b[0] < a[0] + width]


@pytest.mark.parametrize("width", [HOUR, 7 * HOUR])
def test_global_frame_and_pairs(spark, monkeypatch, width):
    monkeypatch.setattr(windowed, "RUN", 7)
    rows = crowd(160)
    want = pairs(rows, width)
    found = windowed.followers(timed(spark, rows), "id", "at", width).collect()
    assert {r.id: r.n_after for r in found} == {i: sum(a == i for a, _ in want) for i, t in rows if t is not None}
    assert sorted((r.id_a, r.id_b) for r in windowed.window_pairs(timed(spark, rows), "id", "at", width).collect()) == sorted(want)
    assert windowed.window_pairs(timed(spark, rows[:0]), "id", "at", width).count() == 0


def test_places(spark):
    rows = [(i % 5 if i % 7 else None, i) for i in range(100)]
    t = spark.createDataFrame(rows, "g long, i long").repartition(7)
    assert sorted((r.i, r.place) for r in order.numbered(t, F.desc("i")).collect()) == [(i, 99 - i) for i in range(100)]
    got = order.numbered_within(t, "g", "i").collect()
    for g in (None, *range(5)):
        members = [i for h, i in rows if h == g]
        assert sorted((r.place, r.i, r["size"]) for r in got if r.g == g) == [(k, i, len(members)) for k, i in enumerate(members)]
    sums = order.running(t, {"ahead": F.col("i") * 2}, "i").collect()
    assert {r.i: r.ahead for r in sums} == {i: i * (i - 1) for i in range(100)}


def vectors(n, dims, norms=(1.0, 2.0), seed=2):
    """Around ten centres, so that bounds can tell blocks apart; some odd ones."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(10, dims))
    v = centres[draw.integers(0, 10, n)] + 0.15 * draw.normal(size=(n, dims))
    v *= draw.choice(norms, n)[:, None] / np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, int(draw.integers(0, 20 * 24)) * HOUR if i % 3 else 5 * 24 * HOUR, [float(x) for x in v[i]]) for i in range(n)]
    rows += [(n, 0, [0.0] * dims), (n + 1, 0, None), (n + 2, 0, [1.0]), (n + 3, 0, [1.0]), (n + 4, 1, [])]
    return rows


@pytest.mark.parametrize("least", [0.95, 0.3, -0.2])
def test_bounds_lose_no_pair(spark, least):
    rows = vectors(300, 16)
    t = spark.createDataFrame(rows, "id long, t long, v array<double>").withColumn("at", F.timestamp_micros("t"))
    got = {(r.id_a, r.id_b): r.cos for r in windowed.cosine_pairs(t, "id", "at", "v", 2, least, block=16).collect()}
    real = sorted((x for x in rows if x[2] is not None), key=lambda x: (x[1], x[0]))
    want = {}
    for k, (a, ta, va) in enumerate(real):
        for b, tb, vb in real[k + 1 :]:
            if tb < ta + 3 * windowed.DAY and len(va) == len(vb) and (cos := float(np.dot(va, vb))) >= least:
                want[a, b] = cos
    edge = {p for p in set(got) ^ set(want) if abs((got | want)[p] - least) > 1e-9}  # sums in another order
    assert not edge and all(abs(got[p] - want[p]) < 1e-9 for p in set(got) & set(want))


def test_bounds_save_products(spark):
    rows = vectors(1500, 16, (1.0,))[:1500]
    t = spark.createDataFrame(rows, "id long, t long, v array<double>").withColumn("at", F.timestamp_micros("t"))
    packed = windowed.vector_blocks(t, "id", "at", "v", 2, 32)
    near, every = (windowed.near_blocks(packed, 3 * windowed.DAY, x).count() for x in (0.95, -100.0))
    assert near < every / 3


def test_a_key_with_most_rows_meets_in_parts(spark):
    """90 % of the rows are copies; no task has them all where they meet what is held of them."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, 7).when(F.col("id") % 20 > 0, F.col("id")).alias("k"))
    held = rows.groupBy("k").agg(F.min("id").alias("low"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = salted.meet(rows, held, ["k"], ["id"]).withColumn("p", F.spark_partition_id())
        got = met.groupBy("p").agg(F.count("*").alias("n")).collect()
        assert sum(r.n for r in got) == 20_000 and max(r.n for r in got) < 0.5 * 20_000
        assert met.where("not (low <=> case when k = 7 then 1 when k is null then 0 else id end)").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    left = salted.meet(rows, held.where("k = 7"), ["k"], ["id"], "left")
    assert left.count() == 20_000 and left.where("low is null").count() == 2_000


def test_groups_and_merges_of_many_copies(spark):
    text = "x" * 60
    rows = [(i, text if i % 4 else f"own text number {i} " + "y" * 50, None if i % 3 else 5 + i) for i in range(200)]
    t = spark.createDataFrame(rows, "doc_id long, text string, true_cluster_id long")
    got = {r.doc_id: r.true_cluster_id for r in ingest.merge_labels(t, F.col("text"), "doc_id").collect()}
    assert got == {i: (1 if i % 4 else (5 + i if i % 3 == 0 else i)) for i in range(200)}
    later = {r.doc_id: r.true_cluster_id for r in ingest.merge_later(t, F.col("text"), "doc_id").collect()}
    assert later == {i: (None if i % 4 else tc) for i, _, tc in rows}
    sig = t.select(F.col("doc_id").alias("id"), (-F.col("doc_id")).alias("at"), F.when(F.col("doc_id") % 4 > 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array("doc_id")).alias("sig"))
    groups = {r.member_id: r.rep_id for r in sketch.signature_groups(sig, "id", "at").collect()}
    assert groups == {i: (199 if i % 4 else i) for i in range(200)}


def test_lines_of_a_dictionary(spark):
    long, other = "a line that is long enough", "another one that is long"
    rows = [(1, f"{long}\nkept\n\n {long} \nend"), (2, long), (3, None), (4, ""), (5, f"\n\n{other}\n"), (6, "short\n" * 3)]
    t = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1))
    got = ingest.drop_known_lines(t, "doc_id", "text", spark.createDataFrame([(long,), ("short",), (long,)], "line string"))
    assert got.columns == t.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "kept\n\nend", 2: "", 3: None, 4: "", 5: f"\n\n{other}\n", 6: "short\n" * 3}
    lines = spark.createDataFrame([(1, f"{long}\n{long}\nx"), (2, f" {long}\n{other}"), (3, "x\n\n")], "doc_id long, text string")
    assert {(r.line, r.df) for r in ingest.frequent_lines(lines, "doc_id", "text", 2).collect()} == {(long, 2)}


def test_vectors_of_words(spark):
    rows = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "c " * 700)], "id long, text string")
    got = {r.id: r.v for r in windowed.hashed_vectors(rows, "id", T.tokens(F.col("text")), 8).collect()}
    assert set(got) == {1, 4} and all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in got.values()) and sorted(map(abs, got[4]))[-2:] == [0.0, 1.0]


@pytest.mark.parametrize("least", [0.5, 0.7, 0.9, 1.0])
def test_jaccard_pairs_as_brute_force(spark, least):
    draw = random.Random(int(least * 10))
    vocabulary = [f"w{i}" for i in range(60)]
    sets = [[draw.choice(vocabulary) for _ in range(draw.randrange(1, 25))] for _ in range(40)]
    for s in sets[:30]:
        for _ in range(2):
            sets.append([w for w in s if draw.random() > 0.1] + [draw.choice(vocabulary)] * draw.randrange(2))
    rows = [(f"{i:03d}", s) for i, s in enumerate(sets)] + [("900", []), ("901", []), ("902", None)]
    got = {(r.id_a, r.id_b): r.jaccard for r in sketch.jaccard_pairs(spark.createDataFrame(rows, "id string, t array<string>"), "id", "t", least).collect()}
    first, want = {}, {}
    for i, s in rows:
        if s:
            rep = first.setdefault(frozenset(s), i)
            want |= {(rep, i): 1.0} if rep != i else {}
    for a, x in first.items():
        for b, y in first.items():
            if x < y and (j := len(a & b) / len(a | b)) >= least:
                want[x, y] = j
    assert got == want


@pytest.mark.parametrize("least", [0.5, 0.7])
def test_jaccard_candidates_are_weighed_where_they_meet(spark, monkeypatch, least):
    """Sets of two common words and many of their own meet in every shard; few pairs leave it, and none that links is lost, in
    many small shards, pieces and cells too (round 3, F5)."""
    import numpy as np

    for name, value in (("SHARD_WORDS", 300), ("WEIGHED", 50), ("MEMBERS", 3), ("PAIRS", 20)):
        monkeypatch.setattr(sketch, name, value)
    draw = random.Random(3)
    sets = [[f"w{draw.randrange(300)}" for _ in range(60)] + ["same", "too"] for _ in range(60)]
    sets += [[w for w in s if draw.random() > 0.12] for s in sets[:4] for _ in range(8)] + [["same"], ["too", "same"]]
    moved, real = [], sketch.near_pairs
    monkeypatch.setattr(sketch, "near_pairs", lambda *a: moved.append((a[1], real(*a))) or moved[-1][1])
    got = {(r.id_a, r.id_b): r.jaccard for r in sketch.jaccard_pairs(spark.createDataFrame(list(enumerate(sets)), "id long, t array<string>"), "id", "t", least).collect()}
    own = {i: set(s) for i, s in enumerate(sets)}
    assert len({frozenset(s) for s in own.values()}) == len(own)
    assert got == {(a, b): j for a in own for b in own if a < b and (j := len(own[a] & own[b]) / len(own[a] | own[b])) >= least}
    shards, pairs = moved[0]
    assert shards > 2 and len(got) > 50 and pairs.count() < len(own) * (len(own) - 1) / 6
    none = sketch.near_sets(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros((0, 8), np.uint64), least)
    assert none.shape == (0, 2)


def test_a_pair_on_the_threshold_is_in(spark):
    """The exact product over both norms is 0.9 here, that of normalised vectors 0.8999999999999999 (round 3, F9 and F10)."""
    rows = [("1", [3.0, 4.0, 2.0, 1.0], [5, 6, 7, 1 << 32]), ("2", [2.0, 3.0, 4.0, 1.0], [5, 6, 8, 1 << 32]), ("3", [0.0] * 4, [5, 6, 7, 0]), ("4", [1.0, 0.0, 0.0, 0.0], [5, 6, 7, 0])]
    t = spark.createDataFrame(rows, "id string, v array<double>, sig array<bigint>").withColumn("at", F.timestamp_micros(F.lit(0)))
    assert [tuple(r) for r in windowed.cosine_pairs(t, "id", "at", "v", 2, 0.9, cosine=True).collect()] == [("1", "2", 0.9)]
    assert [tuple(r) for r in windowed.cosine_pairs(t, "id", "at", "v", 2, 0.9, cosine=True, sig_col="sig", veto=0.75).collect()] == [("1", "2", 0.9, 0.75)]
    assert windowed.cosine_pairs(t, "id", "at", "v", 2, 0.9, cosine=True, sig_col="sig", veto=0.76).count() == 0


def test_blocks_move_once_for_a_pair_of_groups(spark, monkeypatch):
    """Near copies of one day: what meets is blocks by groups, not a copy of a block for each of its partners."""
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.integers(1, 5, 8)]) for i in range(400)]
    t = spark.createDataFrame(rows, "id long, v array<double>").withColumn("at", F.timestamp_micros(F.lit(0)))
    found, put = [], windowed.stage
    monkeypatch.setattr(windowed, "stage", lambda df, name: (found.append((name, put(df, name))), found[-1][1])[1])
    n = windowed.cosine_pairs(t, "id", "at", "v", 2, 0.8, block=16, cosine=True).count()
    met = dict(found)["vector-pairs"]
    groups = met.select(F.shiftright("block_x", 33).alias("x"), F.shiftright("block_y", 33).alias("y")).distinct().count()
    assert met.count() >= 25 * 26 // 2 and groups == 1
    v = np.array([x for _, x in rows])
    cos = v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    assert abs(n - (np.triu(cos >= 0.8, 1)).sum()) <= 2


def test_window_pairs_move_blocks(spark, monkeypatch):
    """Every row is near every other: a row of what moves stands for many pairs (round 3, F6)."""
    monkeypatch.setattr(windowed, "RUN", 50)
    rows = [(f"{i:04d}", i % 7) for i in range(400)]
    placed = windowed.followers(timed(spark, rows), "id", "at", HOUR)
    assert windowed.place_blocks(placed).count() == 8 * 9 // 2
    assert sorted((r.id_a, r.id_b) for r in windowed.window_pairs(timed(spark, rows), "id", "at", HOUR).collect()) == sorted(pairs([(i, t) for i, t in rows], HOUR))


def test_thresholds_count_and_join_where_blocks_meet(spark, monkeypatch):
    """Every point of a grid at once, in many small blocks: the counts of the pairs and their components, and a link a row and
    point at most from two groups, where the pairs are many times that (round 4, F1)."""
    monkeypatch.setattr(windowed, "GROUP", 4)
    draw = np.random.default_rng(5)
    rows = [(str(i), int(draw.integers(0, 20)) * windowed.DAY // 2, [float(x) for x in draw.integers(1, 5, 8)], [int(x) for x in draw.integers(0, 2, 16)]) for i in range(300)]
    t = spark.createDataFrame(rows, "id string, t long, v array<double>, sig array<bigint>").withColumn("at", F.timestamp_micros("t"))
    grid = [(0.8, 0.0), (0.8, 0.6), (0.95, 0.0), (0.95, 0.75), (2.0, 0.0)]
    pairs = [tuple(r) for r in windowed.cosine_pairs(t, "id", "at", "v", 2, 0.8, cosine=True, sig_col="sig", veto=0.0).collect()]
    found, names = windowed.cosine_thresholds(t, "id", "at", "v", 2, grid, block=16, cosine=True)
    found, name = found.collect(), {r.node: r.id for r in names.collect()}
    assert len(pairs) > 5_000 and sum(r.n is None for r in found) < len(pairs)

    def parts(links):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for a, b in links:
            root[find(a)] = find(b)
        return {frozenset(y for y in root if find(y) == find(x)) for x in list(root)}

    for k, (c, j) in enumerate(grid):
        want = [(a, b) for a, b, x, y in pairs if x >= c and y >= j]
        assert sum(r.n or 0 for r in found if r.point == k) == len(want)
        assert parts([(name[r.a], name[r.b]) for r in found if r.point == k and r.n is None]) == parts(want)


def test_equal_shares():
    draw = np.random.default_rng(6)
    for n in (0, 5, 128, 256):
        a, b = draw.integers(0, 2, (2, 7, n))
        x, y = draw.integers(0, 7, (2, 20))
        assert n == 0 or (windowed.equal_shares(a, b, x, y) == (a[x] == b[y]).mean(1)).all()
    one = np.ones((1, 128), np.uint32)
    assert windowed.equal_shares(one, one, np.zeros(1, int), np.zeros(1, int)).tolist() == [1.0]
