from pyspark.sql import functions as F

from sameword.config import DedupConfig
from sameword.functions import text as T
from sameword.operators import clusters, ingest, windowed
from sameword.operators.graph import connected_components, louvain
from sameword.plans.pipeline import DedupPipeline, load


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    lit = F.lit
    assert one(spark, T.delete_phrases(lit("abXcd"), ["X", "bc"])) == "ad"
    assert one(spark, T.squeeze(lit(" a \t\n b "))) == "a b"
    assert one(spark, T.tokens(lit("Größe, ПРИВЕТ x_1"))) == ["größe", "привет", "x_1"]
    assert one(spark, T.made_up_title(lit(""), lit("A b. C"))) == "A b..." and one(spark, T.made_up_title(lit(None).cast("string"), lit(""))) == "News Article"
    assert one(spark, T.drop_lines(lit("a line of fifteen\nkept"), F.array(lit("a line of fifteen")))) == "kept"
    assert [one(spark, T.copy_id(lit(x))) for x in ("7", "abc")] == ["1000007", "abc_dup"]
    assert [one(spark, T.reply_labels(lit(r).cast("string"), lit(2))) for r in ("[1,0]", "ok 1 then 0", "none", None)] == [[1, 0], [1, 0], [0, 0], [0, 0]]
    assert DedupConfig(bad_phrases=()).phrases


def test_validation(spark):
    raw = spark.createDataFrame([("1", "t", "x", "s", "2024-01-01T00:00:00", "12"), ("2", None, "x", "s", "2024-01-01", None), ("3", "t", "x", "s", "Mon, 01 Jan 2024 00:00:00 GMT", None), ("4", "t", "x", "s", "2024-01-01", "abc")], "id string, title string, text string, source string, published_at string, true_cluster_id string")
    assert [(r.id, r.true_cluster_id) for r in ingest.validate(raw).collect()] == [("1", 12)]


def test_window(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00"), ("c", "2024-01-06 00:00:00"), ("d", "2024-01-03 23:59:59"), ("e", "2024-01-04 00:00:00"), ("f", "2024-01-01 00:00:00")]
    t = spark.createDataFrame(rows, "id string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {(r.id_a, r.id_b) for r in windowed.band_join(t, "id", "t", 2).collect()}
    assert got == {("a", "f"), ("a", "b"), ("f", "b"), ("a", "d"), ("f", "d"), ("b", "d"), ("b", "e"), ("d", "e"), ("d", "c"), ("e", "c")}


def test_graph_and_metrics(spark):
    v = spark.createDataFrame([(str(i),) for i in range(8)], "id string")
    e = spark.createDataFrame([("0", "1", 1.0), ("1", "2", 0.9), ("0", "2", 1.0), ("2", "3", 0.1), ("3", "4", 1.0), ("4", "5", 1.0), ("3", "5", 1.0)], "id_a string, id_b string, score double")
    comp = {r.id: r.component for r in connected_components(e, "id_a", "id_b").collect()}
    assert comp == dict.fromkeys("012345", "0")
    com = {r.id: r.community for r in louvain(v, e).collect()}
    assert com == {"0": "0", "1": "0", "2": "0", "3": "3", "4": "3", "5": "3", "6": "6", "7": "7"}
    assigned = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, cluster_id string")
    lab = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "id string, label string")
    m = clusters.pair_metrics(assigned, lab).first()
    assert (m.tp, m.fp, m.fn, m.f1) == (1, 0, 0, 1.0) and clusters.adjusted_rand(assigned, lab).first().ari == 1.0


def test_pipeline_without_links(spark):
    a = spark.createDataFrame([("1", "t", "one two three", "s"), ("2", "u", "four five six", "s")], "id string, title string, text string, source string").withColumn("published_at", F.lit("2024-01-01").cast("timestamp"))
    done = DedupPipeline(DedupConfig(num_perm=16)).run(a)
    assert sorted(tuple(r.news_ids) for r in done["clusters"].collect()) == [("1",), ("2",)]


def test_stages_are_measured_on_the_pipelines_own_clusters(spark):
    """Two triangles on one link, which Louvain takes apart and components would not."""
    e = spark.createDataFrame([("0", "1", 1.0), ("1", "2", 0.9), ("0", "2", 1.0), ("2", "3", 0.9), ("3", "4", 1.0), ("4", "5", 1.0), ("3", "5", 1.0)], "id_a string, id_b string, score double")
    groups = spark.createDataFrame([(str(i), str(i)) for i in range(6)], "rep_id string, member_id string")
    lab = spark.createDataFrame([(str(i), "xy"[i // 3]) for i in range(6)], "id string, label string")
    got = {r.stage: (r.tp, r.fp, r.fn, r.ari) for r in DedupPipeline().stage_metrics({"groups": groups, "candidates": e.drop("score"), "approved": e}, lab).collect()}
    assert got == {"prefilter": (0, 0, 6, 0.0), "candidates": (6, 0, 0, 1.0), "rerank": (6, 0, 0, 1.0)}


def test_sweep_clusters_and_evaluates_every_point(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [("1", " ".join(words)), ("2", " ".join([*words[:-1], "other"])), ("3", " ".join(f"v{i}" for i in range(60)))]
    a = spark.createDataFrame(rows, "id string, text string").withColumns({"title": F.lit("t"), "source": F.lit("s"), "published_at": F.lit("2024-01-01").cast("timestamp")})
    lab = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", None)], "id string, label string")
    got = {(r.min_cos, r.min_jac): (r.n_pairs, r.tp, r.fp, r.fn, r.f1, r.ari) for r in DedupPipeline().sweep(a, lab, [(0.8, 0.0), (0.8, 1.0), (-1.0, 0.0)]).collect()}
    assert got == {(0.8, 0.0): (1, 1, 0, 0, 1.0, 1.0), (0.8, 1.0): (0, 0, 0, 1, 0.0, 0.0), (-1.0, 0.0): (3, 1, 2, 0, 0.5, 1.0)}


def test_without_prefilter_no_veto(spark):
    """Equal bags of words in another order, of which a veto by signatures at 1.01 would leave no pair."""
    a = spark.createDataFrame([("1", "one two three four"), ("2", "four three two one"), ("3", "five six seven")], "id string, text string").withColumns({"title": F.lit("t"), "source": F.lit("s"), "published_at": F.lit("2024-01-01").cast("timestamp")})
    pipe = DedupPipeline(DedupConfig(num_perm=16, prefilter=False, minhash_threshold=1.01, rerank=False))
    done = pipe.run(a)
    assert sorted(tuple(r.news_ids) for r in done["clusters"].collect()) == [("1", "2"), ("3",)] and done["groups"].count() == 3
    lab = spark.createDataFrame([("1", "x"), ("2", "x")], "id string, label string")
    assert [(r.stage, r.tp, r.fp, r.fn) for r in pipe.stage_metrics(done, lab).collect()] == [("candidates", 1, 0, 0), ("rerank", 1, 0, 0)]


def test_limit_and_undone_batches(spark, tmp_path):
    row = lambda i: '{"id": "%s", "title": "t", "text": "x", "source": "s", "published_at": "2024-01-01T00:00:00"}' % i
    for name in "ab":
        (tmp_path / name).write_text("[" + ",".join(row(name + str(i)) for i in range(4)) + "]")
    got = lambda limit: sorted(r.id for r in load(spark, str(tmp_path / "a"), str(tmp_path / "b"), DedupConfig(limit=limit)).collect())
    assert got(5) == ["a0", "a1", "b0", "b1"] and len(got(None)) == 8
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", None), (2, "d", 1)], "batch int, id string, label int")
    assert sorted(r.id for r in ingest.undone(rows, "batch", "label").collect()) == ["c", "d"]
