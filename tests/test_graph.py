"""Communities over many tasks, the spanning forest, and what is measured on them."""

import random

import pytest
from pyspark.sql import functions as F

from sameword.operators import clusters, graph
from sameword.plans import registry
from sameword.plans.pipeline import sweep_forest


def modularity(edges, com, resolution=1.0):
    total, inner, degree = 0.0, 0.0, {}
    for a, b, w in edges:
        total += w
        inner += w * (com[a] == com[b])
        for x in (a, b):
            degree[com[x]] = degree.get(com[x], 0.0) + w
    return inner / total - resolution * sum((d / (2 * total)) ** 2 for d in degree.values())


def table(spark, edges):
    return spark.createDataFrame(edges, "id_a long, id_b long, score double")


def vertices(spark, edges):
    return spark.createDataFrame([(x,) for x in sorted({x for a, b, _ in edges for x in (a, b)})], "id long")


def both(spark, edges, most):
    """Communities by tasks of whole components, and by rounds over tables."""
    v, e = vertices(spark, edges), table(spark, edges)
    return [{r.id: r.community for r in graph.louvain(v, e, most=m).collect()} for m in (10**9, most)]


def planted(groups, size, seed=1, inside=0.5, across=3):
    """Groups with many links inside and a few to others."""
    draw, edges = random.Random(seed), set()
    for g in range(groups):
        for i in range(size):
            edges |= {(g * size + j, g * size + i) for j in range(i) if draw.random() < inside or j == i - 1}
        for _ in range(across):
            a, b = g * size + draw.randrange(size), draw.randrange(groups * size)
            if a // size != b // size:
                edges.add((min(a, b), max(a, b)))
    return [(a, b, 1.0) for a, b in sorted(edges)]


def test_rounds_come_near_the_one_task_method(spark):
    for edges, most in ((planted(8, 8), 80), ([(i, i + 1, 1.0) for i in range(90)] + [(500, i, 1.0) for i in range(501, 560)], 50)):
        one, many = both(spark, edges, most)
        assert set(one) == set(many)
        assert modularity(edges, many) >= 0.98 * modularity(edges, one)
        low = {}
        for x, c in many.items():
            low[c] = min(low.get(c, x), x)
        assert all(c == x for c, x in low.items())  # a community's name is its smallest member


def test_runs_agree_and_small_components_stay_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", 8)
    edges = planted(6, 6) + [(1000 + a, 1000 + b, w) for a, b, w in planted(1, 5)]
    v, e = vertices(spark, edges), table(spark, edges)
    a, b = ({r.id: r.community for r in graph.louvain(v, t, most=40).collect()} for t in (e, e.repartition(7).orderBy(F.desc("id_a"))))
    assert a == b
    whole = {r.id: r.community for r in graph.louvain(v, e).collect()}
    assert {x: c for x, c in a.items() if x >= 1000} == {x: c for x, c in whole.items() if x >= 1000}


def test_no_links_nulls_and_loops(spark):
    e = spark.createDataFrame([(1, 1, 1.0), (None, 2, 1.0), (3, 4, None)], "id_a long, id_b long, score double")
    v = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert sorted(map(tuple, graph.louvain(v, e, most=0).collect())) == [(1, 1), (2, 2), (3, 3)]


def components(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_forest_has_all_components_at_every_threshold(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60), draw.choice([0.1, 0.2, 0.3, 0.5, 0.9])) for _ in range(150)] + [(0, i, 0.4) for i in range(100, 140)] + [(1, 1, 1.0), (None, 3, 1.0)]
    got = [tuple(r) for r in graph.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double")).collect()]
    real = [(a, b, w) for a, b, w in edges if a is not None and a != b]
    for t in (0.0, 0.15, 0.3, 0.45, 0.9, 1.0):
        assert components([(a, b) for a, b, w in got if w >= t]) == components([(a, b) for a, b, w in real if w >= t])
    assert len(got) == len(components([(a, b) for a, b, _ in real])) - len(set(components([(a, b) for a, b, _ in real]).values()))
    assert graph.spanning_forest(spark.createDataFrame([], "a long, b long, w double")).count() == 0


def test_sweep_agrees_with_each_point_by_itself(spark):
    draw = random.Random(5)
    near = [(str(a), str(b), draw.choice([0.9, 0.95, 1.0]), draw.choice([0.5, 0.7, 0.9])) for a in range(30) for b in range(a + 1, 30) if draw.random() < 0.08]
    lab = spark.createDataFrame([(str(i), str(i // 4) if i % 5 else None) for i in range(30)], "id string, label string")
    pairs = spark.createDataFrame(near, "id_a string, id_b string, cos double, jac double")
    grid = [(c, j) for c in (0.9, 0.95, 1.1) for j in (0.0, 0.7, 0.9)]
    got = {(r.min_cos, r.min_jac): r for r in sweep_forest(pairs, lab, grid).collect()}
    assert set(got) == set(grid)
    for c, j in grid:
        passed = [(a, b) for a, b, x, y in near if x >= c and y >= j]
        parts = components(passed)
        assigned = spark.createDataFrame([(str(i), str(parts.get(str(i), i))) for i in range(30)], "id string, cluster_id string")
        m, ari, r = clusters.pair_metrics(assigned, lab).first(), clusters.adjusted_rand(assigned, lab).first().ari, got[c, j]
        assert (r.n_pairs, r.n_clusters, r.tp, r.fp, r.fn, r.precision, r.recall) == (len(passed), len(set(parts.values())), m.tp, m.fp, m.fn, m.precision, m.recall)
        assert abs(r.ari - ari) < 1e-9


def test_unranking():
    for n in range(2, 12):
        assert [clusters.unranked(k, n) for k in range(n * (n - 1) // 2)] == [(i, j) for i in range(n) for j in range(i + 1, n)]


def expert(spark, groups, most=500):
    rows = [(str(i), i, f"t{i}", "x", g) for i, g in enumerate(groups)]
    a = spark.createDataFrame(rows, "id string, doc_id long, title string, text string, g string")
    return clusters.expert_pairs(a.select("id", F.col("g").alias("cluster_id")), a.drop("g"), "doc_id", most).collect()


def test_as_many_negatives_as_asked_for_on_few_articles(spark):
    groups = [str(i // 2) for i in range(40)]
    got = expert(spark, groups)
    pos, neg = ([(r.news_id_a, r.news_id_b) for r in got if r.algorithmic_label == x] for x in (1, 0))
    assert len(pos) == 20 and len(neg) == 500 == len(set(map(frozenset, neg)))
    assert all(groups[int(a)] == groups[int(b)] for a, b in pos) and all(groups[int(a)] != groups[int(b)] for a, b in neg)
    assert sorted(r.pair_id for r in got) == sorted(r.place for r in got) == list(range(520))
    # twenty articles in ten clusters have 180 such pairs: all of them
    assert sum(r.algorithmic_label == 0 for r in expert(spark, groups[:20])) == 180


def test_pairs_are_drawn_evenly_and_never_listed(spark):
    """One cluster of 3000 has 4.5 million pairs, of which each half gets its share."""
    groups = ["big"] * 3000 + ["a", "b"]
    got = expert(spark, groups, 400)
    low = [r for r in got if r.algorithmic_label == 1 and min(int(r.news_id_a), int(r.news_id_b)) < 879]  # half of all pairs begin there
    assert sum(r.algorithmic_label for r in got) == 400 and 150 < len(low) < 250
    assert {frozenset((r.news_id_a, r.news_id_b)) & {"3000", "3001"} != frozenset() for r in got if r.algorithmic_label == 0} == {True}


def test_numbers_of_clusters(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "y"), ("4", "a")], "id string, cluster_id string")
    assert sorted((r.id, r.cluster) for r in clusters.cluster_numbers(a).collect()) == [("1", 2), ("2", 0), ("3", 0), ("4", 1)]


def test_a_sweep_at_once_is_that_of_each_point(spark):
    """Louvain over all points of a grid in one run, and point by point."""
    from sameword.plans.pipeline import DedupPipeline

    draw = random.Random(6)
    near = [(str(a), str(b), draw.choice([0.9, 0.95, 1.0]), draw.choice([0.5, 0.7, 0.9, None])) for a, b, _ in planted(5, 6)]
    near = spark.createDataFrame(near, "id_a string, id_b string, cos double, jac double")
    groups = spark.createDataFrame([(str(i), str(i)) for i in range(30)] + [("3", "x"), ("29", "y")], "rep_id string, member_id string")
    lab = spark.createDataFrame([(str(i), str(i // 6) if i % 4 else None) for i in range(30)] + [("x", "0")], "id string, label string")
    grid = [(0.9, 0.0), (0.95, 0.7), (2.0, 0.0)]

    def run(clusterer):
        pipe = DedupPipeline(clusterer=clusterer)
        pipe.paired = lambda articles, cfg: (None, groups, near)
        return {(r.min_cos, r.min_jac): tuple(round(x, 9) for x in r[2:]) for r in pipe.sweep(None, lab, grid).collect()}

    one, each = run(graph.louvain), run(lambda v, e, r: graph.louvain(v, e, r))
    assert one == each and set(one) == set(grid) and one[2.0, 0.0][0] == 0


def test_missed_pairs_are_all_pairs_of_a_label(spark):
    """fn_pairs asks for every pair of copies that clusters part, not for a few neighbours' (round 3, F11)."""
    label = {f"{i:02d}": ("x" if i < 12 else "y" if i < 20 else None) for i in range(24)}
    home = {i: (None if int(i) == 3 else str(int(i) % 3)) for i in label if int(i) != 5}
    got = clusters.missed_pairs(spark.createDataFrame(list(label.items()), "id string, label string"), spark.createDataFrame(list(home.items()), "id string, cluster_id string")).collect()
    apart = lambda a, b: home.get(a) is None or home.get(b) is None or home[a] != home[b]
    want = [(a, b) for a in label for b in label if a < b and label[a] and label[a] == label[b] and apart(a, b)]
    assert sorted((r.id_a, r.id_b) for r in got) == sorted(want)
    assert "{TRIPLES}" not in registry.SQL["fn_pairs"] and "doc_id // 3" not in registry.SQL["fn_pairs"] and "k) > 1" in registry.SQL["fn_pairs"]


@pytest.mark.parametrize("held", [7, 500_000])
def test_tasks_contract_their_links_before_rounds_move_them(spark, monkeypatch, held):
    """A chain in eight splits: whatever a task may hold, the same components; if it may hold all, no round (round 3)."""
    monkeypatch.setattr(graph, "HELD", held)
    made, real = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: made.append(name) or real(df, name))
    links = [(k, k + 1) for k in range(60)] + [(100 + k, 100) for k in range(1, 40)] + [(200 + k, 299) for k in range(40)] + [(None, 3), (4, None), (5, 5)]
    random.Random(1).shuffle(links)
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys([*range(200, 240), 299], 200)}
    if held == 500_000:
        assert made == ["cc", "cc"]


def test_rounds_leave_links_where_they_are(spark, monkeypatch):
    """Links of a large component are packed once, by nodes; a round gives back what moves, and no table of links with their
    ends' communities is made (round 4, F2)."""
    monkeypatch.setattr(graph, "PACKED", 60)
    monkeypatch.setattr(graph, "HELD", 50)
    made, real = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: made.append((name, real(df, name))) or made[-1][1])
    monkeypatch.setattr(graph, "discard", lambda df: None)
    edges = planted(8, 8)
    got = {r.id: r.community for r in graph.louvain(vertices(spark, edges), table(spark, edges), most=80).collect()}
    assert modularity(edges, got) >= 0.7 and len(set(got.values())) <= 12
    names = [n for n, _ in made]
    assert "louvain-known" not in names and "louvain-both" not in names
    held = dict(reversed(made))["louvain-held"].collect()
    whole = [graph.unpacked(r.n, r.a, r.b, r.w) for r in held]
    assert 4 <= len(held) < len(edges) / 10 and sum(r.n for r in held) == 2 * len(edges)
    assert sorted((int(a), int(b)) for x, y, _ in whole for a, b in zip(x, y, strict=True)) == sorted((p, q) for a, b, _ in edges for p, q in ((a, b), (b, a)))
    assert len({int(a) for x, _, _ in whole for a in set(x)}) == sum(len(set(x)) for x, _, _ in whole)  # all links of a node in one
