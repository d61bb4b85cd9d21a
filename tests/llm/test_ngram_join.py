import random

import numpy as np
import pyarrow as pa
import pytest

from sameword.llm import ngram_join
from sameword.llm.ngram_join import components


def brute(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                comp[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "A b"), (4, "a  B"), (5, "a b c d e"), (6, "A B C D E"), (7, "a b c d e f"), (8, "x " * 3000)]
    base = [[word() for _ in range(r.choice([6, 12, 30, 80, 300]))] for _ in range(12)]
    for i in range(9, 160):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.2:
            w = w + passage
        if r.random() < 0.1:
            w = passage + [word() for _ in range(r.randint(0, 12))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, tokens, few", [(6, 600, 2), (1, 600, 1), (2, 10_000_000, 2)])
def test_components_as_brute_force_finds_them(spark, seed, tokens, few, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHARD_TOKENS", tokens)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "FAN", 2)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as class", "1 as id", "2 as comp", "3 as digest", "4 as salt")
    got = {r.id: (r.n_shingles, r.component_id) for r in components(docs).collect()}
    assert got == brute(rows)


def test_a_shard_that_one_shingle_fills_is_many_tasks(spark, monkeypatch):
    """Most texts share a passage, whose shingles are in all of their prefixes."""
    monkeypatch.setattr(ngram_join, "SHARD_TOKENS", 30)
    common = [f"c{k}" for k in range(14)]
    rows = [(i, " ".join([*common, f"o{i}"])) for i in range(70)] + [(100 + i, " ".join(f"u{i}x{k}" for k in range(9))) for i in range(20)]
    heavy, cells = [], []
    real = ngram_join.heavy_shards
    monkeypatch.setattr(ngram_join, "heavy_shards", lambda *a: heavy.append(real(*a)) or heavy[-1])
    join = ngram_join.prefix_join
    monkeypatch.setattr(ngram_join, "prefix_join", lambda rows, shards, few=None, heavy=None: cells.append((rows, shards, heavy)) or join(rows, shards, few, heavy))
    got = {r.id: (r.n_shingles, r.component_id) for r in components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and heavy[0] and max(heavy[0].values()) > 2
    # each pass by itself: cells give what whole shards would
    with_cells = {tuple(sorted(x)) for x in join(*cells[0][:2], None, heavy[0]).collect()}
    assert with_cells == {tuple(sorted(x)) for x in join(*cells[0][:2], None, None).collect()} != set()


def test_last_pass_alone_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PASSES", 1)
    monkeypatch.setattr(ngram_join, "linked", (lambda real, calls: lambda d, p, **k: real(d, p.where("1 = 0") if calls.append(1) or len(calls) == 1 else p, **k))(ngram_join.linked, []))
    rows = corpus(5)
    got = {r.id: (r.n_shingles, r.component_id) for r in components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_shard_candidates_hold_every_link():
    """Many random small sets in one shard: what the trie leaves out can't link; what its bounds let pass is near."""
    r = random.Random(9)
    for _ in range(60):
        sets = [sorted(r.sample(range(1, 60), r.randint(1, 14))) for _ in range(25)]
        for k in range(12):
            base = set(r.choice(sets))
            base.discard(r.choice(sorted(base)))
            sets.append(sorted(base | {r.randint(1, 60)}))
        n = [len(s) for s in sets]
        pre = [s[: ngram_join.prefix(len(s))] for s in sets]
        flat = lambda f, kind: np.array([x for k, s in enumerate(pre) for x in f(k, s)], kind)
        ids = np.arange(len(sets))
        args = (flat(lambda k, s: s, np.uint64), flat(lambda k, s: [k] * len(s), np.int64), flat(lambda k, s: range(len(s)), np.int32), ids, ids, np.array(n, np.int32), np.array([s[-1] for s in pre], np.uint64))
        got = {tuple(sorted(x)) for x in ngram_join.shard_pairs(*args)}
        want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 4 * len(set(sets[a]) & set(sets[b])) >= 3 * len(set(sets[a]) | set(sets[b]))}
        assert want <= got
        assert all({tuple(sorted(x)) for x in ngram_join.shard_pairs(*args, few=turn)} <= got for turn in range(3))


def test_empty_table_and_null_or_repeated_identifiers(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert components(docs.limit(0)).count() == 0
    assert sorted((r.id or 0, r.component_id or 0) for r in components(docs).collect()) == [(0, 0), (1, 1), (1, 1), (3, 1)]


def test_rows_of_one_identifier_with_several_texts(spark):
    """5 stands for two texts: one links with 3, the other with 7, and so all are one component."""
    x, y = [f"x{i}" for i in range(40)], [f"y{i}" for i in range(40)]
    rows = [(5, " ".join(x)), (5, " ".join(y)), (3, " ".join([*x[:-1], "z"])), (7, " ".join([*y[:-1], "z"])), (9, " ".join(y)), (11, "a b c d e f")]
    got = sorted((r.id, r.component_id) for r in components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 3), (11, 11)]


def test_batches_go_to_shards_in_few_bytes():
    """What a batch sends comes back as it was, in much less than 16 bytes an entry and 29 a document (round 3)."""
    draw = np.random.default_rng(3)
    n, counts = 500, draw.integers(1, 9, 500)
    doc = np.repeat(np.arange(n), counts)
    pos = np.concatenate([np.sort(draw.choice(80, c, replace=False)) for c in counts])
    ids = np.sort(draw.choice(10**6, n, replace=False)) - 1000
    ids[0] = -(1 << 62)
    comps, sizes, asks = np.where(ids % 9 > 0, ids, ids[1]), draw.integers(1, 400, n), draw.random(n) < 0.3
    token, lasts = draw.integers(0, 1 << 63, len(doc)).astype(np.uint64) * np.uint64(2), draw.integers(0, 1 << 63, n).astype(np.uint64)
    some = ngram_join.sent(token, doc, pos, ids, comps, sizes, lasts, asks)
    back = ngram_join.got(*some)
    for x, y in zip(back, (token, doc, pos, ids, comps, sizes, lasts >> np.uint64(32) << np.uint64(32), asks), strict=True):
        assert x.tolist() == y.tolist()
    assert sum(map(len, some)) < 0.75 * (16 * len(doc) + 29 * n)


def test_a_batch_is_shingled_as_its_texts_one_by_one():
    """A batch's words are hashed together: the same sets, for white space at ends, null, few words, other letters, repeats."""
    draw = random.Random(5)
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " A b ", "a b c d", "a b c d e", "A\x0bB\u00a0C d\x1ce f g h", "\u00c4 \u00e4 \u0130 I i x y\u2003z"]
    texts += [draw.choice(["", " ", "\n"]).join(draw.choice(["x ", "Y\t", "zz  ", "\u00e9\r\n", " w"]) for _ in range(draw.randrange(40))) for _ in range(200)]
    for some in (texts, texts[:1], texts[2:4], []):
        got = ngram_join.Shingler().many(pa.array(some, pa.string()))
        assert [x.tolist() for x in got] == [ngram_join.Shingler()((t or "").encode()).tolist() for t in some]
    sliced = pa.array(texts, pa.string()).slice(7, 50)
    assert [x.tolist() for x in ngram_join.Shingler().many(sliced)] == [ngram_join.Shingler()((t or "").encode()).tolist() for t in texts[7:57]]


def test_counts_of_a_small_task_are_few_bytes(spark):
    """A task's counts, mostly 0, were 8 MB whatever the task had read (round 3)."""
    rows = ngram_join.set_rows(spark.createDataFrame(corpus(3), "id long, text string").coalesce(2))
    some = [r.counts for r in rows.where("kind = 1").collect()]
    assert sum(map(len, some)) < 200_000
    assert sum(int(ngram_join.spread_out(x).sum()) for x in some) == sum(r.n for r in rows.where("kind = 0").collect())


def test_passes_move_what_prefixes_share_and_weigh_a_pair_once(spark, monkeypatch):
    """Every pass moved whole prefixes and weighed again what the ones before had refused: disk of 4.46 x input (round 3)."""
    monkeypatch.setattr(ngram_join, "SHARD_TOKENS", 600)
    moved, pairs = [], []
    join, stage = ngram_join.prefix_join, ngram_join.stage
    monkeypatch.setattr(ngram_join, "prefix_join", lambda rows, *a: moved.append(rows) or join(rows, *a))
    monkeypatch.setattr(ngram_join, "stage", lambda df, name: (lambda out: (name == "join-pairs" and pairs.append(out)) or out)(stage(df, name)))
    rows = corpus(6)
    # a third of the shingles in common: shares a prefix with the others, links with none
    rows += [(200 + i, " ".join([*[f"s{k}" for k in range(30)], *[f"t{i}x{k}" for k in range(12)]])) for i in range(6)]
    got = {r.id: (r.n_shingles, r.component_id) for r in components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    wholes = {}
    for _, text in rows:
        s = ngram_join.Shingler()((text or "").encode())
        if len(s):
            wholes[s.tobytes()] = ngram_join.prefix(len(s))
    tokens = [np.concatenate([np.frombuffer(r.tokens, np.uint64) for r in m.collect()]) for m in moved]
    assert len(moved) > 1 and all(np.unique(t, return_counts=True)[1].min() > 1 and len(t) < sum(wholes.values()) for t in tokens)
    asked = [(r.a, r.b) for p in pairs for r in p.collect()]
    assert asked and len(asked) == len(set(asked))


def test_heavy_shards_keep_all_their_shingles(spark):
    """What alive() gives: shared shingles at their places, and in heavy shards all."""
    draw = np.random.default_rng(4)
    sets = [np.sort(draw.choice(400, 12, replace=False)).astype(np.uint64) for _ in range(20)]
    rows = spark.createDataFrame([(i, i % 18, 30 + i // 19, bytearray(s.tobytes())) for i, s in enumerate(sets)], "row long, id long, size int, tokens binary")
    flat = np.concatenate(sets)
    for heavy in ({}, {1: 2}):
        got = [(r.id, r.size, r["last"], t, p) for r in ngram_join.alive(rows, 3, heavy).collect() for t, p in zip(np.frombuffer(r.tokens, np.uint64).tolist(), np.frombuffer(r.places, np.int32).tolist(), strict=True)]
        want = [(i % 18, 30 + i // 19, int(s[-1]) >> 32, int(t), p) for i, s in enumerate(sets) for p, t in enumerate(s) if (flat == t).sum() > 1 or int(t) % 3 in heavy]
        assert sorted(got) == sorted(want)
    assert ngram_join.alive(rows, 3).count() <= len(sets)  # a row for a document, not for each of its shards
