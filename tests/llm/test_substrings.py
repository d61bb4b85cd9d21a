import hashlib
import random

import numpy as np
import pytest

from sameword.llm import substrings
from sameword.llm.substrings import remove_repeats


def brute(rows):
    texts = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], i)
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("trial", range(40))
def test_suffix_array_and_common_prefixes(trial, monkeypatch):
    r = random.Random(trial)
    letters = r.choice([b"ab", b"a\0", b"abcd\xff\0"])
    pieces = [bytes(r.choice(letters) for _ in range(r.choice([1, 2, 4, 5, 6, 10, 50, 84]))) for _ in range(r.randint(1, 30))]
    pieces = list(dict.fromkeys(pieces + [p[3:] or b"a" for p in pieces[:5]]))
    sizes = np.array([len(p) for p in pieces])
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    tail = lambda i: flat.tobytes()[i : i + int(room[i])]
    want = sorted(range(len(flat)), key=lambda i: (tail(i), i))
    if trial % 2:  # as for shards that are too large to pack a sort key into 64 bits
        monkeypatch.setattr(substrings, "sorted_by", lambda g, k, p, bits, real=substrings.sorted_by: real(g, k, p, 30))
    sa, _ = substrings.suffix_array(flat, room)
    assert sa.tolist() == want
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert substrings.common_prefixes(flat, sa, room, sizes).tolist() == [0] + [same(tail(i), tail(j)) for i, j in zip(want, want[1:])]


def test_runs_of_documents():
    """Overlapping and touching runs are one, whichever the order; documents never run into each other."""
    r = random.Random(6)
    for _ in range(50):
        spans = [(r.choice([0, 1, 7, 2**40]), a, a + r.randint(1, 9)) for a in (r.randrange(40) for _ in range(r.randint(0, 30)))]
        row = substrings.span_row(*(np.array(x, np.int64) for x in (zip(*spans) if spans else ([], [], [])))).to_pylist()[0]
        ids, counts, first, second = (np.frombuffer(row[n], k) for n, k in (("ids", np.int64), ("counts", np.int32), ("first", np.int32), ("second", np.int32)))
        got = {(int(i), k) for i, c, at in zip(ids, counts, np.cumsum(counts) - counts) for a, z in zip(first[at : at + c], second[at : at + c]) for k in range(a, z)}
        assert got == {(i, k) for i, a, z in spans for k in range(a, z)} and len(set(ids)) == len(ids)
        assert all(x[1] < y[0] for c, at in zip(counts, np.cumsum(counts) - counts) for p in [list(zip(first[at : at + c], second[at : at + c]))] for x, y in zip(p, p[1:]))


def test_merge_by_binary_search():
    r = random.Random(4)
    runs = []
    for _ in range(7):
        rows = sorted((r.randrange(4), r.randrange(30), r.randrange(1000)) for _ in range(r.randrange(1, 60)))
        runs.append((np.array([x[:2] for x in rows], np.uint64), np.array([x[2] for x in rows])))
    least = {}
    for w, i in runs:
        for a, b in zip(map(tuple, w.tolist()), i.tolist()):
            least[a] = min(b, least.get(a, b))
    keys, got = substrings.owners(runs)
    assert list(zip(map(tuple, keys.tolist()), got.tolist())) == sorted(least.items())


@pytest.mark.parametrize("seed, shard, batch, pieces", [(1, 1_250_000, 1_000_000, 200_000), (2, 3000, 400, 60), (3, 1000, 50, 5)])
def test_as_brute_force(spark, seed, shard, batch, pieces, monkeypatch):
    """The smaller shards are, the more anchors span several of them, up to one whose windows all go through the merge."""
    for name, value in (("SHARD_ANCHORS", 300), ("LEAST_SHARDS", 3), ("SHARD_BYTES", shard), ("BATCH_ANCHORS", batch), ("BATCH_PIECES", pieces), ("RANGE_WINDOWS", 2000)):
        monkeypatch.setattr(substrings, name, value)
    merges = []
    monkeypatch.setattr(substrings, "merged_spans", lambda rows, n, real=substrings.merged_spans: merges.append(n) or real(rows, n))
    r = random.Random(seed)
    piece = lambda n: "".join(r.choice("abé ") for _ in range(n))
    shared = [piece(n) for n in (40, 45, 47, 60, 90, 200)] + ["a" * 120, "ab" * 60]
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 51), (5, piece(20000))]
    for i in range(6, 90):
        rows.append((i, "".join(piece(r.randint(0, 30)) + r.choice(shared) for _ in range(r.randint(0, 4)))))
    rows += [(90 + k, rows[r.randrange(6, 90)][1]) for k in range(15)] + [(200, rows[5][1][:700] + "new" + rows[5][1][700:])]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    rows = [(k, t) for k, (_, t) in zip(ids, rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n_bytes", "3 as sha")
    got = {x.id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(docs).collect()}
    assert got == brute(rows) and bool(merges) == (shard < 10_000)


def test_empty_and_null_identifiers(spark):
    docs = spark.createDataFrame([(None, "q" * 80), (1, "q" * 80), (1, "q" * 80)], "doc_id long, text string")
    assert remove_repeats(docs.limit(0)).count() == 0
    assert [x.n_removed for x in remove_repeats(docs).collect()] == [0, 0, 0]


def test_cut_points():
    none = np.zeros(0, np.uint64)
    assert len(substrings.cut_points(none, 1)) == 0
    even = substrings.cut_points(none, 4)
    assert [int(x) >> 62 for x in even] == [0, 1, 2] and (np.diff(even.astype(float)) > 0).all()
    draw = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    for sample, shards in ((draw, 40), (draw[:30], 40), (np.sort(draw)[::-1], 500)):
        cuts = substrings.cut_points(sample, shards)
        assert shards - 1 <= len(cuts) < 2 * shards and (cuts[1:] >= cuts[:-1]).all()
        sizes = np.bincount(np.searchsorted(cuts, draw), minlength=shards)
        if len(sample) > 1000:
            assert sizes.max() < 5 * len(draw) / shards + 10
    heavy = np.r_[draw[:1000], np.full(1000, draw[0])]  # half of the sample is one anchor
    assert (substrings.cut_points(heavy, 20) == draw[0]).sum() >= 8


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_few_long_documents_are_many_shards(spark, monkeypatch, most):
    """Eight texts that share long passages: shards of equal size, with a small sample too."""
    monkeypatch.setattr(substrings, "MOST_SAMPLES", most)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 40_000)
    r = random.Random(4)
    passages = ["".join(r.choice("abcdefgh ") for _ in range(3000)) for _ in range(12)]
    rows = [(i, "".join(r.choice(passages) + str(r.random()) for _ in range(6))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cuts, real = [], substrings.splitters
    monkeypatch.setattr(substrings, "splitters", lambda *a: cuts.append((a, real(*a))) or cuts[-1][1])
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()}
    assert got == brute(rows)
    wanted = -(-cuts[0][0][2] * 85 // 40_000)
    assert wanted > 4 and len(np.unique(cuts[0][1])) >= wanted - 1


@pytest.mark.parametrize("together", [1, 4])
def test_a_batch_sends_neighbouring_shards_as_one_row(spark, monkeypatch, together):
    """Rows of many shards are as few as their bundles; each shard is still sorted by itself, and removes the same."""
    for name, value in (("SHARD_BYTES", 1000), ("TOGETHER", together), ("LEAST_BUNDLES", 2)):
        monkeypatch.setattr(substrings, name, value)
    r = random.Random(8)
    passages = ["".join(r.choice("abcdefgh ") for _ in range(400)) for _ in range(12)] + ["ab" * 60]
    rows = [(i, "".join(r.choice(passages) + str(r.random()) for _ in range(5))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seen, real = [], substrings.cut_pieces
    monkeypatch.setattr(substrings, "cut_pieces", lambda met, split: seen.append((len(split) + 1, real(met, split))) or seen[-1][1])
    got = {x.id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(docs).collect()}
    assert got == brute(rows)
    shards, cut = seen[0]
    sent = cut.where("bundle >= 0").select("bundle").collect()
    tasks = cut.rdd.getNumPartitions()
    assert shards > 20 and len({x.bundle for x in sent}) <= -(-shards // together) and len(sent) <= tasks * -(-shards // together)
