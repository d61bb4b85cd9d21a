import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from sameword.llm import resample as R

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, n):
    words = WORD.findall((text or "").translate(SMALL))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, n, buckets, percent, least):
    """(id, n_features, weight, score, rank) of each document, by plain loops."""
    counts = [Counter(zlib.crc32(g.encode()) % buckets for g in grams(t, n)) for _, t in docs]
    s, t = sum(counts, Counter()), Counter(zlib.crc32(g.encode()) % buckets for x in target for g in grams(x, n))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (i, text), c in zip(docs, counts, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(k * gain(b) for b, k in c.items())
        out.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = [r for r, (_, text) in zip(out, docs, strict=True) if len(grams(text, 1)) >= least]
    for k, r in enumerate(sorted(fit, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


DOCS = [(7, None), (None, "a b c"), (3, ""), (5, "Élan vital É 9x\x00Y-z " * 40), (2, "the cat the dog"), (2, "the cat the dog"), (2, "the cat"), (11, "w" * 5000 + " tail " + "ß" * 90)] + [(100 + k, f"word{k % 5} Word{k % 3} common {'common ' * (k % 7)}x") for k in range(40)]
TARGET = ["the common cat", None, "", "word1 word2 élan"]


@pytest.mark.parametrize("n", [1, 3])
def test_against_brute_force(spark, n):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as id", "2 as file", "'x' as row", "3 as n_words", "4 as batch")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = R.resample(docs, target, n=n, buckets=50, percent=40, least_words=3).collect()
    assert sorted(((r.id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=repr) == brute(DOCS, TARGET, n, 50, 40, 3)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_pieces_hold_every_gram_once(monkeypatch, n):
    monkeypatch.setattr(R, "PIECE", 7)
    monkeypatch.setattr(R, "AT_ONCE", 20)
    texts = ["a bb ccc dddd eeeee fffffff ggggggggggggg h i j k  l", "", "abcdefghijklmnopq", "é" * 20 + " x y z A B C", " " * 30 + "end"]
    con = R.database()
    at, bucket, count = R.counted(con, R.statement(n, 1000), texts, n)
    for row, text in enumerate(texts):
        want = Counter(zlib.crc32(g.encode()) % 1000 for g in grams(text, n))
        if grams(text, 1):
            want[-1] = len(grams(text, 1))
        assert dict(zip(bucket[at == row].tolist(), count[at == row].tolist(), strict=True)) == dict(want)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert R.resample(none, none).count() == 0
    assert sorted((r.id, r.n_features) for r in R.resample(some, none, least_words=1, percent=50).collect()) == [(1, 2), (2, 1)]


def test_drawn_rows_keep_their_columns(spark, tmp_path):
    table = spark.createDataFrame([(k, f"a b c{k}", k, k) for k in range(20)], "doc_id long, text string, _at_file long, rank long")
    table.write.parquet(str(tmp_path / "t"))
    docs, target = spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([("c3 c4",)], "text string")
    want = {r.id for r in R.resample(docs, target, percent=25, least_words=2).collect() if r["rank"] is not None}
    got = R.sample(docs, target, percent=25, least_words=2)
    assert got.columns == docs.columns and len(want) == 5 and {r.doc_id for r in got.collect()} == want
