import zlib

import numpy as np

from sameword.llm.quality import PASSAGE, Model, fit, op9_quality, passages, score


def bags(texts):
    return passages(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))


def test_passages_cover_whole_texts():
    d = bags([b"", b"a" * PASSAGE, b"a" * PASSAGE + b"9", b"x"])
    assert d.counts.tolist() == [1, 1, 2, 1] and len(d.x) == 5 and d.x[3, 2] == 1 and d.x[0, :-1].sum() == 0
    assert d.sizes.tolist() == [0, 1, 1, 0, 1]


def test_words():
    texts = [b"The cat", b"sat  the\tCAT ", b"", b" \n", b"the" * 40 + b" end", "größe".encode()]
    d = bags(texts)
    want = [w for t in texts for w in t.lower().split()]
    names = {}
    for word, bucket in zip(want, d.words.tolist(), strict=True):
        assert names.setdefault(word, bucket) == bucket
    assert len(set(names.values())) == len(names) and d.sizes.tolist() == [2, 3, 0, 0, 2, 1]


def test_forward_and_gradients():
    """Against a plain document by document computation, and finite differences."""
    r = np.random.default_rng(1)
    texts = [b"one two three " * 60, b"", b"two 99 $$ " * 90, b"three" * 300, b"one"]
    d, m, y = bags(texts), Model(hidden=5, gate=3), np.array([1.0, 0, 1, 0, 1])
    m.p["T"] = r.normal(0, 1, m.p["T"].shape)

    def plain():
        out, passage, word, p = [], 0, 0, m.p
        for n in d.counts:
            h = []
            for k in range(passage, passage + n):
                mine = [p["T"][w] for w in d.words[word : word + d.sizes[k]]]
                word += d.sizes[k]
                h.append(np.tanh(d.x[k] @ p["E"] + (sum(mine) / len(mine) if mine else 0) + p["e"]))
            passage += n
            s = [np.exp(p["v"] @ (np.tanh(x @ p["A"]) / (1 + np.exp(-(x @ p["B"]))))) for x in h]
            z = sum(a * x for a, x in zip(s, h)) / sum(s)
            out.append(1 / (1 + np.exp(-(z @ p["w"] + p["b"][0]))))
        return np.array(out)

    assert np.allclose(plain(), m.score(d), atol=1e-6)
    loss = lambda: -np.mean(y * np.log(plain()) + (1 - y) * np.log(1 - plain()))
    for name, g in m.gradients(d, y).items():
        at = np.unravel_index(np.argsort(-np.abs(g), axis=None)[:3], g.shape)
        for place in zip(*at):
            kept = m.p[name][place]
            m.p[name][place] = kept + 1e-5
            up = loss()
            m.p[name][place] = kept - 1e-5
            assert abs((up - loss()) / 2e-5 - g[place]) < 1e-5, name
            m.p[name][place] = kept


def test_learns_what_only_words_tell(spark):
    """Both kinds of text have the same letters in words of the same lengths."""
    r = np.random.default_rng(3)
    good, bad = ["stone", "river", "light", "plain"], ["notes", "viver", "thgil", "nialp"]
    rows = [(i, " ".join(r.choice(good if i % 2 else bad, 120))) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all((x.score > 0.5) == bool(x.doc_id % 2) for x in score(docs, fit(docs, labels)).collect())


def test_learns_and_ignores_the_other_fold(spark):
    good, bad = "Plain words, in a sentence that ends. ", "$$ ## 00 || <<>> "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 40)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x"), (1002, good * 20000)], "doc_id long, text string").selectExpr("*", "1 as _id", "2 as _text", "3 as _y", "4 as quality")
    # labels of the held-out fold are wrong on purpose, so that reading them would show
    labels = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i, _ in rows] + [(7, None), (None, 1)], "doc_id long, quality int")
    got = score(docs, fit(docs, labels)).collect()
    by_id = {r.doc_id: r.score for r in got}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all((by_id[i] > 0.5) == bool(i % 2) for i, _ in rows) and by_id[1000] == by_id[1001] and by_id[1002] > 0.5
    assert score(docs, fit(docs, labels)).where("doc_id = 3").first().score == by_id[3]


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none, one = (spark.createDataFrame(r, "doc_id long, quality int") for r in ([], [(1, 1)]))
    assert score(docs, fit(docs, none)).first().score == 0.5
    assert score(docs, fit(docs, one)).first().score == 1.0
    assert score(docs.limit(0), fit(docs.limit(0), one)).count() == 0


def test_held_out_accuracy(spark):
    got = op9_quality(spark, "/root/testdata/sf0.01").where("held_out")
    seen = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").selectExpr("avg(cast(predicted = quality as double)) a", "count(*) n", "avg(quality) y").first()
    majority = max(seen.y, 1 - seen.y)  # what always saying the commoner label gets
    assert seen.n > 30 and seen.a > 0.9 and 1 - seen.a < 0.3 * (1 - majority)


def test_fits_all_passages_of_long_texts(spark):
    """What makes a label stands in 6 of 48 passages, and never in one with an even number."""
    words = "plain words in a sentence that ends after some more of them".split()
    r = np.random.default_rng(5)
    plain = lambda: (" ".join(r.choice(words, 150)) + ".")[:PASSAGE]
    rows = [(i, "".join("$# 0|<> " * (PASSAGE // 8) if i % 2 == 0 and k % 8 == 1 else plain() for k in range(48))) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    got = score(docs, fit(docs, labels)).collect()
    assert all((x.score > 0.5) == bool(x.doc_id % 2) for x in got)
    # the bound on passages takes whole documents: with 48 and fewer there is one, so one label
    assert fit(docs, labels, most=48).constant in (0.0, 1.0) and fit(docs, labels, most=1).constant in (0.0, 1.0)
    assert fit(docs, labels, most=480).constant is None
