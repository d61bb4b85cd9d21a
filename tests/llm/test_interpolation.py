import math
import random
import zlib
from collections import Counter

import numpy as np

from sameword.llm import interpolation
from sameword.llm.interpolation import BINS, BUCKETS, score_texts, weights_of


def em(bins, uniform):
    """Expectation-maximisation bucket by bucket and bin by bin."""
    w = [[1 / 3] * 3 for _ in range(BUCKETS)]
    centre = lambda k: 2.0 ** (-k / 4) if k < BINS - 1 else 0.0
    for b in range(BUCKETS):
        mine = [(centre(c // BINS % BINS), centre(c % BINS), n) for c, n in bins.items() if c // (BINS * BINS) == b]
        for _ in range(200):
            sums = [1e-3] * 3
            for x, y, n in mine:
                parts = [w[b][0] * x, w[b][1] * y, w[b][2] * uniform]
                for k in range(3):
                    sums[k] += n * parts[k] / sum(parts)
            w[b] = [s / sum(sums) for s in sums]
    w[0] = [0.0, w[0][1] / (w[0][1] + w[0][2]), w[0][2] / (w[0][1] + w[0][2])]  # a context without counts has no pairs
    return w


def brute(rows):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    toks = [(i, fold(i), ["<e>", *(t or "").encode().lower().split(), "<e>"]) for i, t in rows]
    word, pair = {f: Counter() for f in range(5)}, {f: Counter() for f in range(5)}
    for _, f, t in toks:
        word[f].update(t[1:])
        pair[f].update(zip(t, t[1:]))
    cw, cp = (sum((c[f] for f in range(5) if f != 1), Counter()) for c in (word, pair))
    n, v = sum(cw.values()), len(cw)
    bins = Counter()
    bucket = lambda c: min(BUCKETS - 1, math.ceil(math.log2(c + 1)))
    place = lambda p: min(BINS - 2, int(np.round(-4 * np.log2(p)))) if p > 0 else BINS - 1
    for _, f, t in toks:
        if f != 1:
            for a, b in zip(t, t[1:]):
                c = cw[a] - word[f][a]
                bins[(bucket(c) * BINS + place((cp[a, b] - pair[f][a, b]) / c if c else 0)) * BINS + place((cw[b] - word[f][b]) / max(1, n - sum(word[f].values())))] += 1
    w = em(bins, 1 / (v + 1))
    out = {}
    for i, f, t in toks:
        base = sum(math.log10((cw[b] + 0.5) / (n + 0.5 * (v + 1))) for b in t[1:])
        s = 0.0
        for a, b in zip(t, t[1:]):
            x, y, z = w[bucket(cw[a])]
            s += math.log10(x * (cp[a, b] / cw[a] if cw[a] else 0) + y * cw[b] / n + z / (v + 1))
        out[i] = (f == 1, len(t) - 1, sum(cw[b] > 0 for b in t[1:]), n, base, s)
    return out


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(interpolation, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(interpolation, "SHARD_KEYS", 2000)
    r = random.Random(4)
    follow = {w: [r.choice("abcdefghijklmnop") * r.randint(1, 2) for _ in range(3)] for w in [c * k for c in "abcdefghijklmnop" for k in (1, 2)]}
    rows = [(0, None), (1, ""), (2, " \n"), (3, "New words ONLY"), (4, "a " * 3000)]
    for i in range(5, 220):
        w = ["a"]
        for _ in range(r.randint(0, 60)):
            w.append(r.choice(follow[w[-1]]))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as id", "2 as fold", "3 as block")
    got, want = {x.id: tuple(x)[1:] for x in score_texts(docs).collect()}, brute(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][:4] == w[:4] and abs(got[i][4] - w[4]) < 1e-6 and abs(got[i][5] - w[5]) < 1e-6
    assert sum(w[5] for w in want.values() if w[0]) > sum(w[4] for w in want.values() if w[0])


def test_empty_and_no_training_rows(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = score_texts(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert one.held_out and one.n_tokens == 3 and one.n_known == 0 and one.train_tokens == 0 and math.isfinite(one.score)


def test_scores_are_a_distribution():
    """Whatever the context's count, the mixture sums to one over the known words and one unknown."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    pair, ctx = Counter((r.choice(words), r.choice(words)) for _ in range(80)), Counter()
    for (a, _), n in pair.items():
        ctx[a] += n
    word, v = Counter({w: r.randint(1, 9) for w in words}), 12
    cells = np.array(sorted({r.randrange(BUCKETS) * BINS * BINS + r.randrange(BINS) * BINS + r.randrange(BINS) for _ in range(40)}))
    w = weights_of(cells, np.ones(len(cells)), 1 / (v + 1))
    n = sum(word.values())
    for a in [*words, "never"]:
        x, y, z = w[min(BUCKETS - 1, math.ceil(math.log2(ctx[a] + 1)))]
        total = sum(x * (pair[a, b] / ctx[a] if ctx[a] else 0) + y * word[b] / n + z / (v + 1) for b in words) + z / (v + 1)
        assert abs(total - 1) < 1e-9
