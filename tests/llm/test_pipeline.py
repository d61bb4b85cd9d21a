import math
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sameword.llm import quality
from sameword.shared import stage

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, model = docs.columns, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    # one document at a time, without Spark; test_quality has the model itself against plain loops
    alone = lambda b: float(model.score(quality.passages(np.frombuffer(b, np.uint8), np.array([0, len(b)])))[0])
    want = {r.doc_id: r.text for r in docs.collect() if alone((r.text or "").encode()) >= quality.THRESHOLD}
    seen = {}
    for i in sorted(want):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", want[i] or ""), i)
    exact = {i: shingles(want[i]) for i in seen.values()}
    top = {i: i for i in exact}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in exact:
        for b in exact:
            if a < b and exact[a] and exact[b] and 100 * len(exact[a] & exact[b]) >= 75 * len(exact[a] | exact[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    near = {i for i in exact if root(i) == i}
    for (name, step), ids in zip(corpus_pipeline.STAGES, (set(want), set(exact), near, near), strict=False):
        docs = stage(step(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} == ids, name
        if name == "mixing":
            check_mix([r for r in first if r.doc_id in near], docs.collect())
        first = docs.collect()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    texts = {i: library.encode(want[i] or "", add_special_tokens=False).ids for i in near}
    assert sorted((r.doc_id, list(r.token_ids)) for r in out) == sorted((r.doc_id, texts[r.doc_id]) for r in docs.collect())


def check_mix(before, after):
    """Every document once at least; a source's epochs are those of the exponent that bisection by plain loops finds."""
    size = lambda t: max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    tokens, times = Counter(), Counter(r.doc_id for r in after)
    for r in before:
        tokens[r.source] += size(r.text)
    low, high = 0.0, 1.0
    repeats = lambda x: max(t ** (x - 1) for t in tokens.values()) / min(t ** (x - 1) for t in tokens.values())
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if repeats(mid) <= 2.0 else (mid, high)
    whole = max(t / t**high for t in tokens.values()) * sum(t**high for t in tokens.values())
    for source, t in tokens.items():
        budget = t**high / sum(x**high for x in tokens.values()) * whole
        got = sum(times[r.doc_id] * size(r.text) for r in before if r.source == source)
        most = max(size(r.text) for r in before if r.source == source)
        assert budget - 0.01 * t - 1 <= got <= budget + most + 0.01 * t + 1, source
        assert all(1 <= times[r.doc_id] <= math.ceil(budget / t + 0.01) for r in before if r.source == source)


def odd(spark):
    """Nulls in every column, an empty and a long text, repeated rows, and columns with the names the stages use."""
    names = ["_score", "_metadata", "_at_file", "_at_row", "_mix_seq", "id", "class", "comp", "_id", "_text", "tokens", "component_id"]
    rows = [(1, "some words " * 30, "en", "a", 9), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "some words " * 30, "en", "b", 1), (4, "long text " * 20000, "en", "b", 1), (1, "some words " * 30, "en", "a", 9), (5, "other words for a near copy of this text " * 9, "en", "a", 1), (6, "other words for a near copy of this text " * 9 + "end", "en", "a", 1)]
    return spark.createDataFrame([(*r, *[42.0] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` double" for n in names))


def test_each_stage_with_odd_rows_and_names(spark):
    docs = odd(spark)
    for name, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, SF)
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert all(r[c] == 42.0 for r in kept for c in docs.columns[5:]), name
        by_id = [r.doc_id for r in kept]
        if name == "exact_dedup":  # copies of 1, the null identifier's row among them, and of the empty text
            assert sorted(by_id) == [1, 2, 4, 5, 6]
        if name == "ngram_join":
            assert sorted(x or 0 for x in by_id) == [0, 1, 1, 2, 3, 4, 5]
        if name == "mixing":
            assert {(x, by_id.count(x) > 0) for x in (None, 1, 2, 3, 4, 5, 6)} == {(x, True) for x in (None, 1, 2, 3, 4, 5, 6)}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.where("doc_id = 2").first().n_tokens == 0


def test_each_stage_with_an_empty_table(spark):
    docs = odd(spark).limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, SF).count() == 0
