import hashlib
import re
from collections import defaultdict

import pytest

from sameword.llm.exact_dedup import exact_dedup, keep_one
from sameword.llm.locate import file_table

ROWS = [(5, "a  b"), (3, "a\tb"), (9, None), (7, ""), (2, "\n"), (1, " "), (4, "A b"), (4, "A b"), (None, "A b"), (None, "only"), (6, "é" * 50000), (8, "a b"), (10, "é" * 50000)] + [(100 + i, "hot") for i in range(60)]


@pytest.mark.parametrize("key_bytes", [32, 0])  # 0: every text has the same key, so that full bytes decide alone
def test_groups(spark, key_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as id", "2 as file", "3 as key", "4 as size")
    got = exact_dedup(docs, key_bytes=key_bytes, rows_per_salt=7).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    want = sorted(((i if i is not None else -1), min((x for x in groups[norm(t)] if x is not None), default=-1), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in ROWS)
    assert sorted((r.id if r.id is not None else -1, r.keep_id if r.keep_id is not None else -1, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.id == r.keep_id for r in got if r.kept)


def test_kept_rows_and_small_batches(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert keep_one(docs).columns == docs.columns
    assert keep_one(docs, files_per_batch=1).count() == 8


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_names_that_clash_and_files(spark, tmp_path):
    table = spark.createDataFrame([(i, "x" if i < 3 else "y", i, i, i) for i in range(5)], "doc_id long, text string, _metadata long, _at_file long, _at_row long")
    table.write.parquet(str(tmp_path / "t"))
    for docs in (table, spark.read.parquet(str(tmp_path / "t"))):
        got = keep_one(docs)
        assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [(0, "x", 0, 0, 0), (3, "y", 3, 3, 3)]
    held = exact_dedup(docs).select("file").distinct().join(file_table(docs), "file").collect()
    assert held and all(str(tmp_path) in r.path for r in held)


def test_string_identifiers_and_empty(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "z")], "doc_id string, text string")
    assert sorted((r.id or "", r.keep_id or "", r.kept) for r in exact_dedup(docs).collect()) == [("", "", True), ("a", "a", True), ("b", "a", False)]
    assert exact_dedup(docs.limit(0)).count() == 0
