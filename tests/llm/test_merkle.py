import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sameword.llm import merkle as M

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def reduced(nodes, arity=3):
    """All levels of a tree, and the siblings of each leaf, by plain loops."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[k : k + arity]) for k in range(0, len(last), arity)])
    sides = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = i - i % arity
            path.append((level[run:i], level[i + 1 : run + arity]))
            i //= arity
        sides.append(path)
    return levels[-1][0], sides


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute(rows, arity=3):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        leaf = H(*map(field, r))
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        found = H(*map(field, (*r[:4], r[4].replace("\n", "")))) if hit and r[4] is not None else leaf
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf, found, r[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots, paths = {}, {}
    for name in names:
        trees[name].sort(key=lambda x: x[:4])
        subroots[name], paths[name] = reduced([x[2] for x in trees[name]], arity)
    root, over = reduced([subroots[n] for n in names], arity)
    out = []
    for name, up in zip(names, over, strict=True):
        for (_, _, leaf, found, i), path in zip(trees[name], paths[name], strict=True):
            node, proof = found, ""
            for before, after in path + up:
                node, proof = H(*before, node, *after), proof + "".join(before + after)
            out.append((i, leaf, subroots[name], root, H(proof), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("arity", "height"), [(3, 7), (3, 1), (3, 2), (2, 2), (5, 1)])
def test_against_plain_trees(spark, arity, height):
    draw = random.Random(arity * 10 + height)
    text = lambda: draw.choice([None, "", "a\nb", "no line end", "\n", "é\n" * 50, "x" * 3000 + "\n"])
    sizes = {"big": 100, None: 7, "": 1, "é": 3, "z": 28, "B": 4, "a": 27, "two": 2, **{f"s{k}": 1 for k in range(13)}}
    rows = [(draw.randrange(10**6), s, draw.choice([None, "en"]), draw.choice([None, 3]), text()) for s, n in sizes.items() for _ in range(n)]
    rows += [(None, "big", None, None, "a\nb"), (5, "big", None, None, "same"), (5, "big", None, None, "same"), (5, "big", None, None, "other\n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as tree", "2 as place", "3 as size", "4 as leaf", "5 as path")
    got = M.manifest(M.document_leaves(docs, M.tampered(F.col("text"), F.col("doc_id"))), arity, height).collect()
    assert sorted(((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=repr) == brute(rows, arity)
    for r in got:  # the proof by itself: a leaf and its siblings give the root
        assert M.fold(r.leaf.encode(), M.unpacked([bytes(x) for x in r.proof])).decode() == r.root


def test_traversal_holds_few_digests():
    """Over 3^7 leaves, digests held at any step grow with the height's square, and paths are right."""
    leaves = [M.digest(str(i).encode()) for i in range(3**7)]
    most, _ = 0, None
    plain = reduced([x.decode() for x in leaves])[1]
    held: list = []
    init = M.Ahead.__init__

    def watched(self, level, arity):
        init(self, level, arity)
        held.append(self)

    M.Ahead.__init__ = watched
    try:
        for i, path in enumerate(M.traversal(leaves, 7, 3)):
            if i % 50 == 0 or i > 2180:
                assert [([x.decode() for x in a], [x.decode() for x in b]) for a, b in path] == plain[i]
            most = max(most, sum(len(a.ready) + sum(map(len, a.hash.runs)) for a in held))
    finally:
        M.Ahead.__init__ = init
    assert most <= 3 * 7 * 7


@pytest.mark.parametrize("size", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 81, 82])
def test_ragged_trees(size):
    leaves = [M.digest(str(i).encode()) for i in range(size)]
    root, sides = reduced([x.decode() for x in leaves])
    levels = M.levels_of(size, 3, 7)
    assert M.top_of(leaves, levels, 3).decode() == root
    assert [[([x.decode() for x in a], [x.decode() for x in b]) for a, b in p] for p in M.traversal(leaves, levels, 3)] == sides


def test_empty_and_lone(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert M.manifest(M.document_leaves(spark.createDataFrame([], schema), F.col("text"))).count() == 0
    one = M.manifest(M.document_leaves(spark.createDataFrame([(1, None, None, None, None)], schema), F.col("text"))).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == H("1:1", "-", "-", "-", "-") and one.proof_sha256 == H("") and one.proof == []


def test_other_identifiers_and_fields(spark):
    docs = spark.createDataFrame([("b", 2, "x"), ("a", 1, "y"), ("c", 1, None)], "name string, kind int, body string")
    made = M.manifest(M.document_leaves(docs, F.lit("y"), ("name", "body"), "name", "kind", "body")).collect()
    assert {r.id: r.verified for r in made} == {"a": True, "b": False, "c": False} and {r.id: r.leaf for r in made}["c"] == H("1:c", "-")
