"""A Merkle manifest of a table, with each row's authentication path.

Rows are leaves; each source is a tree of its own, by identifier, and the subroots are the leaves of one more. A tree is cut
into aligned blocks of ARITY ** HEIGHT nodes. Blocks are reduced to their tops by treehash stacks, tops to tops of theirs,
round by round; going down again, each top gets the path above it, which all nodes of its block share. In the last pass a
block's leaves meet that shared path, and a traversal goes from leaf to leaf: for each level a treehash is fed one leaf ahead
at each step, so that the next run of siblings is there when it is due. Besides the block's leaf digests a task holds a
number of digests that grows with the square of a block's height.

Defined cases: a null field is written as a dash, so it differs from an empty one; a null source is the first tree, a null
identifier the first leaf of its tree and never tampered with; rows with one source and identifier are leaves of their own,
by digest; a lone leaf is its subroot, and a lone subroot the root; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sameword.operators.order import numbered_within
from sameword.shared import stage

ARITY = 3
#: Levels of a block: 2187 nodes.
HEIGHT = 7
#: Rows that a task hands on at once.
AT_ONCE = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: bytes) -> bytes:
    """Lowercase hex of the SHA-256 of inputs, which are hex texts themselves."""
    return hashlib.sha256(b"".join(inputs)).hexdigest().encode()


class Treehash:
    """A node over leaves that come one by one: of each level under it, less than a run of digests is held."""

    def __init__(self, height: int, arity: int):
        self.height, self.arity, self.runs = height, arity, [[] for _ in range(height)]
        self.top: bytes | None = None

    def feed(self, node: bytes, level: int = 0) -> None:
        while level < self.height:
            run = self.runs[level]
            run.append(node)
            if len(run) < self.arity:
                return
            node, level = digest(*run), level + 1
            run.clear()
        self.top = node

    def close(self) -> bytes | None:
        """No leaf comes any more: short runs are ended, also those of one node."""
        for level, run in enumerate(self.runs):
            if run:
                node = digest(*run)
                run.clear()
                self.feed(node, level + 1)
        top, self.top = self.top, None
        return top


class Ahead:
    """The nodes of one level, made of leaves that are fed one a step."""

    def __init__(self, level: int, arity: int):
        self.hash, self.ready = Treehash(level, arity), []

    def feed(self, leaf: bytes) -> None:
        self.hash.feed(leaf)
        if self.hash.top is not None:
            self.ready.append(self.hash.close())

    def take(self) -> list[bytes]:
        if (last := self.hash.close()) is not None:
            self.ready.append(last)
        run, self.ready = self.ready, []
        return run


def levels_of(size: int, arity: int, height: int) -> int:
    """Levels that a block of a tree of `size` nodes is reduced by: all there are if the tree is one block."""
    if size > arity**height:
        return height
    levels = 0
    while size > 1:
        size, levels = -(-size // arity), levels + 1
    return levels


def top_of(leaves: list[bytes], levels: int, arity: int) -> bytes:
    tree = Treehash(levels, arity)
    for leaf in leaves:
        tree.feed(leaf)
    return tree.close()


def traversal(leaves: list[bytes], levels: int, arity: int) -> Iterator[list[tuple[list[bytes], list[bytes]]]]:
    """For each leaf in turn its siblings on every level, those before it and those after. A run of siblings stays until
    its last leaf has gone by; meanwhile the treehash of its level makes the next one, fed with one leaf a step."""
    runs, ahead, spans = [], [Ahead(level, arity) for level in range(levels)], [arity**level for level in range(levels + 1)]
    for level in range(levels):
        for leaf in leaves[: spans[level + 1]]:
            ahead[level].feed(leaf)
        runs.append(ahead[level].take())
    for i in range(len(leaves)):
        path = []
        for level in range(levels):
            at = i // spans[level] % arity
            path.append((runs[level][:at], runs[level][at + 1 :]))
        yield path
        for level in range(levels):
            if (next_ := i + spans[level + 1]) < len(leaves):
                ahead[level].feed(leaves[next_])
            if (i + 1) % spans[level + 1] == 0:
                runs[level] = ahead[level].take()


def fold(node: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    for before, after in path:
        node = digest(*before, node, *after)
    return node


def packed(path: list[tuple[list[bytes], list[bytes]]]) -> list[bytes]:
    """A path as binary values, two for each level: the siblings before and after, 32 bytes each."""
    return [bytes.fromhex(b"".join(side).decode()) for level in path for side in level]


def unpacked(path: list[bytes]) -> list[tuple[list[bytes], list[bytes]]]:
    sides = [[x[k : k + 32].hex().encode() for k in range(0, len(x), 32)] for x in path]
    return list(zip(sides[::2], sides[1::2], strict=True))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one (tree, block), the first two columns, after the other."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and rows[0][:2] != row[:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def in_batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    for row in rows:
        held.append(row)
        if len(held) >= AT_ONCE:
            yield made()
            held = []
    if held:
        yield made()


def by_block(nodes: DataFrame, size: int) -> DataFrame:
    """Rows of a (tree, block) side by side and by place; tree and block are the first columns."""
    cut = nodes.withColumn("block", F.floor(F.col("place") / size))
    rest = [c for c in nodes.columns if c != "tree"]
    return cut.select("tree", "block", *rest).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def climb(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """The tops of all blocks of nodes (tree, place, size, node), as nodes of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tops() -> Iterator[tuple]:
            for rows in blocks(batches):
                tree, block, _, size, _ = rows[0]
                top = top_of([r[4].hex().encode() for r in rows], levels_of(size, arity, height), arity)
                yield tree, block, -(-size // arity**height), bytes.fromhex(top.decode())

        return in_batches(tops(), ["tree", "place", "size", "node"], [pa.string(), pa.int64(), pa.int64(), pa.binary()])

    return by_block(nodes.select("tree", "place", "size", "node"), arity**height).mapInArrow(run, "tree string, place bigint, size bigint, node binary")


def rounds(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """nodes and their tops' tops, staged, until each tree is one node."""
    out = [nodes]
    while (out[-1].agg(F.max("size")).first()[0] or 1) > 1:
        out.append(stage(climb(out[-1], arity, height), "merkle-round"))
    return out


def descend(tables: list[DataFrame], upper: DataFrame, arity: int, height: int) -> DataFrame:
    """upper (tree, place, path, root) of the last table of rounds(), carried down to the first one: a node's path goes on
    with its block's."""
    for nodes in tables[-2::-1]:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def paths() -> Iterator[tuple]:
                for rows in blocks(batches):
                    levels = levels_of(rows[0][3], arity, height)
                    for r, path in zip(rows, traversal([r[4].hex().encode() for r in rows], levels, arity), strict=True):
                        yield r[0], r[1], r[2], packed(path)

            return in_batches(paths(), ["tree", "block", "place", "own"], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())])

        own = by_block(nodes.select("tree", "place", "size", "node"), arity**height).mapInArrow(run, "tree string, block bigint, place bigint, own array<binary>")
        above = upper.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), "path", "subroot", "root")
        met = own.join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_place")))
        upper = stage(met.select("tree", "place", F.concat("own", "path").alias("path"), "subroot", "root"), "merkle-path")
    return upper


def shared_paths(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """tree, place, path, subroot, root of each block of nodes: the path from the block's top to the root of all trees."""
    up = rounds(stage(climb(nodes, arity, height), "merkle-round"), arity, height)
    # the subroots, one for each tree, are the leaves of one more
    named = up[-1].select(F.lit("").alias("all"), F.col("tree").alias("name"), "node")
    subroots = numbered_within(named, "all", F.asc_nulls_first("name")).withColumnRenamed("all", "tree")
    crown = rounds(stage(subroots, "merkle-subroots"), arity, height)
    none = F.array().cast("array<binary>")
    over = descend(crown, crown[-1].select("tree", "place", none.alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root")), arity, height)
    met = crown[0].select("place", "name", "node").join(over.select("place", "path", "root"), "place")
    return descend(up, met.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("place"), "path", F.col("node").alias("subroot"), "root"), arity, height)


def manifest(leaves: DataFrame, arity: int = ARITY, height: int = HEIGHT, with_proofs: bool = True) -> DataFrame:
    """From leaves (tree, id, leaf, found), the digests binary: leaf is that of the row the manifest is made of, found that of
    the row as it is now. One row each: id, leaf, subroot, root (hex), proof_sha256, folded_root, verified, proof. A proof
    has two binary values for each level up to the root, the siblings before and after (null without with_proofs);
    folded_root is what found gives with them."""
    nodes = numbered_within(leaves, "tree", F.asc_nulls_first("id"), "leaf", "found").withColumnRenamed("leaf", "node")
    nodes = stage(nodes.select("tree", "place", "size", "node", "id", "found"), "merkle-leaves")
    upper = shared_paths(nodes, arity, height)
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    kinds = [to_arrow_type(leaves.schema["id"].dataType), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def proofs() -> Iterator[tuple]:
            for (*_, above, subroot, root), *rows in blocks(batches):
                shared, told = unpacked(above), (subroot.hex(), root.hex())
                after = b"".join(x for level in shared for side in level for x in side)
                levels, folded = levels_of(rows[0][3], arity, height), {}  # what a block's top gives with the path it shares
                held = [r[4].hex().encode() for r in rows]
                for r, leaf, path in zip(rows, held, traversal(held, levels, arity), strict=True):
                    top = fold(r[6].hex().encode(), path)
                    if top not in folded:
                        folded[top] = fold(top, shared).decode()
                    whole = digest(*[x for level in path for side in level for x in side], after).decode()
                    yield r[5], leaf.decode(), *told, whole, folded[top], folded[top] == told[1], packed(path) + above if with_proofs else None

        return in_batches(proofs(), names, kinds)

    # a block's shared path goes ahead of its leaves
    block = F.floor(F.col("place") / arity**height)
    below = nodes.select("tree", block.alias("block"), "place", "size", "node", "id", "found")
    ahead = upper.select("tree", F.col("place").alias("block"), F.lit(-1).cast("bigint").alias("place"), "path", "subroot", "root")
    both = below.unionByName(ahead, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    kind = leaves.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<binary>")


def leaf_of(*fields: Column) -> Column:
    """A row's digest: each field's length in bytes, a colon and its value, a dash if null."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*told), 256))


def tampered(text: Column, id_: Column, every: int = 2) -> Column:
    """Text without line feeds where `every` divides the CRC-32 of the decimal identifier."""
    return F.when(F.crc32(id_.cast("string")) % every == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def document_leaves(docs: DataFrame, text_now: Column, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "source", text_col: str = "text") -> DataFrame:
    """manifest()'s leaves of a table; text_now: the text as it is found now."""
    first = leaf_of(*[F.col(c) for c in fields])
    found = F.when(text_now.eqNullSafe(F.col(text_col)), first).otherwise(leaf_of(*[text_now if c == text_col else F.col(c) for c in fields]))
    return docs.select(F.col(tree_col).cast("string").alias("tree"), F.col(id_col).alias("id"), first.alias("leaf"), found.alias("found"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = manifest(document_leaves(docs, tampered(F.col("text"), F.col("doc_id"))), with_proofs=False)
    return made.drop("proof").withColumnRenamed("id", "doc_id")


#: Levels of all trees by recursion, then each leaf's siblings, then each leaf's fold.
ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS front,
  xor(4294967295, list_reduce(list_transform(range(0, strlen(CAST(doc_id AS VARCHAR))), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1))::BIGINT), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295::BIGINT)) AS crc FROM documents, tab),
leaves AS (SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN crc % 2 = 0 THEN sha256(front || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(front || coalesce(strlen(text) || ':' || text, '-')) END AS found,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM d),
trees(source, level, place, size, h) AS (
  SELECT source, 0, place, size, leaf FROM leaves
  UNION ALL SELECT source, any_value(level) + 1, place // 3, any_value((size + 2) // 3), sha256(string_agg(h, '' ORDER BY place)) FROM trees WHERE size > 1 GROUP BY source, place // 3),
subroots AS (SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM trees WHERE size = 1),
crown(level, place, size, h) AS (
  SELECT 0, place, size, subroot FROM subroots
  UNION ALL SELECT any_value(level) + 1, place // 3, any_value((size + 2) // 3), sha256(string_agg(h, '' ORDER BY place)) FROM crown WHERE size > 1 GROUP BY place // 3),
top AS (SELECT h AS root, level AS crown_height FROM crown WHERE size = 1),
steps AS (SELECT doc_id, l.found, i.level, l.place // (3 ** i.level)::BIGINT AS at, s.height, s.place AS tree, t.crown_height FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source, top t, LATERAL (SELECT unnest(range(0, s.height)) AS level) i),
sides AS (
  SELECT e.doc_id, e.level, coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place < e.at), '') AS before, coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place > e.at), '') AS after
  FROM (SELECT steps.*, s.source FROM steps JOIN subroots s ON s.place = steps.tree) e JOIN trees n ON n.source IS NOT DISTINCT FROM e.source AND n.level = e.level AND n.place // 3 = e.at // 3 GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, s.height + c.level, coalesce(string_agg(c.h, '' ORDER BY c.place) FILTER (c.place < s.place // (3 ** c.level)::BIGINT), ''), coalesce(string_agg(c.h, '' ORDER BY c.place) FILTER (c.place > s.place // (3 ** c.level)::BIGINT), '')
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source, top t JOIN crown c ON c.level < t.crown_height WHERE c.place // 3 = s.place // (3 ** (c.level + 1))::BIGINT GROUP BY l.doc_id, s.height, c.level),
folds(doc_id, level, h) AS (
  SELECT doc_id, 0, found FROM leaves
  UNION ALL SELECT f.doc_id, (f.level + 1)::INT, sha256(before || f.h || after) FROM folds f JOIN sides ON sides.doc_id = f.doc_id AND sides.level = f.level),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(before || after, '' ORDER BY level), '')) AS proof_sha256 FROM leaves LEFT JOIN sides USING (doc_id) GROUP BY doc_id),
ends AS (SELECT doc_id, arg_max(h, level) AS folded_root FROM folds GROUP BY doc_id)
SELECT l.doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN proofs p ON p.doc_id = l.doc_id JOIN ends e ON e.doc_id = l.doc_id, top
"""
