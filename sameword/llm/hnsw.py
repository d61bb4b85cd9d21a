"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

A shard's graph is flat arrays: for each level the nodes on it and, for each node, a row of neighbours (-1 where there is
none). Whole batches of nodes are inserted and whole blocks of queries searched at once, level by level from the top.
Neighbours are chosen so that they point in different directions. Scores are exact cosines in double precision.

Every query searches every shard, so shards are few: up to SHARDS while they hold LEAST nodes or more, and beyond that as
many as MOST nodes or SHARD_BYTES of vectors to a shard make. That depends on the vectors alone, so results are the same on
any cluster. A shard meets queries in blocks of QUERIES, and its graph is sent to a task once for each block. Equal vectors are one node with its smallest identifiers, so that copies can't cut a
graph into islands.

Defined cases: vectors that are null, empty, zero, or that hold a null or non-finite component take no part, neither as
queries nor as candidates, and neither do null identifiers; vectors meet only vectors of their own length; ties go to the
smaller identifier; repeated rows (same identifier too) are candidates once, and where their vectors differ the nearest
counts; a query whose rows have several vectors of one length asks with the least; with fewer candidates than asked for,
all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sameword.shared import stage

LEAST, SHARDS, MOST, SHARD_BYTES = 4096, 8, 1 << 18, 1 << 28
M = 16
EF_BUILD, EF = 64, 96
#: Queries that go through a graph together at most, and marks (one for each of them and each node) that this may take.
BLOCK, MARKS = 512, 1 << 25
QUERIES = 1 << 14


def chosen(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none), those that are nearer to the row's node than to any chosen
    before; what room is left goes to the nearest others. Rows of `most` ids."""
    b, c = ids.shape
    vectors = x[np.maximum(ids, 0)]
    between = np.einsum("bcd,bed->bce", vectors, vectors)
    taken, n = np.zeros((b, c), bool), np.zeros(b, np.int64)
    for k in range(c):
        clash = (np.where(taken, between[:, k, :], -np.inf) > sims[:, k : k + 1]).any(1)
        ok = (ids[:, k] >= 0) & ~clash & (n < most)
        taken[:, k] = ok
        n += ok
    rank = np.where(ids < 0, 3 * c, np.where(taken, 0, c) + np.arange(c))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ef best nodes found for each query, best first (-1 for none), and their similarities."""
    b, n = len(q), len(x)
    ids, sims = np.full((b, ef), -1), np.full((b, ef), -np.inf, np.float32)
    k = entry.shape[1]
    ids[:, :k], sims[:, :k] = entry, np.where(entry >= 0, np.einsum("bd,bkd->bk", q, x[np.maximum(entry, 0)]), -np.inf)
    seen, mark, open_ = np.zeros((b, n), bool), np.zeros((b, n), np.int32), np.zeros((b, ef), bool)
    rows = np.arange(b)[:, None]
    seen[np.broadcast_to(rows, entry.shape)[entry >= 0], entry[entry >= 0]] = True
    open_[:, :k] = entry >= 0
    live = np.arange(b)
    while len(live):
        r = live[:, None]
        pick = np.argsort(np.where(open_[live], -sims[live], np.inf), axis=1)[:, :width]
        ok = np.take_along_axis(open_[live], pick, 1)
        at = np.where(ok, np.take_along_axis(ids[live], pick, 1), -1)
        open_[r, pick] = False
        new = np.where(at[:, :, None] >= 0, near[np.maximum(at, 0)], -1).reshape(len(live), -1)
        safe = np.maximum(new, 0)
        place = np.broadcast_to(np.arange(1, new.shape[1] + 1, dtype=np.int32), new.shape)
        mark[r, safe] = place
        fresh = (new >= 0) & ~seen[r, safe] & (mark[r, safe] == place)
        seen[np.broadcast_to(r, new.shape)[fresh], new[fresh]] = True
        s = np.where(fresh, np.einsum("bd,bkd->bk", q[live], x[safe]), -np.inf).astype(np.float32)
        all_ids, all_sims = np.hstack([ids[live], np.where(fresh, new, -1)]), np.hstack([sims[live], s])
        all_open = np.hstack([open_[live], fresh])
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
        ids[live], sims[live], open_[live] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_sims, all_open))
        live = live[open_[live].any(1)]
    return ids, sims


def together(nodes: int) -> int:
    return max(16, min(BLOCK, MARKS // max(1, nodes)))


class Graph:
    """levels: from the top, (nodes, neighbours): neighbours are places in nodes."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.x = x.astype(np.float32)
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / np.log(M)).astype(int)
        order = np.argsort(-level, kind="stable")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(min(int(level.max(initial=0)), 6), -1, -1):
            nodes = order[: int((level >= at).sum())]  # a level's nodes are the first of the level below
            if len(nodes):
                self.levels.append((nodes, self.built(nodes, 2 * M if at == 0 else M)))

    def built(self, nodes: np.ndarray, most: int) -> np.ndarray:
        x = self.x[nodes]
        near = np.full((len(nodes), most), -1)
        first = min(len(nodes), 2 * most)
        self.join(x, near, np.arange(first), np.zeros((first, 0), int), np.zeros((first, 0), np.float32))
        at = first
        while at < len(nodes):
            new = np.arange(at, min(len(nodes), 2 * at, at + together(len(nodes))))
            ids, sims = beam(x[:at], near[:at], x[new], self.entries(self.x[nodes[new]], at), EF_BUILD)
            self.join(x, near, new, ids, sims)
            at = new[-1] + 1
        return near

    def entries(self, q: np.ndarray, below: int | None = None) -> np.ndarray:
        """Where to start on the next level: the best found on the levels built so far."""
        entry = np.zeros((len(q), 1), int)
        for nodes, near in self.levels:
            entry = beam(self.x[nodes], near, q, entry, 8)[0]  # places stay valid below: levels are nested
        return entry if below is None else np.where(entry < below, entry, -1) if (entry < below).any() else np.zeros((len(q), 1), int)

    def join(self, x: np.ndarray, near: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Link new nodes with what was found for them and with each other, both ways."""
        most, mates = near.shape[1], x[new] @ x[new].T
        np.fill_diagonal(mates, -np.inf)
        k = min(len(new), 32)
        own = np.argsort(-mates, axis=1)[:, :k]
        ids, sims = np.hstack([ids, np.where(np.isfinite(np.take_along_axis(mates, own, 1)), new[own], -1)]), np.hstack([sims, np.take_along_axis(mates, own, 1)])
        best = np.argsort(-np.where(ids >= 0, sims, -np.inf), axis=1, kind="stable")[:, :EF_BUILD]
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        links = chosen(x, ids, sims, M)
        near[new, : min(M, most)] = links[:, :most]
        back, to = links.ravel(), np.repeat(new, links.shape[1])
        back, to = back[back >= 0], to[back >= 0]
        order = np.lexsort((-np.einsum("ed,ed->e", x[back], x[to]), back))
        back, to = back[order], to[order]
        starts = np.flatnonzero(np.r_[True, back[1:] != back[:-1]]) if len(back) else np.zeros(0, int)
        place = np.arange(len(back)) - np.repeat(starts, np.diff(np.r_[starts, len(back)]))
        touched = back[starts]
        added = np.full((len(touched), most), -1)
        fits = place < most
        added[np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(back)]))[fits], place[fits]] = to[fits]
        both = np.hstack([near[touched], added])
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        s = np.where(both >= 0, np.einsum("td,tkd->tk", x[touched], x[np.maximum(both, 0)]), -np.inf)
        o = np.argsort(-s, axis=1, kind="stable")
        near[touched] = chosen(x, np.take_along_axis(both, o, 1), np.take_along_axis(s, o, 1), most)

    def search(self, q: np.ndarray, ef: int = EF) -> np.ndarray:
        out = []
        block = together(len(self.x))
        for i in range(0, len(q), block):
            part = q[i : i + block].astype(np.float32)
            entry = np.zeros((len(part), 1), int)
            for nodes, near in self.levels[:-1]:
                entry = beam(self.x[nodes], near, part, entry, 8)[0]
            nodes, near = self.levels[-1]
            ids = beam(self.x[nodes], near, part, entry, min(ef, len(nodes)) if len(nodes) > 8 else 8)[0]
            out.append(np.where(ids >= 0, nodes[np.maximum(ids, 0)], -1))
        return np.concatenate(out)

    def flat(self) -> dict[str, bytes]:
        return {"nodes": b"".join(n.astype(np.int32).tobytes() for n, _ in self.levels), "near": b"".join(a.astype(np.int32).tobytes() for _, a in self.levels), "sizes": np.array([len(n) for n, _ in self.levels], np.int32).tobytes()}

    @classmethod
    def restored(cls, x: np.ndarray, nodes: bytes, near: bytes, sizes: bytes) -> Graph:
        g = cls.__new__(cls)
        g.x, g.levels, n, a = x.astype(np.float32), [], 0, 0
        all_nodes, all_near, lengths = np.frombuffer(nodes, np.int32), np.frombuffer(near, np.int32), np.frombuffer(sizes, np.int32)
        for k, size in enumerate(lengths):
            most = 2 * M if k == len(lengths) - 1 else M
            g.levels.append((all_nodes[n : n + size].astype(int), all_near[a : a + size * most].reshape(size, most).astype(int)))
            n, a = n + size, a + size * most
        return g


def usable(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def index(vectors: DataFrame, k: int, shard_size: int | None = None) -> DataFrame:
    """From id, v: a row for each shard: dim, shard, and as flat arrays ids of nodes, their members, vectors, graph.
    shard_size: nodes of a shard, at the place of the rule."""
    part = vectors.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("few"))
    nodes = part.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("few")))), 1, k + 1).alias("members"))
    nodes = stage(nodes.select(F.size("v").alias("dim"), F.col("members")[0].alias("id"), "members", "v"), "ann-nodes")
    n = F.count("*")
    count = F.ceil(n / shard_size) if shard_size else F.greatest(F.least(F.ceil(n / LEAST), F.lit(SHARDS)), F.ceil(n / MOST), F.ceil(n * F.first("dim") * 8 / SHARD_BYTES))
    shards = nodes.groupBy("dim").agg(count.alias("shards"))
    tasks = int(shards.agg(F.sum("shards")).first()[0] or 1)
    placed = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    # a shard takes seconds to build from little data: a fixed count keeps many of them from being put into one task
    placed = placed.select("dim", "shard", "id", "members", "v").repartition(4 * tasks, "dim", "shard")

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        lists = table.column("members").combine_chunks()
        has = pc.list_value_length(lists).to_numpy().astype(np.int32)
        members = np.full((len(order), k + 1), -1, np.int64)
        members[np.arange(k + 1) < has[:, None]] = lists.flatten().to_numpy()
        members, has = members[order], has[order]
        g = Graph(unit(v)).flat()
        return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "members": [members.tobytes()], "has": [has.tobytes()], "vectors": [v.tobytes()], **{n: [b] for n, b in g.items()}})

    return placed.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, members binary, has binary, vectors binary, nodes binary, near binary, sizes binary")


def nearest(embeddings: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_size: int | None = None, ef: int = EF, block: int = QUERIES) -> DataFrame:
    """query_id, rank, id, score: for each row that meets the condition, the k nearest other rows that were found."""
    rows = embeddings.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    shards = stage(index(rows.select("id", "v"), k, shard_size), "ann-shards")
    asking = rows.where("asks").groupBy("id", F.size("v").alias("dim")).agg(F.min("v").alias("v"))
    sizes = asking.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    blocks = asking.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("qs"))
    there = shards.groupBy("dim").agg(F.collect_set("shard").alias("shard"))  # a number for each shard of a dimension
    spread = stage(blocks, "ann-blocks").join(there, "dim").withColumn("shard", F.explode("shard"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                asked, q = np.array([x["id"] for x in r["qs"]]), np.array([x["v"] for x in r["qs"]], np.float64)
                v = np.frombuffer(r["vectors"], np.float64).reshape(-1, q.shape[1])
                members, has = np.frombuffer(r["members"], np.int64).reshape(len(v), -1), np.frombuffer(r["has"], np.int32)
                g, u, lq = Graph.restored(unit(v), r["nodes"], r["near"], r["sizes"]), v / 1.0, np.sqrt((q * q).sum(1))
                norm, out = np.sqrt((u * u).sum(1)), []
                for i, found in enumerate(g.search(unit(q), ef)):
                    found = found[found >= 0]
                    score = (u[found] @ q[i]) / (norm[found] * lq[i])
                    top = np.argsort(-score, kind="stable")[: 4 * (k + 1)]
                    best: dict[int, float] = {}
                    for n, s in zip(found[top].tolist(), score[top].tolist(), strict=True):
                        for m in members[n, : has[n]].tolist():
                            if m != asked[i]:
                                best[m] = max(s, best.get(m, -2.0))
                    out += [(int(asked[i]), m, s) for m, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
                a, b, c = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "id", "score"])

    pairs = spread.join(shards, ["dim", "shard"])
    tasks = max(1, pairs.select("dim").count())  # a search takes seconds of little data: each block and shard is a task
    met = pairs.repartition(4 * tasks, "dim", "block", "shard").select("qs", "members", "has", "vectors", "nodes", "near", "sizes")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = met.mapInArrow(search, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id")
