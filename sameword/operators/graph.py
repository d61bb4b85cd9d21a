"""Connected components and communities over edge tables (GR1-GR5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sameword.operators.salted import SALTS, meet
from sameword.shared import discard, stage


#: Edges that a task contracts at once.
HELD = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of these edges alone, each vertex but the smallest of its component, and that smallest one."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, low = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while (low[x] != low[y]).any():
        least = np.minimum(low[x], low[y])
        for end in (low[x], low[y]):
            np.minimum.at(low, end, least)
        while (low[low] != low).any():
            low = low[low]
    rest = np.flatnonzero(low != np.arange(len(ids)))
    return ids[rest], ids[low[rest]]


def contracted(e: DataFrame) -> DataFrame:
    """u, v, part: the edges (u, v) of each input split become stars around their components' smallest ids, HELD edges (a
    part) at a time. No edge moves, and components stay as they are."""
    kind = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            u, v = forest(*(np.concatenate([h[k] for h in held]) for k in range(2)))
            return pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind), pa.array(np.full(len(u), (task << 32) + part))], ["u", "v", "part"])

        for batch in batches:
            held.append([batch.column(k).cast(kind).to_numpy(zero_copy_only=False) for k in range(2)])
            n += batch.num_rows
            if n >= HELD:
                yield flush()
                part, held, n = part + 1, [], 0
        if n:
            yield flush()

    return e.mapInArrow(run, "u long, v long, part long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of each vertex that has an edge: columns id, component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): a logarithmic number of rounds, and every
    round leaves at most as many edges as it got. Each round is written to the shared folder. Before each, where ids are
    whole numbers, tasks contract the edges of their input splits, and then HELD edges each while that halves the parts;
    what is one part by then needs no round. Null ends and loops are ignored; an empty table gives an empty one.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v")
    kind = e.schema["u"].dataType
    whole = isinstance(kind, IntegralType)
    e = contracted(e) if whole else e.distinct()
    e = stage(e, "cc")

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # every neighbour larger than the vertex goes to the smallest in its neighbourhood
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # u's smaller neighbours and u itself go to the smallest of them
            low = e.groupBy("u").agg(F.min("v").alias("m"))
            out = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def smaller(e: DataFrame) -> tuple[DataFrame, int]:
        """A contracted table, contracted again while tasks of HELD edges each are at most half as many as its parts, and
        its parts."""
        while True:
            rows, n = e.agg(F.count("*"), F.size(F.collect_set("part"))).first()
            tasks = -(-rows // HELD)
            if n <= 1 or (tasks > 1 and 2 * tasks >= n):
                return e, n
            last, e = e, stage(contracted(e.select("u", "v").coalesce(tasks)), "cc")
            discard(last)

    n = 2
    if whole:
        e, n = smaller(e)
    before = mark(e) if n > 1 else (0,)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        last, e = e, stage(star(star(e, True), False), "cc")
        discard(last)
        now = mark(e)
        if now == before:
            break
        if whole:
            last, e = e, stage(contracted(e), "cc")
            discard(last)
            e, n = smaller(e)
            if n <= 1:
                break
            now = mark(e)
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    e = e.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"))
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def spanning_forest(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "w", max_rounds: int = 60) -> DataFrame:
    """u, v, w: a maximum spanning forest by Boruvka rounds. At any threshold, the components of the forest's edges are those of
    all edges. Ties go to the larger (u, v). Each round every component takes its heaviest edge to another one, components
    that these join become one, and of the edges between two components the heaviest stays. Null ends and loops are
    ignored."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(weight).alias("w")).where("u is not null and v is not null and u <> v and w is not null")
    e = stage(e.groupBy("u", "v").agg(F.max("w").alias("w")).withColumns({"x": F.col("u"), "y": F.col("v")}), "forest-edges")
    taken = []
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        edge = F.struct("w", "u", "v", "x", "y")
        best = e.select(F.col("x").alias("c"), edge.alias("e")).union(e.select(F.col("y").alias("c"), edge.alias("e"))).groupBy("c").agg(F.max("e").alias("e"))
        chosen = stage(best.select("e.*").distinct(), "forest-chosen")
        taken.append(chosen.select("u", "v", "w"))
        joined = stage(connected_components(chosen, "x", "y"), "forest-joined")
        ends = e
        for c in ("x", "y"):
            ends = stage(meet(ends, joined.select(F.col("id").alias(c), F.col("component").alias(f"{c}_new")), [c], ["u", "v"]).drop(c).withColumnRenamed(f"{c}_new", c), "forest-ends")
        pair = [F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")]
        last, e = e, stage(ends.where("x <> y").groupBy(*pair).agg(F.max(F.struct("w", "u", "v")).alias("e")).select("e.*", "x", "y"), "forest-edges")
        discard(last), discard(joined)
    else:
        raise RuntimeError("the spanning forest did not settle")
    out = e.select("u", "v", "w")
    for one in taken:
        out = out.union(one)
    return out


#: Links of a component that one task works on.
MOST = 200_000
#: Parts of which one moves in a round, rounds on one level, and what the modularity must rise by while each part has a turn.
PARTS, ROUNDS, LEAST_GAIN = 4, 24, 1e-4
#: Nodes of a level whose communities every task holds (24 bytes each), and links, in both directions, of a packed row.
HELD_NODES, PACKED = 2_000_000, 1_000_000
#: Links up to which joins by node need no salt: they fit in a task, whatever their keys.
SPREAD = 1_000_000


def local_louvain(double: float, resolution: float, kind: str):
    """Of a component's links (u, v, w; u = v for a node's own weight) the communities, node by node in their order."""
    import pandas as pd

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.u) | set(pdf.v))
        at = {x: i for i, x in enumerate(names)}
        links, loops, home = [dict() for _ in names], [0.0] * len(names), list(range(len(names)))
        for u, v, w in zip(pdf.u, pdf.v, pdf.w, strict=True):
            if u == v:
                loops[at[u]] = w
            else:
                links[at[u]][at[v]] = links[at[v]][at[u]] = w
        while True:
            degree = [sum(x.values()) + 2 * y for x, y in zip(links, loops, strict=True)]
            com, total, moved = list(range(len(links))), degree[:], False
            again = True
            while again:
                again = False
                for n in range(len(links)):
                    c, to = com[n], {}
                    for m, w in links[n].items():
                        to[com[m]] = to.get(com[m], 0.0) + w
                    total[c] -= degree[n]
                    gain = lambda k: to.get(k, 0.0) - resolution * degree[n] * total[k] / double  # noqa: B023, E731
                    best = max(sorted({c, *to}), key=lambda k: (round(gain(k), 12), k == c))
                    total[best] += degree[n]
                    if best != c:
                        com[n], again, moved = best, True, True
            if not moved:
                break
            new = {c: i for i, c in enumerate(sorted(set(com)))}
            home = [new[com[h]] for h in home]
            nl, lo = [dict() for _ in new], [0.0] * len(new)
            for n, x in enumerate(links):
                a = new[com[n]]
                lo[a] += loops[n]
                for m, w in x.items():
                    b = new[com[m]]
                    if a == b:
                        lo[a] += w / 2
                    else:
                        nl[a][b] = nl[a].get(b, 0.0) + w
            links, loops = nl, lo
        low: dict[int, object] = {}
        for x, h in zip(names, home, strict=True):
            low.setdefault(h, x)
        return pd.DataFrame({"id": names, "community": [low[h] for h in home]})

    return local, f"id {kind}, community {kind}"


def move_some(both: DataFrame, state: DataFrame, turn: int, resolution: float, double: float, salts: int) -> tuple[DataFrame, float, int]:
    """One round: nodes of one of PARTS parts, by a hash, go to the neighbouring community that gains most; the others stay,
    so that what a move was worked out with holds for most of it. Returns the new state, staged, the modularity of the
    given one, but for the nodes' own weights, and how many moved.

    both: links (a, b, w) in both directions; state: node, degree, com. The smallest label wins ties, and of two nodes that
    are communities of their own only the one with the larger label moves."""
    state = state.select("node", "degree", "com")
    sums = state.groupBy("com").agg(F.sum("degree").alias("total"), F.count(F.lit(1)).alias("many"))
    known = stage(meet(state, sums, ["com"], ["node"], salts=salts), "louvain-known")
    far = known.select(F.col("node").alias("b"), F.col("com").alias("to"), F.col("total").alias("to_total"), F.col("many").alias("to_many"))
    near = known.select(F.col("node").alias("a"), "degree", "com", "total", "many")
    options = meet(both, far, ["b"], ["a"], salts=salts).groupBy("a", "to").agg(F.sum("w").alias("link"), F.first("to_total").alias("to_total"), F.first("to_many").alias("to_many"))
    if salts > 1:
        options = stage(options, "louvain-options")
    met = meet(options, near, ["a"], ["to"], salts=salts)
    own = F.col("to") == F.col("com")
    gain = F.round(F.col("link") - resolution * F.col("degree") * F.col("to_total") / double, 12)
    open_ = ~own & ((F.col("many") > 1) | (F.col("to_many") > 1) | (F.col("to") < F.col("com")))
    best = met.groupBy("a").agg(F.min(F.when(open_, F.struct((-gain).alias("loss"), "to"))).alias("best"), F.coalesce(F.max(F.when(own, F.col("link"))), F.lit(0.0)).alias("inner"))
    joined = known.join(best, F.col("node") == F.col("a"), "left")
    stays = F.round(F.coalesce("inner", F.lit(0.0)) - resolution * F.col("degree") * (F.col("total") - F.col("degree")) / double, 12)
    mine = F.pmod(F.xxhash64("node", F.lit(turn // PARTS)), F.lit(PARTS)) == turn % PARTS
    goes = F.coalesce(mine & (-F.col("best.loss") > stays), F.lit(False))
    new = stage(joined.select("node", "degree", F.when(goes, F.col("best.to")).otherwise(F.col("com")).alias("com"), goes.alias("moved"), "inner", (F.col("degree") * F.col("total")).alias("square")), "louvain-state")
    inner, square, moved = new.agg(F.coalesce(F.sum("inner"), F.lit(0.0)), F.coalesce(F.sum("square"), F.lit(0.0)), F.count_if("moved")).first()
    discard(known)
    if salts > 1:
        discard(options)
    return new, inner / double - resolution * square / double**2, moved


def held_links(links: DataFrame, ids: pa.Array) -> DataFrame:
    """a, b, w: links (u, v, w) in both directions, ends by their place in ids, packed and staged: a row has all links of some
    nodes, about PACKED of them, in order. Tasks pack what they send, so that a link moves as a few bytes."""
    spark = links.sparkSession
    parts, known = max(1, 2 * links.count() // PACKED), spark.sparkContext.broadcast(ids)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            x, y, w = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w])
            order = np.lexsort((y, x, x % parts))
            x, y, w = x[order], y[order], w[order]
            ends = np.flatnonzero(np.diff(x % parts)) + 1
            for some in zip(*(np.split(c, ends) for c in (x, y, w)), strict=True):
                yield packed_row(int(some[0][0] % parts), *some)

        for batch in batches:
            held.append([pc.index_in(batch.column(k), value_set=known.value).to_numpy().astype(np.int32) for k in (0, 1)] + [batch.column(2).to_numpy()])
            n += batch.num_rows
            if n >= HELD:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        x, y, w = (np.concatenate(c) for c in zip(*[unpacked(r["n"], r["a"], r["b"], r["w"]) for r in rows], strict=True))
        order = np.lexsort((y, x))
        yield packed_row(rows[0]["part"], x[order], y[order], w[order])

    schema = "part int, n int, a binary, b binary, w binary"
    sent = links.select("u", "v", F.col("w").cast("double").alias("w")).mapInArrow(split, schema)
    return stage(sent.repartition(min(parts, 2000), "part").groupBy("part").applyInArrow(merge, schema), "louvain-held")


def packed_row(part: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    press = lambda c: pa.array([pa.compress(c.tobytes(), "zstd", asbytes=True)], pa.binary())
    steps = np.diff(x, prepend=np.int32(0)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(x)], pa.int32()), press(steps), press(y.astype(np.int32)), press(w)], ["part", "n", "a", "b", "w"])


def unpacked(n: int, a: bytes, b: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    read = lambda c, kind: np.frombuffer(pa.decompress(c, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)
    return np.cumsum(read(a, np.int32), dtype=np.int64), read(b, np.int32), read(w, np.float64)


def turns(n: int, cycle: int) -> np.ndarray:
    """The part, of PARTS, in which each of n nodes has its turn in a cycle of rounds."""
    with np.errstate(over="ignore"):
        h = (np.arange(n, dtype=np.uint64) + np.uint64(cycle * 0x51ED2701 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) % np.uint64(PARTS)).astype(np.int64)


def best_moves(x: np.ndarray, y: np.ndarray, w: np.ndarray, com: np.ndarray, degree: np.ndarray, total: np.ndarray, many: np.ndarray, mine: np.ndarray, resolution: float, double: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Of nodes x, in order, with all their links: which of `mine` go, and to which community, as move_some() has it; and the
    weight of all links inside communities."""
    to = com[y].astype(np.int64)
    order = np.lexsort((to, x))
    a, to, link = x[order], to[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (to[1:] != to[:-1])]))
    a, to, link = a[first], to[first], np.add.reduceat(link, first)
    own = to == com[a]
    inner = np.zeros(len(com))
    inner[a[own]] = link[own]
    gain = np.round(link - resolution * degree[a] * total[to] / double, 12)
    free = ~own & mine[a] & ((many[com[a]] > 1) | (many[to] > 1) | (to < com[a]))
    a, to, gain = a[free], to[free], gain[free]
    order = np.lexsort((to, -gain, a))
    a, to, gain = a[order], to[order], gain[order]
    lead = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    a, to, gain = a[lead], to[lead], gain[lead]
    stays = np.round(inner[a] - resolution * degree[a] * (total[com[a]] - degree[a]) / double, 12)
    goes = gain > stays
    return a[goes], to[goes], float(inner.sum())


def move_held(links: DataFrame, weights: DataFrame, resolution: float, double: float) -> DataFrame | None:
    """move_all() where all nodes' communities fit in a task (HELD_NODES): links stay packed where they are, tasks get the
    state of a round and give back what moves."""
    spark = links.sparkSession
    nodes = weights.orderBy("node").toArrow()
    ids, degree = nodes.column("node").combine_chunks(), nodes.column("degree").to_numpy()
    held, n = held_links(links, ids), len(degree)
    com, best, best_q, seen, still = np.arange(n, dtype=np.int32), None, None, [], 0
    for k in range(ROUNDS):
        total, many, mine = np.bincount(com, degree, n), np.bincount(com, minlength=n), turns(n, k // PARTS) == k % PARTS
        state = spark.sparkContext.broadcast((com, degree, total, many, mine))

        def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    a, to, inner = best_moves(*unpacked(r["n"], r["a"], r["b"], r["w"]), *state.value, resolution, double)
                    yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([a.astype(np.int32)], pa.list_(pa.int32())), pa.array([to.astype(np.int32)], pa.list_(pa.int32())), pa.array([inner])], ["part", "a", "b", "inner"])

        got = held.select("part", "n", "a", "b", "w").mapInArrow(run, "part int, a array<int>, b array<int>, inner double").toArrow().sort_by("part")
        state.destroy()
        q = float(np.sum(got.column("inner").to_numpy())) / double - resolution * float((degree * total[com]).sum()) / double**2
        seen.append(q)
        if best_q is None or q > best_q:
            best, best_q = com, q
        a, to = (got.column(c).combine_chunks().flatten().to_numpy() for c in ("a", "b"))
        com = com.copy()
        com[a] = to
        still = 0 if len(a) else still + 1
        if still == PARTS or (k > 2 * PARTS and max(seen[-PARTS:]) < max(seen[:-PARTS]) + LEAST_GAIN):
            break
    discard(held)
    if best_q <= seen[0]:
        return None
    return stage(spark.createDataFrame(pa.table({"node": ids, "com": ids.take(pa.array(best))})), "louvain-state")


def move_all(links: DataFrame, loops: DataFrame, resolution: float, double: float) -> DataFrame | None:
    """node, com after rounds on one level, the best state that was met; null where nothing moved."""
    both = links.select(F.col("u").alias("a"), F.col("v").alias("b"), "w").union(links.select("v", "u", "w"))
    sums = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).join(loops.withColumnRenamed("u", "node").withColumnRenamed("w", "own"), "node", "left")
    state = stage(sums.select("node", (F.col("k") + 2 * F.coalesce("own", F.lit(0.0))).alias("degree"), F.col("node").alias("com")), "louvain-state")
    if state.count() <= HELD_NODES:
        return move_held(links, state.select("node", "degree"), resolution, double)
    both = stage(both, "louvain-both")
    salts = SALTS if both.count() > SPREAD else 1
    best, best_q, seen, still = None, None, [], 0
    for k in range(ROUNDS):
        new, q, moved = move_some(both, state, k, resolution, double, salts)
        seen.append(q)
        if best_q is None or q > best_q:
            if best is not None:
                discard(best)
            best, best_q = state, q
        else:
            discard(state)
        state, still = new, 0 if moved else still + 1
        if still == PARTS or (k > 2 * PARTS and max(seen[-PARTS:]) < max(seen[:-PARTS]) + LEAST_GAIN):
            break
    discard(state), discard(both)
    return best if best_q > seen[0] else None


def louvain(vertices: DataFrame, edges: DataFrame, resolution: float = 1.0, most: int = MOST, total: float | None = None) -> DataFrame:
    """GR2: id, community (its smallest id).

    A component of up to `most` links is worked on by one task, node by node in the order of their ids, with the weight of
    the whole graph, which leaves the objective as it is. Larger ones go through rounds over tables (move_all()) and are
    coarsened, communities becoming nodes with weights of their own, until what is left of a component is that small or
    nothing moves. Nothing depends on the order of rows, so runs agree. Links of one pair count once, the heaviest; null
    ends and loops are ignored; a vertex without links is its own community. total: the weight of the whole graph that a
    component is a part of, where edges hold several graphs of equal weight; else that of all edges."""
    e = edges.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v"), F.col("score").cast("double").alias("w"))
    links = stage(e.where("u <> v and w is not null").groupBy("u", "v").agg(F.max("w").alias("w")), "louvain")
    spark, kind = vertices.sparkSession, vertices.schema["id"].dataType.simpleString()
    double = 2.0 * (total if total is not None else links.agg(F.sum("w")).first()[0] or 0.0)
    loops = spark.createDataFrame([], f"u {kind}, w double")
    local, schema = local_louvain(double, resolution, kind)
    home, done = None, []  # home: which node an id is by now

    def settle(found: DataFrame) -> None:
        """found: id, community of nodes that are finished."""
        done.append(found if home is None else home.join(found.withColumnRenamed("id", "node"), "node").select("id", "community"))

    while True:
        parts = stage(connected_components(links, "u", "v"), "louvain-parts")
        placed = stage(meet(links, parts.select(F.col("id").alias("u"), "component"), ["u"], ["v"]), "louvain-placed")
        sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        own = loops.join(parts, F.col("u") == F.col("id")).select("u", F.col("u").alias("v"), "w", "component")
        if (sizes.agg(F.max("n")).first()[0] or 0) <= most:
            settle(placed.select("u", "v", "w", "component").union(own).groupBy("component").applyInPandas(lambda _, pdf: local(pdf), schema))
            break
        large = sizes.where(F.col("n") > most).select("component", F.lit(True).alias("large"))
        split = stage(meet(placed, large, ["component"], ["u", "v"], "left"), "louvain-split")
        split_own = stage(meet(own, large, ["component"], ["u"], "left"), "louvain-own") if home is not None else own.withColumn("large", F.lit(False))
        few = split.where("large is null").drop("large").select("u", "v", "w", "component").union(split_own.where("large is null").select("u", "v", "w", "component"))
        settle(few.groupBy("component").applyInPandas(lambda _, pdf: local(pdf), schema))
        big, big_loops = split.where("large").select("u", "v", "w"), split_own.where("large").select("u", "w")
        moved = move_all(big, big_loops, resolution, double)
        if moved is None:
            settle(big.select(F.col("u").alias("id")).union(big.select("v")).distinct().select("id", F.col("id").alias("community")))
            break
        names = moved.groupBy("com").agg(F.min("node").alias("name"))
        named = stage(meet(moved.select("node", "com"), names, ["com"], ["node"]).select("node", "name"), "louvain-named")
        home = stage(named.select(F.col("node").alias("id"), F.col("name").alias("node")) if home is None else home.join(named, "node").select("id", F.col("name").alias("node")), "louvain-home")
        a, b = named.select(F.col("node").alias("u"), F.col("name").alias("p")), named.select(F.col("node").alias("v"), F.col("name").alias("q"))
        ends = stage(meet(stage(meet(big, a, ["u"], ["v"]), "louvain-ends"), b, ["v"], ["u"]).select("p", "q", "w"), "louvain-ends")
        within = ends.where("p = q").select(F.col("p").alias("u"), "w").union(big_loops.join(a, "u").select(F.col("p").alias("u"), "w"))
        loops = stage(within.groupBy("u").agg(F.sum("w").alias("w")), "louvain-loops")
        links = stage(ends.where("p <> q").groupBy(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).agg(F.sum("w").alias("w")), "louvain")
        # a community without links to others is finished
        left = links.select(F.col("u").alias("id")).union(links.select("v")).distinct()
        settle(named.select(F.col("name").alias("id")).distinct().join(left, "id", "left_anti").select("id", F.col("id").alias("community")))
    found = done[0]
    for one in done[1:]:
        found = found.union(one)
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
