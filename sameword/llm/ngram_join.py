"""N-gram Jaccard join by prefix trees, and the components of its links.

A document's set holds its distinct five-word shingles, hashed to 58 bits under 6 bits of rarity: a table of fixed size
counts hashed shingles over all documents, so integer order is the global order, rare shingles first. Sets that link
must share a shingle of their prefixes. Prefixes are cut into shards of the hash space; a shard's task stores its part
of every prefix in a trie and walks it for each probe with the overlap of shared paths: it leaves out subtrees whose
sizes, remaining lengths, or shingles missed so far on either side can't reach the bound. What it finds is checked on
whole sets, a pair once. Most shingles of prefixes are in one alone; all move once to tell, and passes move the others.

Equal sets are one class from the start. All links come from the trie. In the first passes a probe takes a few candidates
that it meets at once, others in every pass, so that large groups of near copies become one component; in the last, which
is exact, the trie looks for all links between components, and leaves out subtrees of the probe's own. Components, not
pairs, are the result, and no link between two is lost.

Defined cases: a null or empty text, or white space only, has an empty set and no links; with fewer than five words the
whole sequence is the one shingle; rows with a null identifier get a null component and link with nothing; rows that
share an identifier share its component, and a link of one is a link of all; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.llm.arrow import ragged, small_batches
from sameword.operators.sieve import maybe_in
from sameword.operators.graph import connected_components
from sameword.shared import discard, stage

WORDS = 5
#: Jaccard of at least NUM / DEN links.
NUM, DEN = 3, 4
SLOTS = 1 << 21
CHUNKS, FAN = 16, 64
#: Shingles of prefixes to a shard, which is a task; one with more than twice as many is dealt to several.
SHARD_TOKENS = 1_000_000
#: First passes: candidates of a probe in a shard, nodes that it visits for them, and shingles of its prefix whose shards it
#: asks, so that candidates don't grow with the number of shards; as many passes as find more than a
#: share of the links of the first, at most PASSES. The last pass has no such bounds.
FEW, VISITS, PROBES = 6, 512, 8
PASSES, WORTH = 4, 100
#: Parts in which rows of equal sets meet their class.
SALTS = 1024
KEPT_WORDS = 400_000
C = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
class Hashed(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * C[1]
    h = (h ^ (h >> np.uint64(29))) * C[2]
    return h ^ (h >> np.uint64(32))


class Shingler:
    def __init__(self):
        self.known = Hashed()

    def __call__(self, text: bytes) -> np.ndarray:
        """Sorted distinct 58-bit shingle hashes of one text."""
        words = text.lower().split()  # bytes: A-Z only, and exactly the six characters of white space
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, n)
        with np.errstate(over="ignore"):
            if n < WORDS:
                s = (h * C[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n) * C[5]
            else:
                s = h[: n - 4] * C[0]
                for j in range(1, WORDS):
                    s = s + h[j : n - 4 + j] * C[j]
            return np.unique(mixed(s) >> np.uint64(6))

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """The same of each text of a column; a batch's words are told apart and hashed together, a word once."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string(), safe=False)))
        words = lists.flatten()
        there = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(words):
            before = np.r_[0, np.cumsum(there.to_numpy(zero_copy_only=False), dtype=np.int64)]
            ends = np.cumsum(sizes)
            sizes = before[ends] - before[ends - sizes]
            words = words.filter(there)
        told = words.dictionary_encode()
        own, (_, offsets, data) = told.dictionary, told.dictionary.buffers()
        data, at = (data or b"") and data.to_pybytes(), np.frombuffer(offsets or b"", np.int32)[own.offset :][: len(own) + 1].tolist()
        h = np.fromiter((xxhash.xxh64_intdigest(data[a:z]) for a, z in zip(at, at[1:], strict=False)), np.uint64, len(own))[told.indices.to_numpy()]
        with np.errstate(over="ignore"):
            s = h[: max(0, len(h) - 4)] * C[0]
            for j in range(1, WORDS):
                s += h[j : len(s) + j] * C[j]
            s = mixed(s) >> np.uint64(6)
            out = []
            for start, n in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
                if n >= WORDS:
                    one = np.sort(s[start : start + n - 4])
                    new = np.empty(len(one), bool)
                    new[0] = True
                    np.not_equal(one[1:], one[:-1], out=new[1:])
                    out.append(one[new])
                else:
                    few = (h[start : start + n] * C[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n) * C[5]
                    out.append(mixed(few) >> np.uint64(6) if n else np.zeros(0, np.uint64))
        return out


def prefix(n: int) -> int:
    """So many first shingles of a set must hold one of any set that it links with."""
    return n - -(-NUM * n // DEN) + 1


def own_prefix(n: int) -> int:
    """The same, for partners that are at least as large."""
    return n - -(-2 * NUM * n // (NUM + DEN)) + 1


def needed(a: int, b: int) -> int:
    return -(-NUM * (a + b) // (NUM + DEN))


def squeezed(counts: np.ndarray) -> bytes:
    """Counts of a chunk of slots in few bytes: most of a small task's are 0."""
    return pa.compress(counts.astype(np.int64).tobytes(), "zstd", asbytes=True)


def spread_out(counts: bytes) -> np.ndarray:
    """What squeezed() was given."""
    return np.frombuffer(pa.decompress(counts, 8 * (SLOTS // CHUNKS), "zstd", asbytes=True), np.int64)


def set_rows(docs: DataFrame) -> DataFrame:
    """From id, text: rows of kind 0 with id, n, digest and tally; rows of kind 1 with a task's counts of hashed shingles,
    n being the part of the table and id the task."""
    names, kinds = ["kind", "id", "n", "digest", "tally", "counts"], [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(), np.zeros(SLOTS, np.int32)
        for part in parts:
            n, digests, tallies, sets = [], [], [], []
            for s in shingles.many(part.column(1)):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                tally = np.bincount((s >> np.uint64(50)).astype(np.int64), minlength=256)
                tallies.append(tally.astype(np.uint8).tobytes() if len(s) and tally.max() < 256 else None)
                sets.append(s)
            if sets:
                counts += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.int32)
            k = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), part.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(tallies, pa.binary()), pa.nulls(k, pa.binary())], names)
        chunks = [(1, TaskContext.get().partitionId(), k, None, None, squeezed(x)) for k, x in enumerate(np.split(counts, CHUNKS))] if counts.any() else []
        yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in chunks], kind) for j, kind in enumerate(kinds)], names)

    return docs.mapInArrow(run, "kind int, id long, n int, digest binary, tally binary, counts binary")


def rarity(rows: DataFrame) -> np.ndarray:
    """6 bits for each slot, from its count: a table of fixed size, whatever the corpus. Tasks' counts are added up FAN at
    a time."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // CHUNKS, np.int64)
        for x in table.column("counts").to_pylist():
            total += spread_out(x)
        return pa.table({"n": table.column("n")[:1], "id": table.column("id")[:1], "counts": pa.array([squeezed(total)], pa.binary())})

    part = rows.where("kind = 1").select("n", "id", "counts")
    tasks = 1 + (part.agg(F.max("id")).first()[0] or 0)
    while True:
        part = part.withColumn("id", F.floor(F.col("id") / FAN)).groupBy("n", "id").applyInArrow(add, "n int, id long, counts binary")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
        part = stage(part, "join-counts")
    out = np.zeros(SLOTS, np.uint8)
    step = SLOTS // CHUNKS
    for r in part.select("n", "counts").collect():
        out[r.n * step : (r.n + 1) * step] = np.minimum(63, np.floor(2 * np.log2(np.maximum(spread_out(r.counts), 1))))
    return out


def tallies(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, n, tally of classes, but of most that are in no pair."""
    met = maybe_in(classes, pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))), "class")
    one = met.groupBy(F.col("class").alias("id")).agg(F.count("*").alias("k"), F.max("n").alias("n"), F.first("tally").alias("tally"))
    # where texts share an identifier, a bound by one tally would not hold for the other
    return one.select("id", "n", F.when(F.col("k") == 1, F.col("tally")).alias("tally"))


def possible(pairs: DataFrame, tallies: DataFrame) -> DataFrame:
    """The pairs whose sets could link by their tallies: sets share no more than the smaller count of each of 256 classes
    of shingles. tallies: id, n, tally (a byte a class; null where a count doesn't fit)."""
    one = tallies.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tally").alias("ta"))
    two = tallies.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tally").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, ta, tb in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                most = min(na, nb) if ta is None or tb is None else int(np.minimum(np.frombuffer(ta, np.uint8), np.frombuffer(tb, np.uint8)).sum())
                keep.append(most >= needed(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, pairs: DataFrame, rows_per_part: int = 64, asked: list[DataFrame] | None = None) -> DataFrame:
    """The pairs (a, b) whose whole sets link. A b with many partners is met by them in parts of about rows_per_part.
    asked: tables of pairs that were asked for before, which are left out; these pairs are added to them."""
    for before in asked or ():
        pairs = pairs.join(before, ["a", "b"], "left_anti")
    pairs = stage(pairs, "join-pairs")
    if asked is not None:
        asked.append(pairs)
    texts = stage(maybe_in(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), "id"), "join-texts")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / rows_per_part).cast("int").alias("parts"))
    many = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    members = texts.join(many.hint("merge"), F.col("id") == F.col("a")).select("b", "part", F.lit(1).alias("role"), "id", "text")
    heads = texts.join(parts.hint("merge"), F.col("id") == F.col("b")).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, heads_of, of = Shingler(), [], None  # a shared identifier has several texts
        for batch in batches:
            a, b = [], []
            for key, part, role, i, s in zip(*(batch.column(k).to_pylist() for k in range(4)), shingles.many(batch.column(4)), strict=True):
                if role == 0:
                    heads_of, of = [*(heads_of if of == (key, part) else []), s], (key, part)
                elif of == (key, part):
                    for head in heads_of:
                        both = len(np.intersect1d(s, head, assume_unique=True))
                        if DEN * both >= NUM * (len(s) + len(head) - both):
                            a.append(i)
                            b.append(key)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    met = members.union(heads).repartition(F.col("b"), F.col("part")).sortWithinPartitions("b", "part", "role")
    out = stage(met.mapInArrow(run, "a long, b long"), "join-links")
    discard(texts)
    return out


class Trie:
    """Shard parts of prefixes, in global order; one path for equal beginnings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.up, self.token, self.depth = [-1], [-1], [0]
        self.low, self.high, self.rest, self.comp = [1 << 60], [-1], [-1], [None]
        self.ends: list[list[int]] = [[]]
        self.places: dict[int, list[int]] = {}

    def put(self, tokens: list[int], positions: list[int], doc: int, size: int, comp: int) -> None:
        node = 0
        for t, p in zip(tokens, positions, strict=True):
            child = self.next[node].get(t)
            if child is None:
                child = self.next[node][t] = len(self.next)
                for column, value in ((self.next, {}), (self.up, node), (self.token, t), (self.depth, self.depth[node] + 1), (self.low, 1 << 60), (self.high, -1), (self.rest, -1), (self.comp, comp), (self.ends, [])):
                    column.append(value)
                self.places.setdefault(t, []).append(child)
            node = child
            self.low[node], self.high[node] = min(self.low[node], size), max(self.high[node], size)
            self.rest[node] = max(self.rest[node], size - p - 1)
            if self.comp[node] != comp:
                self.comp[node] = None
        self.ends[node].append(doc)

    def probe(self, tokens: list[int], positions: list[int], size: int, comp: int, end: int, visits: int | None = None, turn: int = 0) -> Iterator[tuple[int, int, int, int]]:
        """(doc, place of the first shared shingle on its path, most of the probe that can be shared, shingles of doc that
        the probe lacks) for sets of other components that are no larger than size and could still link. end: the last shingle of the probe's whole prefix; up to
        there, a stored shingle that the probe's part lacks is in none of its set. visits: give up after so many nodes,
        which turn brings in another order."""
        at = {t: k for k, t in enumerate(tokens)}
        least = -(-NUM * size // DEN)
        shift = turn * 7 % len(tokens) if tokens else 0
        for k in range(len(tokens)):
            t, p = tokens[k - shift], positions[k - shift]
            tops = self.places.get(t, ())
            for top in tops if turn % 2 == 0 else reversed(tops):
                above = self.up[top]
                while above > 0 and self.token[above] not in at:
                    above = self.up[above]
                if above > 0:
                    continue  # came from there already
                stack = [(top, 0, self.depth[top] - 1)]  # nothing above is shared, and all of it comes before t
                while stack:
                    if visits is not None:
                        visits -= 1
                        if visits < 0:
                            return
                    node, shared, lacked = stack.pop()
                    if self.comp[node] == comp or self.high[node] < least or self.low[node] > size:
                        continue
                    token = self.token[node]
                    if token in at:
                        shared += 1
                        mine = at[token] + 1 - shared  # of the probe's so far, not in what this path stores
                    else:
                        lacked += token <= end
                        mine = bisect_right(tokens, token) - shared
                    most, high = size - mine, self.high[node]
                    # what is shared outside of this shard lies after the first shared shingle, which is at p or before
                    if min(most, 1 + size - p - 1, 1 + self.rest[top]) < needed(size, max(least, self.low[node])) or high - lacked < needed(size, high):
                        continue
                    ends = self.ends[node]
                    for doc in ends if visits is None or not ends else (ends[turn * 13 % len(ends)],):
                        yield doc, self.depth[top], most, lacked
                    stack.extend((child, shared, lacked) for child in self.next[node].values())


def shard_pairs(token: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, lasts: np.ndarray, few: int | None = None, apart: np.ndarray | None = None, asks: np.ndarray | None = None) -> set[tuple[int, int]]:
    """Candidate pairs of one shard: entries are tokens of documents at places in their global order; lasts: the last token
    of each document's prefix. few: some candidates of each document only, by the number of the pass. apart: the group of each
    document, where only pairs of two groups are wanted. asks: documents that look for partners; the others are only found."""
    order = np.argsort(token, kind="stable")
    ts, cs = token[order], comps[doc[order]]
    starts = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]]) if len(ts) else np.zeros(0, np.int64)
    if not len(starts):
        return set()
    several = np.minimum.reduceat(cs, starts) != np.maximum.reduceat(cs, starts)
    live = np.sort(order[np.repeat(several, np.diff(np.r_[starts, len(ts)]))])
    live = live[np.lexsort((token[live], doc[live]))]
    found: set[tuple[int, int]] = set()
    if not len(live):
        return found
    cuts = np.flatnonzero(np.r_[True, doc[live][1:] != doc[live][:-1]])
    groups = [(int(doc[g[0]]), token[g].tolist(), pos[g].tolist()) for g in np.split(live, cuts[1:])]
    groups.sort(key=lambda g: (sizes[g[0]], ids[g[0]]))  # no partner stored so far is larger
    trie, own = Trie(), {}
    for d, tokens, places in groups:
        size, comp, me, taken = int(sizes[d]), int(comps[d]), int(ids[d]), 0
        index = {t: k for k, t in enumerate(tokens)}
        asked = asks is None or asks[d]
        for other, depth, most, lacked in trie.probe(tokens, places, size, comp, int(lasts[d]), None if few is None else VISITS, few or 0) if asked else ():
            o_places, o_tokens = own[other]
            osize = int(sizes[other])
            if DEN * osize < NUM * size or int(comps[other]) == comp or (apart is not None and apart[other] == apart[d]):
                continue
            mine = size - places[index[o_tokens[depth - 1]]]
            if min(mine, osize - o_places[depth - 1], most, osize - lacked) >= needed(size, osize):
                found.add((me, int(ids[other])))
                taken += 1
                if few is not None and taken == FEW:
                    break
        k = sum(p < own_prefix(size) for p in places)
        if k:
            own[d] = (places[:k], tokens[:k])
            trie.put(tokens[:k], places[:k], d, size, comp)
    return found


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each document in a heavy shard."""
    return (mixed(ids.astype(np.uint64) * C[3]) % np.uint64(groups)).astype(np.int64)


def prefixes(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """id, size of the set, and its prefix in global order, of every text that has one."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, table = Shingler(), sent.value
        for part in parts:
            ids, sizes, tokens = [], [], []
            for i, s in zip(part.column(0).to_pylist(), shingles.many(part.column(1)), strict=True):
                if len(s):
                    s = np.sort(s | (table[(s & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)))
                    for column, value in ((ids, i), (sizes, len(s)), (tokens, s[: prefix(len(s))].tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.binary())], ["id", "size", "tokens"])

    return texts.mapInArrow(run, "id long, size int, tokens binary")


def shard_of(token: np.ndarray, shards: int) -> np.ndarray:
    return ((token & np.uint64(0xFFFFFFFF)) % np.uint64(shards)).astype(np.int64)


def heavy_shards(rows: DataFrame, shards: int) -> dict[int, int]:
    """Shards with more than twice SHARD_TOKENS of the prefixes' shingles, as a shingle that many have makes them, and the
    groups that their documents are dealt to, so that two groups have SHARD_TOKENS or so."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            some, many = np.unique(shard_of(np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64), shards), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(many, pa.int64())], ["shard", "n"])

    sums = rows.select("tokens").mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    return {r.shard: -(-2 * r.n // SHARD_TOKENS) for r in sums.where(F.col("n") > 2 * SHARD_TOKENS).collect()}


def planes(x: np.ndarray) -> bytes:
    """Whole numbers of eight bytes, all their lowest bytes first, and so on: what is small or repeats compresses well."""
    return np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def sent(token: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, lasts: np.ndarray, asks: np.ndarray) -> tuple[bytes, bytes]:
    """What shard_pairs() takes of one batch, in few bytes: entries by document, steps between identifiers and between places,
    components less identifiers. Of `lasts` the upper half goes, as no more than a lower bound is asked of it."""
    counts = np.bincount(doc, minlength=len(ids))
    flat = b"".join(planes(x) for x in (counts, np.diff(ids, prepend=0), comps - ids, sizes, np.diff(pos.astype(np.int64), prepend=0)))
    rest = flat + (lasts >> np.uint64(32)).astype(np.uint32).tobytes() + np.packbits(asks).tobytes()
    return token.tobytes(), len(ids).to_bytes(4, "little") + pa.compress(rest, "zstd", asbytes=True)


def got(token: bytes, rest: bytes) -> tuple[np.ndarray, ...]:
    """What sent() was given."""
    tokens, n = np.frombuffer(token, np.uint64), int.from_bytes(rest[:4], "little")
    flat = pa.decompress(rest[4:], 8 * (4 * n + len(tokens)) + 4 * n + -(-n // 8), "zstd", asbytes=True)
    cuts = np.cumsum([0, *(8 * k for k in (n, n, n, n, len(tokens)))]).tolist()
    counts, ids, comps, sizes, pos = (np.frombuffer(flat[a:z], np.uint8).reshape(8, -1).T.copy().view(np.int64)[:, 0] for a, z in zip(cuts, cuts[1:], strict=False))
    ids = np.cumsum(ids)
    lasts = np.frombuffer(flat[cuts[-1] : cuts[-1] + 4 * n], np.uint32).astype(np.uint64) << np.uint64(32)
    asks = np.unpackbits(np.frombuffer(flat[cuts[-1] + 4 * n :], np.uint8), count=n).astype(bool)
    return tokens, np.repeat(np.arange(n), counts), np.cumsum(pos), ids, comps + ids, sizes, lasts, asks


def held(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Entries (token, doc, pos) and documents (ids, comps, sizes, lasts) of about a million shingles at a time. Where rows are
    whole prefixes (row, id, size, tokens), places are those in them; ids are then rows, and components identifiers."""
    rows, n = [], 0

    def flush() -> tuple[np.ndarray, ...]:
        table = pa.Table.from_batches(rows).combine_chunks()
        column = lambda name: table.column(name).to_numpy().astype(np.int64)
        sets = table.column("tokens").to_pylist()
        lengths = np.array([len(x) // 8 for x in sets], np.int64)
        token = np.frombuffer(b"".join(sets), np.uint64)
        ids, doc = column("row" if "row" in table.column_names else "id"), np.repeat(np.arange(len(sets)), lengths)
        if "row" in table.column_names:
            return token, doc, ragged(np.zeros(len(sets), np.int64), lengths), ids, column("id"), column("size"), token[np.cumsum(lengths) - 1]
        pos = np.frombuffer(b"".join(table.column("places").to_pylist()), np.int32).astype(np.int64)
        return token, doc, pos, ids, column("comp"), column("size"), column("last").astype(np.uint64) << np.uint64(32)

    for part in parts:
        at = 0
        for k, size in enumerate(pc.binary_length(part.column(part.schema.get_field_index("tokens"))).to_pylist()):
            n += size // 8
            if n > 1_000_000:
                rows.append(part.slice(at, k + 1 - at))
                yield flush()
                rows, n, at = [], 0, k + 1
        if at < part.num_rows:
            rows.append(part.slice(at))
    if rows:
        yield flush()


def by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key, and where it stands, in their order."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    for at in np.split(order, cuts[1:]) if len(order) else ():
        yield int(keys[at[0]]), at


def together(tokens: list[bytes], rests: list[bytes]) -> tuple[np.ndarray, ...]:
    """Batches of a shard, as sent() made them, as one."""
    parts = [got(x, y) for x, y in zip(tokens, rests, strict=True)]
    firsts = np.cumsum([0, *(len(p[3]) for p in parts)])
    doc = np.concatenate([p[1] + shift for p, shift in zip(parts, firsts, strict=False)])
    token, _, *others = (np.concatenate(x) for x in zip(*parts, strict=True))
    return token, doc, *others


def part_rows(token: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, sizes: np.ndarray, lasts: np.ndarray) -> dict[str, pa.Array]:
    """Entries, those of a document side by side, as a row for each document that has any."""
    firsts = np.flatnonzero(np.diff(doc, prepend=-1))
    who, ends = doc[firsts], np.r_[firsts, len(doc)]
    binary = lambda x, width: pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer((ends * width).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
    return {"id": pa.array(ids[who], pa.int64()), "size": pa.array(sizes[who], pa.int32()), "last": pa.array((lasts[who] >> np.uint64(32)).astype(np.int64)), "tokens": binary(token, 8), "places": binary(pos.astype(np.int32), 4)}


def alive(rows: DataFrame, shards: int, heavy: dict[int, int] | None = None) -> DataFrame:
    """Of prefixes (row, id, size, tokens) what another row's prefix has too: id, size, last (upper half of the prefix's last
    shingle), tokens, places. No other shingle gives a candidate, in any pass. Shards tell, and send what is shared back
    by buckets of rows. What falls in heavy shards is all kept, where it is, as rows of its own."""
    heavy, buckets = heavy or {}, 1 + shards // 2
    kind, packed = "id long, size int, last long, tokens binary, places binary", "token binary, rest binary"

    def sent_by(keys, token, doc, pos, row, ids, sizes, lasts) -> list[tuple[int, bytes, bytes]]:
        out = []
        for k, at in by(keys):
            who, local = np.unique(doc[at], return_inverse=True)
            out.append((k, *sent(token[at], local, pos[at], row[who], ids[who], sizes[who], lasts[who], np.zeros(len(who), bool))))
        return [pa.array([o[j] for o in out], x) for j, x in enumerate((pa.int32(), pa.binary(), pa.binary()))]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, doc, pos, *rest in held(parts):
            shard = shard_of(token, shards)
            at = np.flatnonzero(~np.isin(shard, list(heavy)))
            yield pa.RecordBatch.from_arrays(sent_by(shard[at], token[at], doc[at], pos[at], *rest), ["shard", "token", "rest"])

    def meet(table: pa.Table) -> pa.Table:
        token, doc, pos, row, *rest, _ = together(table.column("token").to_pylist(), table.column("rest").to_pylist())
        order = np.argsort(token, kind="stable")
        same = token[order][1:] == token[order][:-1]
        at = np.sort(order[np.r_[False, same] | np.r_[same, False]]) if len(order) else order
        return pa.table(sent_by(group_of(row, buckets)[doc[at]], token[at], doc[at], pos[at], row, *rest), ["bucket", "token", "rest"])

    def merge(table: pa.Table) -> pa.Table:
        token, doc, pos, row, ids, sizes, lasts, _ = together(table.column("token").to_pylist(), table.column("rest").to_pylist())
        order = np.lexsort((pos, row[doc]))
        _, one, of = np.unique(row, return_index=True, return_inverse=True)
        return pa.table(part_rows(token[order], of[doc[order]], pos[order], ids[one], sizes[one], lasts[one]))

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, doc, pos, _, ids, sizes, lasts in held(parts):
            at = np.flatnonzero(np.isin(shard_of(token, shards), list(heavy)))
            yield pa.RecordBatch.from_pydict(part_rows(token[at], doc[at], pos[at], ids, sizes, lasts))

    whole = rows.select("row", "id", "size", "tokens")
    told = whole.mapInArrow(cut, f"shard int, {packed}").groupBy("shard").applyInArrow(meet, f"bucket int, {packed}")
    out = told.groupBy("bucket").applyInArrow(merge, kind)
    return out.union(whole.mapInArrow(keep, kind)) if heavy else out


def prefix_join(rows: DataFrame, shards: int, few: int | None = None, heavy: dict[int, int] | None = None) -> DataFrame:
    """Candidate pairs (a, b) between components, from comp and what alive() gives; all, or in pass `few` some of each document.
    heavy: of shards that are too large for a task, into how many groups their documents are dealt. There each two groups,
    and each group by itself, are a task (a cell); one of two groups gives pairs between them alone."""
    heavy = heavy or {}

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, doc, pos, ids, comps, sizes, lasts in held(parts):
            step = 1 if few is None else np.maximum(1, -(-prefix(sizes) // PROBES))[doc]
            asking, out = (pos + 3 * (few or 0)) % step == 0, []
            for k, at in by(shard_of(token, shards)):
                groups = heavy.get(k, 1)
                group = group_of(ids, groups)[doc[at]]
                for cell in [(0, 0)] if groups == 1 else [(i, j) for i in range(groups) for j in range(i, groups)]:
                    here = at if groups == 1 else at[(group == cell[0]) | (group == cell[1])]
                    if len(here):
                        who, local = np.unique(doc[here], return_inverse=True)
                        asks = np.zeros(len(who), bool)
                        asks[local[asking[here]]] = True
                        out.append((k, cell[0] * groups + cell[1], *sent(token[here], local, pos[here], ids[who], comps[who], sizes[who], lasts[who], asks)))
            names = ["shard", "cell", "token", "rest"]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int32()) for j in range(2)] + [pa.array([o[j] for o in out], pa.binary()) for j in range(2, 4)], names)

    def meet(table: pa.Table) -> pa.Table:
        shard, cell = table.column("shard")[0].as_py(), table.column("cell")[0].as_py()
        token, doc, pos, ids, comps, sizes, lasts, asks = together(table.column("token").to_pylist(), table.column("rest").to_pylist())
        del table
        groups = heavy.get(shard, 1)
        apart = group_of(ids, groups) if cell // groups != cell % groups else None
        pairs = sorted(shard_pairs(token, doc, pos, ids, comps, sizes, lasts, few, apart, asks))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    cut_up = rows.select("id", "comp", "size", "last", "tokens", "places").mapInArrow(cut, "shard int, cell int, token binary, rest binary")
    return cut_up.groupBy("shard", "cell").applyInArrow(meet, "a long, b long").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = texts.where("id is not null")
    rows = stage(set_rows(texts), "join-sets")
    sets = rows.where("kind = 0").select("id", "n", "digest")
    salted = sets.where("n > 0 and id is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    classes = stage(rows.where("kind = 0 and n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("class"), F.first("n").alias("n"), F.min_by("tally", "id").alias("tally")), "join-classes")
    total = classes.agg(F.sum(F.col("n") / DEN + 1)).first()[0] or 0
    shards = max(1, round(total / SHARD_TOKENS))
    ids = classes.select(F.col("class").alias("id")).distinct()
    stored = stage(prefixes(maybe_in(known, ids, "id"), rarity(rows)).join(ids.hint("merge"), "id").withColumn("row", F.monotonically_increasing_id()), "join-prefixes")
    of_class = salted.groupBy("digest", "salt").agg(F.min("id").alias("low"), F.max("id").alias("high")).join(classes.select("digest", "class"), "digest")
    of_class = stage(of_class, "join-salted")
    links = stage(shared_identifiers(salted, of_class), "join-links")
    heavy = heavy_shards(stored, shards)
    shared = stage(alive(stored, shards, heavy), "join-shared")
    discard(stored)
    parts, first, asked = connected_components(links), None, []
    for few in [*range(PASSES), None]:
        if few and found_now * WORTH <= first:
            continue
        comp = shared.join(parts.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        pairs = stage(prefix_join(comp, shards, few, heavy), "join-candidates")
        more = linked(known, possible(pairs, tallies(classes, pairs)), asked=asked)
        found_now = more.count()
        first = found_now if first is None else first
        if found_now:
            parts = stage(connected_components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)), "join-parts")
    named = of_class.select("digest", "salt", "class").join(parts.withColumnRenamed("id", "class"), "class", "left").select("digest", "salt", F.coalesce("component", "class").alias("component"))
    linked_rows = salted.join(named, ["digest", "salt"]).select("id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = sets.where("n = 0 or id is null").select("id", F.col("n").cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked_rows.union(alone)


def shared_identifiers(salted: DataFrame, of_class: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that rows of one identifier are in."""
    several = stage(salted.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("id"), "join-several")
    if several.isEmpty():
        return salted.sparkSession.createDataFrame([], "a long, b long")
    mine = maybe_in(salted, several, "id").join(several, "id").select("id", "digest", "salt").join(of_class.select("digest", "salt", "class"), ["digest", "salt"]).select("id", "class").distinct()
    least = mine.groupBy("id").agg(F.min("class").alias("b"), F.count("*").alias("k")).where("k > 1").drop("k")
    return mine.join(least, "id").where("class <> b").select(F.col("class").alias("a"), "b").distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that link, at any distance, with a smaller identifier."""
    lost = components(docs, id_col, text_col).where("id <> component_id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(stage(lost, "join-lost"), id_col, "left_anti").select(*docs.columns)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
