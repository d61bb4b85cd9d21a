"""Exact substring deduplication: bytes covered by a 50-byte string that starts in an earlier document too are removed.

Whole copies of an earlier text go at once. In what stays, every 50-byte window has an anchor: the 16 bytes of least hash
in it, the same wherever the window stands. Anchors that stand in several texts are live; their surroundings (84 bytes,
which hold all windows of that anchor) are put in the order of their anchors and cut into shards of equal size at sampled
splitters. A shard builds the suffix array of its surroundings by Larsson-Sadakane refinement (ranks by short prefixes,
then only groups that are still unsorted, by the rank of what follows), takes common prefixes by Kasai's rule, and each
run of suffixes that share 50 bytes belongs to its smallest identifier. Equal windows have equal anchors, so they meet in
one shard unless a border cuts their anchor's surroundings, as it does when one anchor fills several shards. Shards give
the windows of such anchors, sorted, to a merge: binary search finds a window in the runs of other shards.

No task holds all places of one anchor, surrounding or text. Of what repeats within a batch of a task, only the
smallest identifier is sent on: anchors seen in two texts are live without being sent, and all but the first of equal
surroundings are spans at once.

Defined cases: a null text is empty; texts under 50 bytes lose nothing; rows with a null identifier neither lose nor take
anything; rows that share an identifier are one document, and the rows must then hold the same text; an empty table
gives an empty result; other columns are ignored. Texts count as equal by SHA-256, in routing by 64 bits of it, and
windows that meet in the merge by 128 bits of BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.llm.arrow import as_bytes, ragged, small_batches
from sameword.operators.sieve import maybe_in
from sameword.shared import discard, stage

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM + 1
SHARD_ANCHORS, LEAST_SHARDS = 500_000, 16
#: Surroundings whose suffixes a task sorts: about 90 times as many bytes of memory.
SHARD_BYTES = 800_000
BATCH_ANCHORS, BATCH_PIECES = 250_000, 100_000
#: Neighbouring shards that a batch sends as one row, and that a task takes one after another: at most, and so few that this
#: many rows are left to a batch. Rows then don't grow with the square of the input until there are TOGETHER times as many.
TOGETHER, LEAST_BUNDLES = 16, 256
#: Anchors sampled to cut shards: for each, in all, and at least for each quantile; documents that are sampled from at least.
SAMPLES, MOST_SAMPLES, LEAST_SAMPLES, LEAST_DOCUMENTS = 100, 1 << 20, 8, 2000
#: Windows of border anchors that a task merges.
RANGE_WINDOWS = 1_000_000
#: Parts in which rows of one text meet their first.
SALTS = 1024
P = np.uint64(0x9E3779B97F4A7C15)
NONE = np.iinfo(np.int64).max


def doubled(x: np.ndarray, w: int, f) -> np.ndarray:
    have = 1
    while have < w:
        step = min(have, w - have)
        x, have = f(x[:-step], x[step:]), have + step
    return x


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of a text, and their hashes."""
    if len(b) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, p, have = b.astype(np.uint64) + np.uint64(1), P, 1
    with np.errstate(over="ignore"):
        while have < GRAM:
            h = h[:-have] * p + h[have:]
            p, have = p * p, 2 * have
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    low = doubled(h, REACH, np.minimum)
    edge = np.zeros(REACH - 1, np.uint64)
    at = np.flatnonzero(doubled(np.concatenate([edge, low, edge]), REACH, np.maximum) == h)
    return at, h[at]


def runs_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def as_row(ids: np.ndarray, counts: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> pa.Table:
    """One row: documents end to end, how many values each has, and the values (one or two columns)."""
    columns = [ids.astype(np.int64), counts.astype(np.int32), first.astype(np.int32), (first if second is None else second).astype(np.int32)[: None if second is not None else 0]]
    return pa.Table.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], ["ids", "counts", "first", "second"])


def by_document(rows: DataFrame, most: int = 2_000_000) -> DataFrame:
    """id, first, second: the values of each document from all rows that as_row() made, in one row. Documents are dealt to
    tasks by hash, about `most` values to each."""
    values = (rows.agg(F.sum(F.octet_length("first"))).first()[0] or 0) // 4
    ranges = -(-values // most) or 1
    names = ["range", "ids", "counts", "first", "second"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, counts, first, second = (np.frombuffer(x, kind) for x, kind in zip(row, (np.int64, np.int32, np.int32, np.int32), strict=True))
                with np.errstate(over="ignore"):
                    part = ((ids.astype(np.uint64) * P) >> np.uint64(32)).astype(np.int64) % ranges
                order = np.argsort(part, kind="stable")
                begins, out = np.cumsum(counts) - counts, []
                for pick in np.split(order, runs_of(part[order])[1:]) if len(order) else []:
                    at = ragged(begins[pick], counts[pick])
                    out.append((int(part[pick[0]]), ids[pick].tobytes(), counts[pick].tobytes(), first[at].tobytes(), second[at].tobytes() if len(second) else b""))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32())] + [pa.array([r[j] for r in out], pa.binary()) for j in range(1, 5)], names)

    def meet(table: pa.Table) -> pa.Table:
        ids, counts, first, second = (np.frombuffer(b"".join(table.column(n).to_pylist()), kind) for n, kind in zip(names[1:], (np.int64, np.int32, np.int32, np.int32), strict=True))
        order = np.argsort(ids, kind="stable")
        at = ragged((np.cumsum(counts) - counts)[order], counts[order])
        begin = runs_of(ids[order])
        cuts = (np.cumsum(counts[order]) - counts[order])[begin][1:]
        split = lambda x: [y.tobytes() for y in np.split(x[at], cuts)] if len(x) else [b""] * len(begin)
        return pa.table({"id": pa.array(ids[order][begin], pa.int64()), "first": pa.array(split(first), pa.binary()), "second": pa.array(split(second), pa.binary())})

    return rows.select("ids", "counts", "first", "second").mapInArrow(cut, "range int, ids binary, counts binary, first binary, second binary").groupBy("range").applyInArrow(meet, "id long, first binary, second binary")


def live_anchors(texts: DataFrame, shards: int) -> DataFrame:
    """Rows of ids, counts, places: documents end to end, and the places of their anchors that stand in several different
    texts; one for each shard and batch."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)

        def flush(ids, digests, ats, hs):
            ids, digests = np.array(ids), np.array(digests, np.int64)
            first = np.lexsort((ids, digests))
            alone = np.zeros(len(ids), bool)
            alone[first[runs_of(digests[first])]] = True  # of equal texts the smallest identifier speaks
            sizes = np.array([len(a) for a in ats])
            doc, at, h = np.repeat(np.arange(len(ids), dtype=np.int32), sizes), np.concatenate(ats).astype(np.int32), np.concatenate(hs)
            keep = alone[doc]
            doc, at, h = doc[keep], at[keep], h[keep]
            order = np.argsort(h, kind="stable")
            h, doc, at = h[order], doc[order], at[order]
            starts = runs_of(h)
            sizes = np.diff(np.r_[starts, len(h)])
            several = doc[starts] != doc[starts + sizes - 1]  # texts differ, and a run goes by document
            here = np.repeat(several, sizes)
            marks, lone = h[starts[several]], ~here
            rows = []
            if here.any():
                by = np.lexsort((at[here], doc[here]))
                who, at_here = doc[here][by], at[here][by]
                begin = runs_of(who)
                rows.append((-1 - int(ids[who[0]]) % (1 << 20), b"", np.diff(np.r_[begin, len(who)]).astype(np.int32).tobytes(), at_here.tobytes(), ids[who[begin]].tobytes(), b"", b""))
            h, doc, at = h[lone], doc[lone], at[lone]
            cuts, mark_cuts = np.r_[0, np.searchsorted(h, bounds), len(h)], np.r_[0, np.searchsorted(marks, bounds), len(marks)]
            for k in range(shards):
                a, z, m = cuts[k], cuts[k + 1], marks[mark_cuts[k] : mark_cuts[k + 1]]
                if a < z or len(m):
                    who, local = np.unique(doc[a:z], return_inverse=True)
                    rows.append((k, h[a:z].tobytes(), local.astype(np.int32).tobytes(), at[a:z].tobytes(), ids[who].tobytes(), digests[who].tobytes(), m.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[j] for r in rows], pa.binary()) for j in range(1, 7)], ["shard", "h", "doc", "place", "ids", "digests", "marks"])

        held, columns = 0, ([], [], [], [])
        for part in parts:
            for i, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                at, h = anchors(np.frombuffer(text, np.uint8))
                if len(at):
                    for column, value in zip(columns, (i, int.from_bytes(hashlib.sha256(text).digest()[:8], "little", signed=True), at, h), strict=True):
                        column.append(value)
                    held += len(at)
                if held > BATCH_ANCHORS:
                    yield flush(*columns)
                    held, columns = 0, ([], [], [], [])
        if held:
            yield flush(*columns)

    def meet(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        at, ids = np.frombuffer(b"".join(t["place"]), np.int32), np.frombuffer(b"".join(t["ids"]), np.int64)
        if t["shard"][0] < 0:  # live as they came
            sizes = np.frombuffer(b"".join(t["doc"]), np.int32)
            return as_row(ids, sizes, at)
        h, digests = np.frombuffer(b"".join(t["h"]), np.uint64), np.frombuffer(b"".join(t["digests"]), np.int64)
        marks = np.unique(np.frombuffer(b"".join(t["marks"]), np.uint64))
        shift, doc = 0, []
        for local, who in zip(t["doc"], t["ids"], strict=True):
            doc.append(np.frombuffer(local, np.int32) + shift)
            shift += len(who) // 8
        del t
        doc = np.concatenate(doc)
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], digests[doc[order]]
        starts = runs_of(hs)
        live = np.zeros(len(starts), bool)
        if len(starts):
            live = np.minimum.reduceat(ds, starts) != np.maximum.reduceat(ds, starts)
            if len(marks):
                live |= marks[np.minimum(np.searchsorted(marks, hs[starts]), len(marks) - 1)] == hs[starts]
        kept = order[np.repeat(live, np.diff(np.r_[starts, len(hs)]))]
        _, group = np.unique(digests, return_inverse=True)
        first = np.full(group.max(initial=0) + 1, NONE)
        np.minimum.at(first, group, ids)
        kept = kept[(first[group] == ids)[doc[kept]]]
        kept = kept[np.lexsort((at[kept], doc[kept]))]
        begin = runs_of(doc[kept])
        return as_row(ids[doc[kept][begin]], np.diff(np.r_[begin, len(kept)]), at[kept])

    return texts.mapInArrow(cut, "shard int, h binary, doc binary, place binary, ids binary, digests binary, marks binary").groupBy("shard").applyInArrow(meet, "ids binary, counts binary, first binary, second binary")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union."""
    order = np.argsort(starts, kind="stable")
    s, top = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > top[:-1]]
    at = np.flatnonzero(new)
    return s[at], top[np.r_[at[1:] - 1, len(s) - 1]]


def span_row(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """as_row() of the maximal runs of each document."""
    order = np.lexsort((starts, ids))
    i, a, z = ids[order], starts[order], ends[order]
    fresh = np.zeros(len(i), bool)
    fresh[runs_of(i)] = True
    # ends so far, by document: those of earlier documents are less than any start, once documents stand far apart
    far = np.cumsum(fresh) * (1 << 32)
    top = np.maximum.accumulate(z + far) if len(i) else z
    new = fresh | np.r_[True, (a + far)[1:] > top[:-1]] if len(i) else fresh
    at = np.flatnonzero(new)
    last = (top - far)[np.r_[at[1:] - 1, len(i) - 1]] if len(i) else z
    begin = runs_of(i[at])
    return as_row(i[at][begin], np.diff(np.r_[begin, len(at)]), a[at], last)


def surroundings(text: bytes, places: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Anchor's hash, start and bytes of each live anchor's surroundings that hold a window."""
    for p in np.unique(places).tolist():
        low = max(0, p - REACH + 1)
        if min(p + LENGTH, len(text)) - low >= LENGTH:
            yield xxhash.xxh64_intdigest(text[p : p + GRAM]), low, text[low : p + LENGTH]


def cut_points(sample: np.ndarray, shards: int) -> np.ndarray:
    """shards - 1 hashes that cut the anchors into shards of equal size: quantiles of the sample, and where it has less than
    LEAST_SAMPLES for each shard, even steps between these (between equal ones the same hash again, so that an anchor that
    fills several shards comes several times). Without a sample the whole range is cut evenly, as hashes are."""
    m = max(1, min(shards, len(sample) // LEAST_SAMPLES))
    steps = -(-shards // m)
    edges = [0, *np.sort(sample)[np.arange(1, m) * len(sample) // m].tolist(), (1 << 64) - 1]
    cuts = [a + (b - a) * k // steps for a, b in zip(edges[:-1], edges[1:], strict=True) for k in range(steps)][1:]
    return np.array(cuts, np.uint64)


def splitters(texts: DataFrame, live: DataFrame, entries: int) -> np.ndarray:
    """Anchors' hashes at which shards are cut, from a sample of live anchors: SAMPLES a shard, at most MOST_SAMPLES in the
    mean. Of many documents some are read, of few all; in these, places are taken by a hash."""
    shards = max(1, -(-entries * (LENGTH + REACH) // SHARD_BYTES))
    if shards == 1:
        return np.zeros(0, np.uint64)
    rate = max(1, entries // min(MOST_SAMPLES, SAMPLES * shards))
    of_documents = max(1, min(rate, live.count() // LEAST_DOCUMENTS))
    of_places = np.uint64(-(-rate // of_documents))
    some = lambda df: df.where(F.pmod(F.xxhash64("id"), F.lit(of_documents)) == 0)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            h = []
            for i, text, places in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                at = np.frombuffer(places, np.int32)
                with np.errstate(over="ignore"):
                    mixed = (at.astype(np.uint64) + np.uint64(i & (1 << 64) - 1) * P) * P
                h += [x[0] for x in surroundings(text, at[(mixed >> np.uint64(20)) % of_places == 0])]
            yield pa.RecordBatch.from_arrays([pa.array([np.array(h, np.uint64).tobytes()], pa.binary())], ["h"])

    got = maybe_in(some(texts), some(live), "id").join(some(live), "id").select("id", "text", "places").mapInArrow(run, "h binary").collect()
    return cut_points(np.frombuffer(b"".join(r.h for r in got), np.uint64), shards)


def dealt(split: np.ndarray, h: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each surrounding, and whether its anchor spans several; among those its salt decides."""
    low, high = np.searchsorted(split, h, "left"), np.searchsorted(split, h, "right")
    several = high - low > 1
    return np.where(several, low + (salt % (high - low + 1).astype(np.uint64)).astype(np.int64), low), several


def cut_pieces(met: DataFrame, split: np.ndarray) -> DataFrame:
    """From id, text, places: rows of bundle, within (the shard of each piece, of those in the bundle), pieces (end to end),
    lengths, counts, ids, starts: surroundings of live anchors, of equal ones in a batch those of the smallest identifier.
    Rows of bundle -1 and below hold spans (ids, starts, lengths): the other ones, which go whole."""
    together = max(1, min(TOGETHER, (len(split) + 1) // LEAST_BUNDLES))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[bytes, list] = {}
        held = 0

        def flush(salt: int):
            pieces, gone, found = list(out), [], []
            for piece, (_, *places) in out.items():
                least = min(places)[0]
                found.append([x for x in places if x[0] == least])
                gone += [(i, low, len(piece)) for i, low in places if i != least]
            shard, several = dealt(split, np.array([v[0] for v in out.values()], np.uint64), np.array([xxhash.xxh64_intdigest(x) for x in pieces], np.uint64))
            bundle, within = shard // together, (shard % together).astype(np.uint8)
            rows, order = [], np.argsort(shard, kind="stable")
            for pick in np.split(order, runs_of(bundle[order])[1:]):
                flat = [x for k in pick.tolist() for x in found[k]]
                lengths = (np.array([len(pieces[k]) for k in pick.tolist()]) + 128 * several[pick]).astype(np.uint8)
                rows.append((int(bundle[pick[0]]), within[pick].tobytes(), b"".join(pieces[k] for k in pick.tolist()), lengths.tobytes(), np.array([len(found[k]) for k in pick.tolist()], np.int32).tobytes(), np.array([x[0] for x in flat], np.int64).tobytes(), np.array([x[1] for x in flat], np.int32).tobytes()))
            if gone:
                i, low, size = zip(*gone, strict=True)
                rows.append((-1 - salt % (1 << 20), b"", b"", np.array(size, np.uint8).tobytes(), b"", np.array(i, np.int64).tobytes(), np.array(low, np.int32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[j] for r in rows], pa.binary()) for j in range(1, 7)], ["bundle", "within", "pieces", "lengths", "counts", "ids", "starts"])

        for part in parts:
            for i, text, places in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                for h, low, piece in surroundings(text, np.frombuffer(places, np.int32)):
                    if piece in out:
                        out[piece].append((i, low))
                    else:
                        out[piece] = [h, (i, low)]
                    held += 1
                if held > BATCH_PIECES:
                    yield flush(i)
                    out.clear()
                    held = 0
        if held:
            yield flush(i)

    return met.mapInArrow(run, "bundle int, within binary, pieces binary, lengths binary, counts binary, ids binary, starts binary")


def eight_bytes(flat: np.ndarray, kind: str) -> np.ndarray:
    """At each place, that byte and the seven after it (zeros past the end) as a number, without a copy for each."""
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    return np.ndarray(len(flat), np.dtype(kind), padded, strides=(1,))


def sorted_by(group: np.ndarray, key: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of group, key, place; and where (group, key) changes. Each is less than 2 ** bits."""
    if 3 * bits <= 64:
        b = np.uint64(bits)
        packed = np.sort((((group.astype(np.uint64) << b) | key.astype(np.uint64)) << b) | place.astype(np.uint64))
        both = packed >> b
        return (packed & np.uint64((1 << bits) - 1)).astype(np.int32), np.r_[True, both[1:] != both[:-1]]
    order = np.lexsort((place, key, group))
    g, k = group[order], key[order]
    return place[order], np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])]


def suffix_array(flat: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the pieces that flat holds end to end, in order, and their ranks (a group's first place and one).
    room: bytes from each place to its piece's end; an end is less than any byte, and equal suffixes go by their place.

    Larsson-Sadakane: suffixes start in groups of equal first bytes. A group of several is sorted by the ranks of what
    follows its prefix, which doubles the prefix; groups of one, and those of suffixes that have ended, are done."""
    n, depth = len(flat), 5
    bits = (n + 1).bit_length()
    key = eight_bytes(flat, ">u8").astype(np.uint64) >> np.uint64(24)
    short = np.flatnonzero(room < depth)
    gone = (8 * (depth - room[short])).astype(np.uint64)
    key[short] = key[short] >> gone << gone
    key <<= np.uint64(3)
    key |= np.minimum(room, depth).astype(np.uint64)
    if bits <= 21:
        key <<= np.uint64(21)
        key |= np.arange(n, dtype=np.uint64)
        key.sort()
        sa = (key & np.uint64((1 << 21) - 1)).astype(np.int32)
        key >>= np.uint64(21)
    else:
        sa = np.argsort(key, kind="stable")
        key = key[sa]
    new = np.r_[True, key[1:] != key[:-1]] if n else np.zeros(0, bool)
    del key
    rank = np.zeros(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0)) + 1
    act = np.arange(n, dtype=np.int32)
    while len(act):
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(act)])
        open_ = (sizes > 1) & (room[sa[act[starts]]] >= depth)
        if not open_.any():
            break
        act = act[ragged(starts[open_], sizes[open_])]
        group, i = np.repeat(np.arange(int(open_.sum())), sizes[open_]), sa[act]
        follows = np.where(room[i] > depth, rank[np.minimum(i + depth, n - 1)], 0)
        i, new = sorted_by(group, follows, i, bits)
        sa[act] = i
        rank[i] = np.maximum.accumulate(np.where(new, act, 0)) + 1
        depth *= 2
    return sa, rank


def common_prefixes(flat: np.ndarray, sa: np.ndarray, room: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each suffix in order, the bytes it shares with the one before.

    Kasai: the suffix at the next place shares at most one byte less with the one before it, so that comparing goes on
    from there. All pieces go along their places in step; eight bytes are compared at once."""
    n, words = len(flat), eight_bytes(np.concatenate([flat, np.zeros(8, np.uint8)]), "<u8")
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, np.int32)
    order = np.argsort(-sizes, kind="stable")
    start, left = (np.cumsum(sizes) - sizes)[order], sizes[order]
    have = np.zeros(len(sizes), np.int64)
    for step in range(int(sizes.max(initial=0))):
        k = int(np.searchsorted(-left, -step, "left"))  # pieces that are longer than step
        i = start[:k] + step
        j = before[i].astype(np.int64)
        l = np.where(j >= 0, np.maximum(have[:k] - 1, 0), 0)
        j = np.maximum(j, 0)
        most = np.where(before[i] >= 0, np.minimum(room[i], room[j]), 0)
        go = np.flatnonzero(l < most)
        while len(go):
            x = words[i[go] + l[go]] ^ words[j[go] + l[go]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            l[go] += same
            go = go[(same == 8) & (l[go] < most[go])]
        have[:k] = np.minimum(l, most)
        shared[i] = have[:k]
    return shared[sa]


def shard_windows(pieces: list[bytes], which: np.ndarray, ids: np.ndarray, starts: np.ndarray):
    """Piece which[k] stands in text ids[k] at starts[k]. Spans (id, start, end) to remove; and for each place's windows,
    end to end: its entry, its offset in the piece, and whether it is the first of its run in this shard."""
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(p, len(known)) for p in pieces], np.int64)[which]
    sizes = np.array([len(p) for p in known], np.int64)
    ends = np.cumsum(sizes)
    first = np.full(len(sizes), NONE)
    np.minimum.at(first, which, ids)
    flat = np.frombuffer(b"".join(known), np.uint8)
    room = (np.repeat(ends, sizes) - np.arange(len(flat))).astype(np.int32)
    sa, _ = suffix_array(flat, room)
    fresh = common_prefixes(flat, sa, room, sizes) < LENGTH
    owner = np.full(len(flat), NONE)
    if len(flat):
        owner[sa] = np.minimum.reduceat(np.repeat(first, sizes)[sa], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    del sa, fresh
    counts = np.maximum(0, sizes - LENGTH + 1)[which]
    entry, offset = np.repeat(np.arange(len(which), dtype=np.int32), counts), ragged(np.zeros(len(which), np.int64), counts).astype(np.int32)
    gone = owner[(ends - sizes)[which][entry] + offset] < ids[entry]
    place = starts[entry] + offset
    edge = np.r_[True, entry[1:] != entry[:-1]] if len(entry) else np.zeros(0, bool)
    begins = np.flatnonzero(gone & (edge | ~np.r_[False, gone[:-1]]))
    stops = np.flatnonzero(gone & np.r_[edge[1:] | ~gone[1:], True]) if len(gone) else begins
    return (ids[entry[begins]], place[begins], place[stops] + LENGTH), entry, offset, ~gone


def shard_spans(cut: DataFrame) -> DataFrame:
    """A row of spans for each shard, and beside it, where it shares an anchor with others, the windows around that anchor:
    digests in order, and the identifiers and places of those that hold them."""

    def row(spans: tuple, windows: list | None = None) -> pa.Table:
        out = span_row(*spans)
        for name, x in zip(("digests", "who", "place"), windows or [None] * 3, strict=True):
            out = out.append_column(name, pa.array([x], pa.binary()))
        return out

    def shard(pieces: list[bytes], several: np.ndarray, counts: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> pa.Table:
        which = np.repeat(np.arange(len(pieces)), counts)
        spans, entry, offset, ours = shard_windows(pieces, which, ids, starts)
        border = np.flatnonzero(ours & several[which][entry])
        if not len(border):
            return row(spans)
        e, o = entry[border], offset[border]
        found = b"".join(hashlib.blake2b(pieces[x][y : y + LENGTH], digest_size=16).digest() for x, y in zip(which[e].tolist(), o.tolist(), strict=True))
        words = np.frombuffer(found, ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((words[:, 1], words[:, 0]))
        return row(spans, [words[order].tobytes(), ids[e][order].tobytes(), (starts[e] + o)[order].astype(np.int32).tobytes()])

    def meet(table: pa.Table) -> pa.Table:
        whole = table.column("bundle")[0].as_py() < 0
        end_to_end = lambda name: b"".join(table.column(name).to_pylist())
        ids, starts = np.frombuffer(end_to_end("ids"), np.int64), np.frombuffer(end_to_end("starts"), np.int32).astype(np.int64)
        lengths = np.frombuffer(end_to_end("lengths"), np.uint8)
        if whole:  # as they came
            return row((ids, starts, starts + lengths))
        flat, within, counts = end_to_end("pieces"), np.frombuffer(end_to_end("within"), np.uint8), np.frombuffer(end_to_end("counts"), np.int32)
        del table
        several, sizes = lengths >= 128, (lengths & 127).astype(np.int64)
        begins, firsts, out = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts, []
        order = np.argsort(within, kind="stable")
        for pick in np.split(order, runs_of(within[order])[1:]):
            at = ragged(firsts[pick], counts[pick])
            pieces = [flat[a : a + n] for a, n in zip(begins[pick].tolist(), sizes[pick].tolist(), strict=True)]
            out.append(shard(pieces, several[pick], counts[pick], ids[at], starts[at]))
        return pa.concat_tables(out)

    return cut.groupBy("bundle").applyInArrow(meet, "ids binary, counts binary, first binary, second binary, digests binary, who binary, place binary")


def searched(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of words in sorted keys (both of two integers a row): the first place that isn't less, and whether it
    is equal."""
    low, high = np.zeros(len(words), np.int64), np.full(len(words), len(keys))
    while (low < high).any():
        go, mid = low < high, (low + high) // 2
        m = keys[np.minimum(mid, len(keys) - 1)]
        less = (m[:, 0] < words[:, 0]) | ((m[:, 0] == words[:, 0]) & (m[:, 1] < words[:, 1]))
        low, high = np.where(go & less, mid + 1, low), np.where(go & ~less, mid, high)
    if not len(keys):
        return low, np.zeros(len(words), bool)
    return low, (low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == words).all(1)


def owners(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of sorted runs (windows, identifiers) and their smallest identifiers: runs are merged two by two,
    the windows of one searched for in the other."""
    if not runs:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
    runs = [(w[b], np.minimum.reduceat(i, b)) for w, i in runs for b in [np.flatnonzero(np.r_[True, (w[1:] != w[:-1]).any(1)])]]
    while len(runs) > 1:
        merged_runs = [] if len(runs) % 2 == 0 else [runs.pop()]
        for (wa, ia), (wb, ib) in zip(runs[::2], runs[1::2], strict=True):
            at, hit = searched(wa, wb)
            ia = ia.copy()
            ia[at[hit]] = np.minimum(ia[at[hit]], ib[hit])
            merged_runs.append((np.insert(wa, at[~hit], wb[~hit], axis=0), np.insert(ia, at[~hit], ib[~hit])))
        runs = merged_runs
    return runs[0]


def merged_spans(rows: DataFrame, ranges: int) -> DataFrame:
    """A row of spans for each range: windows of border anchors that stand in a smaller identifier of another shard."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
        for batch in batches:
            for digests, who, place in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                w, who, place = np.frombuffer(digests, np.uint64).reshape(-1, 2), np.frombuffer(who, np.int64), np.frombuffer(place, np.int32)
                cuts = np.r_[0, np.searchsorted(w[:, 0], bounds), len(w)]
                out = [(k, w[a:z].tobytes(), who[a:z].tobytes(), place[a:z].tobytes()) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < z]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32())] + [pa.array([r[j] for r in out], pa.binary()) for j in range(1, 4)], ["range", "digests", "who", "place"])

    def meet(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        runs = [(np.frombuffer(w, np.uint64).reshape(-1, 2), np.frombuffer(i, np.int64)) for w, i in zip(t["digests"], t["who"], strict=True)]
        keys, least = owners(runs)
        spans = []
        for (w, i), place in zip(runs, t["place"], strict=True):
            gone = least[searched(keys, w)[0]] < i
            spans.append((i[gone], np.frombuffer(place, np.int32)[gone].astype(np.int64)))
        ids, starts = (np.concatenate(x) for x in zip(*spans, strict=True))
        return span_row(ids, starts, starts + LENGTH)

    return rows.mapInArrow(cut, "range int, digests binary, who binary, place binary").groupBy("range").applyInArrow(meet, "ids binary, counts binary, first binary, second binary")


def repeated_spans(texts: DataFrame, total_bytes: int) -> DataFrame:
    """id, first, second: starts and ends of runs, not yet merged."""
    found = stage(live_anchors(texts, max(LEAST_SHARDS, round(total_bytes / 18 / SHARD_ANCHORS))), "sub-live")
    entries = (found.agg(F.sum(F.octet_length("first"))).first()[0] or 0) // 4
    live = stage(by_document(found).select("id", F.col("first").alias("places")), "sub-places")
    discard(found)
    met = maybe_in(texts, live, "id").join(live.hint("merge"), "id").select("id", "text", "places")
    shards = stage(shard_spans(cut_pieces(met, splitters(texts, live, entries))), "sub-shards")
    border = shards.where("digests is not null").select("digests", "who", "place")
    windows = (border.agg(F.sum(F.octet_length("digests"))).first()[0] or 0) // 16
    spans = shards.select("ids", "counts", "first", "second")
    if windows:
        spans = spans.union(stage(merged_spans(border, -(-windows // RANGE_WINDOWS)), "sub-merged"))
    return by_document(spans)


def with_first(base: DataFrame) -> DataFrame:
    """base with first, the smallest identifier of its text if it has LENGTH bytes. A text's rows meet it in SALTS parts."""
    salted = base.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = salted.where(f"n_bytes >= {LENGTH} and id is not null").groupBy("sha", "salt").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    firsts = part.groupBy("sha").agg(F.min("low").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    by_part = part.select("sha", "salt").join(firsts, "sha")
    return salted.join(by_part, ["sha", "salt"], "left").drop("salt")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and kept, the bytes left, where some but not all are."""
    small_batches(docs.sparkSession, 4)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = stage(texts.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "sub-base")
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    some = texts.where(f"id is not null and octet_length(text) >= {LENGTH}")
    spans = stage(repeated_spans(some, total).where("octet_length(first) > 0").select("id", F.col("first").alias("starts"), F.col("second").alias("ends")), "sub-spans")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for i, text, starts, ends in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                a, z = merged(np.frombuffer(starts, np.int32), np.frombuffer(ends, np.int32))
                b = np.r_[0, z]
                kept = b"".join(text[x:y] for x, y in zip(b.tolist(), np.r_[a, len(text)].tolist(), strict=True))
                rows.append((i, int((z - a).sum()), len(a), hashlib.sha256(kept).digest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["id", "removed", "spans", "kept_sha", "kept"])

    done = maybe_in(texts, spans, "id").join(spans.hint("merge"), "id").select("id", "text", "starts", "ends").mapInArrow(cut, "id long, removed long, spans long, kept_sha binary, kept binary").dropDuplicates(["id"])
    out = with_first(base).join(done, "id", "left")
    copy = (F.col("n_bytes") >= LENGTH) & (F.col("first") < F.col("id"))
    sha = F.when(copy, F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("kept_sha", "sha"))
    return out.select(
        "id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.lower(F.hex(sha)).alias("kept_sha256"),
        F.when(~F.coalesce(copy, F.lit(False)), F.col("kept")).alias("kept"),
    )


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept").withColumnRenamed("id", "doc_id")
