"""Language-model scores by deleted interpolation: bigram, unigram and uniform estimates, mixed by context frequency.

Texts are packed once into blocks of hashed tokens, each block from one fold. A block asks for the counts of its distinct
words and word pairs: sorted keys go to shards of the hash space, a shard adds up all blocks' counts, and answers come
back in the order of the keys. So every count is exact, over all training documents, and no task holds more than a shard
or a few blocks. Mixture weights of each bucket of context counts are learned by expectation-maximisation on held-out
counts: for a training token, those of all folds but its own; tokens are counted in bins of a quarter of a power of two of
either probability, so that what the driver learns from has a fixed size. Trigrams are left out for their keys' room: with
pairs alone the operator writes nearly four times its input.

A text's tokens are its words and one end, which is also the context of the first. Counts of words are exact up to
collisions of 64-bit hashes.

Defined cases: a null or empty text is its end alone; texts of any length are scored whole; a null identifier is held out;
repeated rows are counted and scored each; with no training rows all scores are uniform; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.llm.arrow import as_bytes, small_batches
from sameword.shared import stage

HELD_OUT, FOLDS = 1, 5
BLOCK_TOKENS, SHARD_KEYS = 400_000, 3_000_000
BUCKETS, BINS = 18, 128
END = 0x5851F42D4C957F2D
KEPT_WORDS = 400_000


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def packed(x: np.ndarray) -> bytes:
    """An array of integers, its bytes by significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpacked(b: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, np.uint64), dtype=np.uint64)


def pair_keys(words: np.ndarray, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key for each token and the one before it; the end stands before a text's first."""
    w = words[index]
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[np.cumsum(sizes) - sizes] = END
    with np.errstate(over="ignore"):
        k = (before ^ (before >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + w
        k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


def pack_blocks(docs: DataFrame) -> DataFrame:
    """From id, fold, text: rows of block, fold, n, ids, sizes, words (distinct, sorted), index."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seq, base = Words(), 0, TaskContext.get().partitionId() << 24
        held: dict[int, tuple[list, list]] = {}

        def flush(fold: int) -> pa.RecordBatch:
            nonlocal seq
            ids, tokens = held.pop(fold)
            words, index = np.unique(np.concatenate(tokens), return_inverse=True)
            seq += 1
            sizes = np.array([len(t) for t in tokens], np.int32)
            row = [base + seq, fold, int(sizes.sum()), packed(np.array([i is None for i in ids], np.uint8)), packed(np.array([i or 0 for i in ids], np.int64)), packed(sizes), packed_keys(words), packed(index.astype(np.uint32))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["block", "fold", "n", "nulls", "ids", "sizes", "words", "index"])

        count: dict[int, int] = {}
        for part in parts:
            for i, fold, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), strict=True):
                if len(known) > KEPT_WORDS:
                    known.clear()
                w = text.lower().split()
                t = np.empty(len(w) + 1, np.uint64)
                t[:-1] = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
                t[-1] = END
                ids, tokens = held.setdefault(fold, ([], []))
                ids.append(i)
                tokens.append(t)
                count[fold] = count.get(fold, 0) + len(t)
                if count[fold] >= BLOCK_TOKENS:
                    count[fold] = 0
                    yield flush(fold)
        for fold in list(held):
            yield flush(fold)

    return docs.mapInArrow(run, "block long, fold int, n long, nulls binary, ids binary, sizes binary, words binary, index binary")


def counted(blocks: DataFrame, pairs: bool, shards: int) -> DataFrame:
    """Answers: kind, block, shard, total (over training folds) and own (the block's fold), in the order of the block's
    sorted keys; and for each shard a row of block -1 with the sum and number of training keys, and each fold's sum."""

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                block, fold, sizes, words, index = (part.column(k)[row].as_py() for k in range(5))
                words, index = unpacked_keys(words), unpacked(index, np.uint32)
                if pairs:
                    keys, times = np.unique(pair_keys(words, index, unpacked(sizes, np.int32)), return_counts=True)
                else:
                    keys, times = words, np.bincount(index, minlength=len(words))
                cuts = np.searchsorted(keys, np.array([(k << 64) // shards for k in range(1, shards)], np.uint64))
                got = [(k, a, t) for k, (a, t) in enumerate(zip(np.split(keys, cuts), np.split(times, cuts), strict=True)) if len(a)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int32()), pa.array([block] * len(got), pa.int64()), pa.array([fold] * len(got), pa.int32()), pa.array([packed_keys(g[1]) for g in got], pa.binary()), pa.array([packed(g[2].astype(np.uint32)) for g in got], pa.binary())],
                    ["shard", "block", "fold", "keys", "times"],
                )

    def meet(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        keys = [unpacked_keys(k) for k in t["keys"]]
        sizes = [len(k) for k in keys]
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        at, counts = np.split(at, np.cumsum(sizes)[:-1]), np.zeros((FOLDS, len(unique)), np.int64)
        for fold, a, times in zip(t["fold"], at, t["times"], strict=True):
            counts[fold, a] += unpacked(times, np.uint32)  # a block's keys are distinct
        total = counts.sum(0) - counts[HELD_OUT]
        out = [(b, packed(total[a]), packed(counts[f, a] if f != HELD_OUT else np.zeros(len(a), np.int64))) for b, f, a in zip(t["block"], t["fold"], at, strict=True)]
        out.append((-1, packed(np.array([total.sum(), (total > 0).sum()], np.int64)), packed(counts.sum(1))))
        return pa.table({"pairs": pa.array([pairs] * len(out), pa.bool_()), "block": pa.array([o[0] for o in out], pa.int64()), "shard": pa.array([t["shard"][0]] * len(out), pa.int32()), "total": pa.array([o[1] for o in out], pa.binary()), "own": pa.array([o[2] for o in out], pa.binary())})

    asked = blocks.select("block", "fold", "sizes", "words", "index").mapInArrow(ask, "shard int, block long, fold int, keys binary, times binary")
    return asked.groupBy("shard").applyInArrow(meet, "pairs boolean, block long, shard int, total binary, own binary")


def tokens_of(row: dict) -> dict[str, np.ndarray]:
    """What a block knows of each of its tokens: counts of word, context and pair, over training folds and its own."""
    words, index, sizes = unpacked_keys(row["words"]), unpacked(row["index"], np.uint32), unpacked(row["sizes"], np.int32)
    answers = sorted(row["answers"], key=lambda a: (a["pairs"], a["shard"]))
    whole = lambda pairs, part: np.concatenate([unpacked(a[part], np.int64) for a in answers if a["pairs"] == pairs])
    first = np.cumsum(sizes) - sizes
    out = {"sizes": sizes, "first": first, "ids": unpacked(row["ids"], np.int64), "nulls": unpacked(row["nulls"], np.uint8).astype(bool)}
    at = np.unique(pair_keys(words, index, sizes), return_inverse=True)[1]
    end = int(np.searchsorted(words, np.uint64(END)))
    for part in ("total", "own"):
        c = whole(False, part)
        out[f"word_{part}"] = w = c[index]
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[first] = c[end]
        out[f"context_{part}"], out[f"pair_{part}"] = before, whole(True, part)[at]
    return out


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1.0))).astype(np.int64)


def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def place(p: np.ndarray) -> np.ndarray:
    """Bins of a quarter of a power of two; the last holds zeros."""
    return np.where(p > 0, np.minimum(BINS - 2, np.round(-4 * np.log2(np.maximum(p, 1e-300)))), BINS - 1).astype(np.int64)


def weights_of(cells: np.ndarray, counts: np.ndarray, uniform: float, rounds: int = 200) -> np.ndarray:
    """Per bucket the shares of pair, word and uniform estimates, by expectation-maximisation over binned tokens."""
    centre = np.append(2.0 ** (-np.arange(BINS - 1) / 4), 0.0)
    b, p = cells // (BINS * BINS), np.stack([centre[cells // BINS % BINS], centre[cells % BINS], np.full(len(cells), uniform)], 1)
    w = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        part = w[b] * p
        part *= (counts / part.sum(1))[:, None]
        sums = np.stack([np.bincount(b, part[:, k], BUCKETS) for k in range(3)], 1)
        # a bucket that held-out tokens never reach keeps even weights; none is ever zero
        w = (sums + 1e-3) / (sums + 1e-3).sum(1, keepdims=True)
    # a context without counts has no pairs: the others share their weight
    w[0, 0] = 0.0
    w[0] /= w[0].sum()
    return w


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS, F.lit(HELD_OUT)).cast("int")
    blocks = stage(pack_blocks(docs.select(F.col(id_col).cast("long").alias("id"), fold.alias("fold"), F.col(text_col).cast("string").alias("text"))), "lm-blocks")
    tokens = blocks.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-tokens // SHARD_KEYS))
    answers = stage(counted(blocks, False, shards).union(counted(blocks, True, shards)), "lm-answers")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + FOLDS, np.int64)
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.concatenate([unpacked(a, np.int64), unpacked(b, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in total], [f"x{k}" for k in range(2 + FOLDS)])

    sums = answers.where("block = -1 and not pairs").select("total", "own").mapInArrow(add, ", ".join(f"x{k} long" for k in range(2 + FOLDS)))
    n, v, *by_fold = (x or 0 for x in sums.agg(*[F.sum(f"x{k}") for k in range(2 + FOLDS)]).first())
    uniform = 1 / (v + 1)
    held = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("pairs", "shard", "total", "own")).alias("answers"))
    met = blocks.join(held, "block")

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = tokens_of(row)
                context = t["context_total"] - t["context_own"]
                pair, word = share(t["pair_total"] - t["pair_own"], context), (t["word_total"] - t["word_own"]) / max(1, n - by_fold[row["fold"]])
                cells, counts = np.unique((bucket(context) * BINS + place(pair)) * BINS + place(word), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts, pa.int64())], ["cell", "n"])

    binned = met.where(f"fold <> {HELD_OUT}").mapInArrow(bins, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS * BINS * BINS
    binned.sort()
    weights = weights_of(np.array([r.cell for r in binned], np.int64), np.array([r.n for r in binned], np.float64), uniform)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = tokens_of(row)
                w = weights[bucket(t["context_total"])]
                p = w[:, 0] * share(t["pair_total"], t["context_total"]) + w[:, 1] * t["word_total"] / max(1, n) + w[:, 2] * uniform
                per = lambda x: np.add.reduceat(x, t["first"])  # noqa: B023, E731
                k = len(t["ids"])
                columns = [
                    pa.array(t["ids"], pa.int64(), mask=t["nulls"]), pa.array([row["fold"] == HELD_OUT] * k, pa.bool_()), pa.array(t["sizes"].astype(np.int64)), pa.array(per((t["word_total"] > 0).astype(np.int64))),
                    pa.array([n] * k, pa.int64()), pa.array(per(np.log10((t["word_total"] + 0.5) / (n + 0.5 * (v + 1))))), pa.array(per(np.log10(p))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met.mapInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
