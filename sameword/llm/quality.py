"""Quality classifier: gated attention over passages, learned from document labels (multiple-instance learning).

A text is cut into passages of PASSAGE bytes. Each passage is encoded by the mean of its words' vectors, by the shares of
its byte classes and of pairs of neighbouring classes, and a learned layer over them. Words (lower case A-Z, between white
space, each in the passage where it starts) are hashed to BUCKETS vectors that are learned too. Gated attention weighs the
passages of a document, and the weighted mean gives its score. Labels are read for documents only; language, source and
identifier never reach the score.

Defined cases: a null or empty text is one empty passage and gets a score; texts of any length are read whole; rows
with a null label are not learned from; a document with several labels is learned from once for each; with no labelled
row, or labels of one kind only, every score is the share of label 1 (0.5 with none); repeated rows get equal scores; a
null identifier is in no fold (held_out is null) and gets a score; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.llm.arrow import flat_bytes, ragged, small_batches

PASSAGE = 512
#: At most so many labelled documents, of the smallest hashes, are fitted; every document is scored.
SAMPLE = 6000
#: Memory's bound: of these, documents are fitted whole in the order of their hashes until they have so many passages.
MOST_PASSAGES = 1 << 18
THRESHOLD = 0.3
CLASSES = 14


def byte_classes() -> np.ndarray:
    table = np.full(256, 13, np.uint8)
    for n, group in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".", b",", b"!?", b"|", b"#$%&*", b"-_'\"()[]:;/@", b"<>{}=+\\^~`"]):
        table[list(group)] = n
    table[128:] = 12
    return table


TABLE = byte_classes()
WIDTH = CLASSES + CLASSES * CLASSES + 1
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
#: Weights of the bytes of a word by their place, which goes round.
POWERS = np.array([pow(0x5851F42D4C957F2D, k + 1, 1 << 64) for k in range(64)], np.uint64)


@dataclass
class Bags:
    """Passages of documents: features, words end to end (as buckets), words of each passage, passages of each document."""

    x: np.ndarray
    words: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    def some(self, docs: np.ndarray) -> Bags:
        at = ragged(self.first[docs], self.counts[docs])
        begin = np.cumsum(self.sizes) - self.sizes
        return Bags(self.x[at].astype(np.float32), self.words[ragged(begin[at], self.sizes[at])], self.sizes[at], self.counts[docs])


def words_of(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word of texts end to end, and the place where it starts. A word ends where its text does."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    edge = np.zeros(len(flat) + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    if not len(starts):
        return np.zeros(0, np.int64), starts
    word = np.cumsum(np.bincount(starts, minlength=len(flat))) - 1
    place = np.arange(len(flat)) - starts[np.maximum(word, 0)]
    lower = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint64)
    with np.errstate(over="ignore"):
        terms = np.where(inside, (lower + np.uint64(1)) * POWERS[place % len(POWERS)], np.uint64(0))
        h = np.add.reduceat(terms, starts) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), starts


def passages(flat: np.ndarray, ends: np.ndarray) -> Bags:
    """Every passage of texts end to end; a text has one at least."""
    sizes = np.diff(ends)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(counts) - counts
    owner = np.repeat(first, sizes) + ragged(np.zeros(len(sizes), np.int64), sizes) // PASSAGE
    kind = TABLE[flat].astype(np.int64)
    total = int(counts.sum())
    one = np.bincount(owner * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES)
    both = owner[1:] == owner[:-1]
    two = np.bincount((owner[:-1] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[both], minlength=total * CLASSES * CLASSES).reshape(total, -1)
    n = np.maximum(1, one.sum(1, keepdims=True))
    words, starts = words_of(flat, ends)
    return Bags(np.hstack([np.sqrt(one / n), np.sqrt(two / n), np.log1p(n) / 6]).astype(np.float32), words, np.bincount(owner[starts], minlength=total), counts)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """h = tanh(xE + mean of T[words] + e); a = softmax over a document of v . (tanh(hA) * sigmoid(hB)); score =
    sigmoid(w . sum(a h) + b)."""

    def __init__(self, seed: int = 7, hidden: int = 32, gate: int = 16):
        r = np.random.default_rng(seed)
        init = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"E": init(WIDTH, hidden), "e": np.zeros(hidden), "A": init(hidden, gate), "B": init(hidden, gate), "v": init(gate), "w": init(hidden), "b": np.zeros(1), "T": np.zeros((BUCKETS, hidden))}
        self.constant: float | None = None

    def forward(self, d: Bags):
        p, owner, first = self.p, np.repeat(np.arange(len(d.counts)), d.counts), d.first
        mean, full = np.zeros((len(d.sizes), p["T"].shape[1])), np.flatnonzero(d.sizes)
        if len(full):
            mean[full] = np.add.reduceat(p["T"][d.words], (np.cumsum(d.sizes) - d.sizes)[full], axis=0) / d.sizes[full, None]
        h = np.tanh(d.x @ p["E"] + mean + p["e"])
        t, g = np.tanh(h @ p["A"]), sigmoid(h @ p["B"])
        s = (t * g) @ p["v"]
        s = np.exp(s - np.maximum.reduceat(s, first)[owner])
        a = s / np.add.reduceat(s, first)[owner]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return owner, h, t, g, a, z, sigmoid(z @ p["w"] + p["b"])

    def score(self, d: Bags) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(d.counts), self.constant)
        return self.forward(d)[-1]

    def gradients(self, d: Bags, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy."""
        p, (owner, h, t, g, a, z, q) = self.p, self.forward(d)
        dq = (q - y) / len(y)
        dz = dq[:, None] * p["w"]
        da = (dz[owner] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, d.first)[owner])
        dtg = ds[:, None] * p["v"]
        dA, dB = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz[owner] + dA @ p["A"].T + dB @ p["B"].T) * (1 - h * h)
        dT = np.zeros_like(p["T"])
        if len(d.words):
            order = np.argsort(d.words, kind="stable")
            begin = np.flatnonzero(np.r_[True, np.diff(d.words[order]) != 0])
            passage = np.repeat(np.arange(len(d.sizes)), d.sizes)[order]
            dT[d.words[order][begin]] = np.add.reduceat((dh / np.maximum(1, d.sizes)[:, None])[passage], begin, axis=0)
        return {"E": d.x.T @ dh, "e": dh.sum(0), "A": h.T @ dA, "B": h.T @ dB, "v": ds @ (t * g), "w": z.T @ dq, "b": np.array([dq.sum()]), "T": dT}

    def fit(self, d: Bags, y: np.ndarray, rounds: int = 24, size: int = 64, rate: float = 0.01, seed: int = 3) -> Model:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        r, p = np.random.default_rng(seed), self.p
        m, v2, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        for _ in range(rounds):
            order = r.permutation(len(y))
            for at in range(0, len(y), size):
                docs = order[at : at + size]
                grads = self.gradients(d.some(docs), y[docs])
                step += 1
                for k, g in grads.items():
                    g = g + (1e-4 if k == "T" else 1e-5) * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def training_fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, most: int = MOST_PASSAGES) -> Model:
    """A model of the labelled training documents: those with the sample smallest hashes of their identifiers, each with
    all of its passages. The last ones are left out when those before them have `most` passages already."""
    small_batches(docs.sparkSession, 2)
    marked = labels.where(F.col(label_col).isNotNull() & training_fold(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    few = marked.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id").select("_id", "_y", "_text")
    key, size = F.struct(F.xxhash64("_id"), "_id", "_y"), F.greatest(F.lit(1), F.ceil(F.octet_length(F.col("_text").cast("string")) / PASSAGE))
    sizes = sorted((tuple(r.k), r.n) for r in texts.select(key.alias("k"), size.alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in sizes)])
    if before[-1] > most:
        last = sizes[max(0, int(np.searchsorted(before, most)) - 1)][0]
        kinds = ("bigint", texts.schema["_id"].dataType, "double")
        texts = texts.where(key <= F.struct(*[F.lit(x).cast(kind) for x, kind in zip(last, kinds, strict=True)]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            d = passages(*flat_bytes(part.column(2)))
            cut, cut_words = np.cumsum(d.counts)[:-1], np.cumsum(np.add.reduceat(d.sizes, d.first))[:-1] if part.num_rows else []
            blobs = [[x.tobytes() for x in np.split(column, at)] for column, at in ((d.x.astype(np.float16), cut), (d.sizes.astype(np.uint16), cut), (d.words.astype(np.uint16), cut_words))] if part.num_rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), *[pa.array(b, pa.binary()) for b in blobs]], ["id", "y", "x", "sizes", "words"])

    rows = sorted(texts.mapInArrow(run, "id long, y double, x binary, sizes binary, words binary").collect(), key=lambda r: (r.id, r.y))
    joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
    d = Bags(joined("x", np.float16).reshape(-1, WIDTH), joined("words", np.uint16), joined("sizes", np.uint16).astype(np.int64), np.array([len(r.sizes) // 2 for r in rows], np.int64))
    return Model().fit(d, np.array([r.y for r in rows]))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs and one more column, the probability of label 1. A column of that name must not be there yet."""
    small_batches(docs.sparkSession, 2)
    if score_col in docs.columns:
        raise ValueError(f"there is a column {score_col} already")

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(passages(*flat_bytes(texts))), pa.float64())

    return docs.withColumn(score_col, F.arrow_udf(scored, "double")(F.col(text_col)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", (~training_fold("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
