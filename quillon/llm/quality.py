"""Operator 4: quality classifier, a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by
``OVERLAP`` and cover the whole text. Learned filters (a byte embedding folded into
``WIDTH`` tables of filter responses) run over each chunk at every second byte; each
filter's response is max-pooled over the chunk; a small dense layer turns a chunk
into a logit, and the mean logit over all chunks gives the text's probability.

Training uses at most ``SAMPLE`` labelled texts, whole, with all of their chunks: the
first ones in a hash order of their ids while they take at most ``SAMPLE_BYTES`` together
(held-out rows never). So it is bounded and the same however the tables are laid out.
A text's chunks weigh as much as another text's. Only text is an input.

Defined cases: null and empty texts are one chunk of padding and get its score; rows
without a label are scored like others; a label table without usable rows gives the
score 0.5; repeated rows get equal scores, and rows that share an id train with the
least of their texts; extra columns are ignored, or kept by ``keep_good``. Training runs
when a function is called.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.session import bound_batches
from quillon.llm.textkernel import SLICE_BYTES, slices, utf8

CHUNK, OVERLAP, WIDTH, STRIDE = 256, 32, 6, 2
EMBED, FILTERS, HIDDEN = 8, 32, 16
SAMPLE, SAMPLE_BYTES, EPOCHS, BATCH = 4000, 16 << 20, 4, 64
THRESHOLD = 0.3
LONG_TEXT = 8 * SLICE_BYTES
_STEPS = (CHUNK - WIDTH) // STRIDE + 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chunk_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, first chunk of each text): overlapping, covering, the last one padded with zeros."""
    size = np.diff(offsets)
    hop = CHUNK - OVERLAP
    n = np.maximum(1, -(-np.maximum(size - OVERLAP, 0) // hop))
    first = np.append(0, np.cumsum(n))
    owner = np.repeat(np.arange(len(size)), n)
    begin = offsets[:-1][owner] + (np.arange(first[-1]) - first[owner]) * hop
    index = begin[:, None] + np.arange(CHUNK)
    inside = index < offsets[1:][owner][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(index, len(data))], np.uint8(0)), first


class Net:
    """Weights, the forward pass, and training by Adam with the max-pool's sparse gradient."""

    def __init__(self, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            "filter": rng.normal(0, 0.3, (WIDTH * EMBED, FILTERS)),
            "fbias": np.zeros(FILTERS),
            "dense": rng.normal(0, 0.3, (FILTERS, HIDDEN)),
            "dbias": np.zeros(HIDDEN),
            "out": rng.normal(0, 0.3, HIDDEN),
            "obias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def tables(self) -> np.ndarray:
        """Response of each filter to each byte at each place of the window: (WIDTH, 256, FILTERS)."""
        return np.stack([self.p["embed"] @ self.p["filter"][k * EMBED : (k + 1) * EMBED] for k in range(WIDTH)])

    def pooled(self, chunks: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Max-pooled filter responses of each chunk."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for a in range(0, len(chunks), 256):
            part = chunks[a : a + 256]
            total = None
            for k in range(WIDTH):
                piece = tables[k][part[:, k : k + (_STEPS - 1) * STRIDE + 1 : STRIDE]]
                total = piece if total is None else np.add(total, piece, out=total)
            out[a : a + 256] = total.max(axis=1)
        return out + self.p["fbias"]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(np.maximum(pooled, 0).astype(np.float64) @ self.p["dense"] + self.p["dbias"], 0)
        return hidden @ self.p["out"].astype(np.float64) + self.p["obias"][0]

    def fit(self, chunks: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 4e-3, decay: float = 1e-4) -> None:
        rng = np.random.Generator(np.random.PCG64(11))
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        reach, turn = (_STEPS - 1) * STRIDE + 1, 0
        windows = np.arange(0, reach, STRIDE)
        for _ in range(epochs):
            order = rng.permutation(len(chunks))
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                x, y, w = chunks[pick], target[pick], weight[pick]
                tables = self.tables()
                total = sum(tables[k][x[:, k : k + reach : STRIDE]] for k in range(WIDTH))
                spot = total.argmax(axis=1)
                pooled = np.take_along_axis(total, spot[:, None, :], axis=1)[:, 0] + self.p["fbias"]
                act = np.maximum(pooled, 0)
                pre = act @ self.p["dense"] + self.p["dbias"]
                hidden = np.maximum(pre, 0)
                z = hidden @ self.p["out"] + self.p["obias"][0]
                d = (w * (1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
                g = {"out": hidden.T @ d, "obias": np.array([d.sum()], np.float32)}
                dh = np.outer(d, self.p["out"]) * (pre > 0)
                g["dense"], g["dbias"] = act.T @ dh, dh.sum(axis=0)
                dp = (dh @ self.p["dense"].T) * (pooled > 0)
                g["fbias"] = dp.sum(axis=0)
                g["filter"], g["embed"] = np.zeros_like(self.p["filter"]), np.zeros_like(self.p["embed"])
                rows = np.arange(len(x))[:, None]
                for k in range(WIDTH):
                    seen = x[rows, windows[spot] + k]
                    rows_k = slice(k * EMBED, (k + 1) * EMBED)
                    g["filter"][rows_k] = np.einsum("bfe,bf->ef", self.p["embed"][seen], dp, optimize=True)
                    np.add.at(g["embed"], seen.reshape(-1), (dp[:, :, None] * self.p["filter"][rows_k].T[None]).reshape(-1, EMBED))
                turn += 1
                for key, grad in g.items():
                    m, v = moment[key]
                    m += 0.1 * (grad + decay * self.p[key] - m)
                    v += 0.001 * (grad * grad - v)
                    self.p[key] -= (rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-7)).astype(np.float32)

    def scores(self, data: np.ndarray, offsets: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of each text, from all of its chunks; a long text's chunks are made in blocks."""
        out = np.empty(len(offsets) - 1)
        if len(out) == 1 and len(data) > LONG_TEXT:
            hop = CHUNK - OVERLAP
            step = LONG_TEXT // hop * hop
            ends = [(a, min(a + step + OVERLAP, len(data))) for a in range(0, len(data) - OVERLAP, step)]
            blocks = [self._logits_of(data[a:b], np.array([0, b - a]), tables)[0] for a, b in ends]
            mean = np.array([np.concatenate(blocks).mean()])
        else:
            z, first = self._logits_of(data, offsets, tables)
            mean = np.add.reduceat(z, first[:-1]) / np.diff(first) if len(out) else out
        return np.round(1 / (1 + np.exp(-mean)), 9)  # equal texts, equal scores in any slice

    def _logits_of(self, data: np.ndarray, offsets: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chunks, first = chunk_bytes(data, offsets)
        return np.clip(self.logits(self.pooled(chunks, tables)), -30, 30), first


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Net | None:
    """A network fitted to a bounded sample of the labelled rows that are not held out."""
    bound_batches(docs)
    key = labels[id_col].cast("long")
    usable = labels.where(labels[label_col].isNotNull() & key.isNotNull() & ~held_out(key)).select(key.alias("doc_id"), labels[label_col].cast("int").alias("label"))
    one_label = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = one_label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    size = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample's rows
    rows = one.withColumn("size", size).where(F.col("size") <= sample_bytes).select("doc_id", "label", "text").toArrow().combine_chunks()
    if rows.num_rows == 0:
        return None
    rows = rows.sort_by("doc_id")
    chunks, first = chunk_bytes(*utf8(rows.column("text")))
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    target = rows.column("label").to_numpy().astype(np.float32)
    net = Net()
    net.fit(chunks, target[owner], (len(owner) / len(n) / n).astype(np.float32)[owner])
    return net


def _scores(net: Net | None, column: pa.Array, tables: np.ndarray | None) -> np.ndarray:
    return net.scores(*utf8(column), tables) if net else np.full(len(column), 0.5)


def _score(net: Net | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(net, part.column("text"), tables))], ["doc_id", "score"])

    return run


def _filter(net: Net | None, text_col: str, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for part in slices(batches, text_col):
            yield part.filter(pa.array(_scores(net, part.column(text_col), tables) >= threshold))

    return run


def score_texts(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    bound_batches(docs)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_score(net), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score the threshold or more, all columns kept."""
    bound_batches(docs)
    net = train(docs, labels, id_col, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_filter(net, text_col, threshold), schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
