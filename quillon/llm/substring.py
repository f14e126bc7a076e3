"""Operator 9: substring deduplication by minimizer segments and window counts.

This stands in place of relative Lempel-Ziv factoring: no reference text is read and
no match is extended. Every text is cut into factors, its minimizer segments: a factor
is the longest run of consecutive ``window``-word windows that share one anchor (the
word q-gram of least hash inside the window, the leftmost on ties). Equal windows
have equal anchors, so the anchor names the one reference block, out of all
blocks of the corpus, in which an equal window can occur: looking a factor up in
its own block is looking it up in every indexed block.

1. Each factor goes to its block with a digest of its whole word run. Blocks are
   counted with map-side combining; anchors that occur once are dropped there.
2. A block in which all factors are equal settles them: all their windows repeat.
3. In the other blocks the factor boundaries are checked: one representative of
   each distinct factor gets the hashes of its windows, weighted by how often the
   factor occurs; windows of total weight two or more repeat.
4. Repeating windows go back to their texts as (position, bit mask) and the words
   they cover are removed.

Factors, not windows, are what is shuffled: about one row for 15 words. Groups of
copies are counted before the shuffle; joins are on hashes, so that AQE can split
a hot block; nothing is collected. Windows and factors are compared inside their
block alone, so two of them count as equal when two independent 64-bit hashes agree,
the anchor's and their own.

Texts of more than ``LONG_TEXT`` bytes are read in parts that overlap by a window.

Defined cases: a null or empty text has no words, removes none, and keeps the
empty text; rows with equal doc_id are separate texts; equal
texts of at least ``window`` words lose all of them; texts shorter than the
window are kept whole; extra input columns are ignored; an empty table gives an
empty result. The steps run when the function is called.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.scratch import Scratch
from quillon.llm.session import bound_batches
from quillon.llm.textkernel import SLICE_BYTES, Words, mix, parts_of, signed, slices, utf8

WINDOW, ANCHOR = 35, 6
LONG_TEXT = 8 * SLICE_BYTES


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text): th tells apart rows that share an id."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def factors(words: Words, window: int, anchor: int) -> dict[str, np.ndarray]:
    """The greedy parse of a slice: row, first window, number of windows, block, digest."""
    runs = words.runs()
    span = window - anchor + 1
    grams = runs.windows(anchor)
    n_windows = np.maximum(words.counts() - window + 1, 0)
    if len(grams) < span or not n_windows.any():
        none = np.zeros(0, np.int64)
        return {"row": none, "first": none, "n": none, "block": none, "digest": none, "at": none}
    best = sliding_window_view(grams, span).argmin(axis=1)
    row = np.repeat(np.arange(len(n_windows)), n_windows)
    local = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    start = words.rows[:-1][row] + local
    spot = start + best[start]
    new = np.ones(len(row), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(row)))
    run = start[head]
    digest = runs.spans(run, run + n + window - 1)
    digest = mix(digest ^ ((spot[head] - run).astype(np.uint64) << np.uint64(8)) ^ n.astype(np.uint64))
    return {"row": row[head], "first": local[head], "n": n, "block": signed(grams[spot[head]]), "digest": signed(digest), "at": run}


def _readable(part: pa.RecordBatch, window: int, limit: int) -> Iterator[tuple[int, Words]]:
    """(first word, words) of a slice; a slice that is one long text comes in parts."""
    column = part.column("text")
    data, _ = utf8(column)
    if part.num_rows == 1 and len(data) > limit:
        for first, own in parts_of(data.tobytes(), limit, window - 1):
            yield first, Words(pa.array([own], pa.large_binary()))
    else:
        yield 0, Words(column)


def _parse(window: int, anchor: int, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for begin, words in _readable(part, window, limit):
                f = factors(words, window, anchor)
                take = pa.array(f["row"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("th").take(take), pa.array((begin + f["first"]).astype(np.int32)), pa.array(f["n"].astype(np.int32)), pa.array(f["block"]), pa.array(f["digest"])],
                    ["doc_id", "th", "first", "n", "block", "digest"],
                )

    return run


def _windows(window: int, limit: int):
    """Window hashes of the representatives; spots: array of (first, n, block, digest, weight)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            spots = part.column("spots")
            owner = np.repeat(np.arange(len(spots)), np.diff(spots.offsets.to_numpy()))
            flat = spots.flatten()
            first, n, block, digest, weight = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("first", "n", "block", "digest", "weight"))
            for start, words in _readable(part, window, limit):
                hashes = words.runs().windows(window)
                at = words.rows[:-1][owner] + first - start
                mine = np.flatnonzero((at >= 0) & (at < len(hashes))) if part.num_rows == 1 else np.arange(len(at))
                size = n[mine]
                delta = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                columns = [pa.array(signed(hashes[np.repeat(at[mine], size) + delta])), *(pa.array(np.repeat(x[mine], size)) for x in (block, digest)), pa.array(delta.astype(np.int32)), pa.array(np.repeat(weight[mine], size))]
                yield pa.RecordBatch.from_arrays(columns, ["wh", "block", "digest", "delta", "weight"])

    return run


def _cut_long(text: bytes, first: np.ndarray, mask: np.ndarray, window: int, limit: int) -> tuple[int, int, bytes]:
    """(words, removed words, kept text) of one long text, read in parts."""
    parts = parts_of(text, limit, 0)
    counts = [len(p.split()) for _, p in parts]
    edge = np.zeros(sum(counts) + window + 1, np.int32)
    for bit in range(window):
        hit = first[(mask >> bit) & 1 == 1] + bit
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
    gone = np.cumsum(edge) > 0
    kept, removed = [], 0
    for (a, own), n in zip(parts, counts, strict=True):
        kept += [w for w, g in zip(own.split(), gone[a : a + n].tolist(), strict=True) if not g]
        removed += int(gone[a : a + n].sum())
    return sum(counts), removed, b" ".join(kept)


def _cut(window: int, limit: int):
    """Removes covered words; marks: array of (first, mask)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            marks = part.column("marks")
            counts = np.diff(marks.offsets.to_numpy())
            owner = np.repeat(np.arange(len(marks)), counts)
            flat = marks.flatten()
            first, mask = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("first", "mask"))
            names = ["doc_id", "n_words", "n_removed", "kept_text"]
            data, _ = utf8(part.column("text"))
            if part.num_rows == 1 and len(data) > limit:
                total, n_gone, kept = _cut_long(data.tobytes(), first, mask, window, limit)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([total], pa.int64()), pa.array([n_gone], pa.int64()), pa.array([kept.decode()], pa.string())], names)
                continue
            words = Words(part.column("text"))
            n_words = words.counts()
            edge = np.zeros(len(words.starts) + 1, np.int64)
            begin = words.rows[:-1][owner] + first
            for bit in range(window):
                hit = begin[(mask >> bit) & 1 == 1] + bit
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.add.reduceat(np.append(gone, False), words.rows[:-1]).astype(np.int64) if len(n_words) else np.zeros(0, np.int64)
            removed[n_words == 0] = 0
            raw, texts = words.data.tobytes(), []
            for i, (a, b) in enumerate(zip(words.rows[:-1], words.rows[1:], strict=True)):
                if removed[i]:
                    keep = np.flatnonzero(~gone[a:b]) + a
                    texts.append(b" ".join([raw[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)]))
                else:  # bytes.split() knows the same six separators
                    texts.append(b" ".join(raw[words.offsets[i] : words.offsets[i + 1]].split()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string())],
                names,
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, long_text: int = LONG_TEXT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row of ``docs``."""
    bound_batches(docs)
    if not 1 <= anchor <= window or window - anchor + 1 > 62:
        raise ValueError("the anchor must fit the window, and at most 62 windows share one")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    texts = _keyed(docs, id_col, text_col)

    parsed = scratch.write("factors", texts.mapInArrow(_parse(window, anchor, long_text), "doc_id long, th long, first int, n int, block long, digest long"))
    counted = parsed.groupBy("block").agg(F.count("*").alias("c"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    blocks = scratch.write("blocks", counted.where("c > 1").select("block", (F.col("lo") != F.col("hi")).alias("mixed")))
    live = scratch.write("live", parsed.join(blocks.hint("shuffle_hash"), "block"))
    del parsed, counted, blocks
    scratch.drop("factors", "blocks")
    scratch.free_shuffles()

    distinct = live.where("mixed").groupBy("block", "digest").agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "th", "first", "n")).alias("rep"))
    spots = distinct.groupBy("rep.doc_id", "rep.th").agg(F.collect_list(F.struct("rep.first", "rep.n", "block", "digest", "weight")).alias("spots"))
    shown = texts.alias("t").join(spots.alias("s"), F.expr("t.doc_id <=> s.doc_id and t.th = s.th")).select("t.text", "s.spots")
    windows = scratch.write("windows", shown.mapInArrow(_windows(window, long_text), "wh long, block long, digest long, delta int, weight long"))
    again = windows.groupBy("wh", "block").agg(F.sum("weight").alias("w")).where("w > 1").select("wh", "block")
    repeated = windows.join(again.hint("shuffle_hash"), ["wh", "block"])
    masks = scratch.write("masks", repeated.groupBy("block", "digest").agg(F.expr("bit_or(shiftleft(1L, delta))").alias("mask")))

    settled = live.where("not mixed").select("doc_id", "th", "first", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    checked = live.where("mixed").join(masks, ["block", "digest"]).select("doc_id", "th", "first", "mask")
    marks = scratch.write("marks", settled.unionByName(checked).groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "mask")).alias("marks")))
    del distinct, spots, shown, windows, again, repeated, masks, settled, checked, live
    scratch.keep("marks")
    scratch.free_shuffles()

    joined = texts.alias("t").join(marks.alias("m"), F.expr("t.doc_id <=> m.doc_id and t.th = m.th"), "left")
    empty = F.expr("cast(array() as array<struct<first:int,mask:bigint>>)")
    ready = joined.select("t.doc_id", "t.text", F.coalesce("m.marks", empty).alias("marks"))
    return ready.mapInArrow(_cut(window, long_text), "doc_id long, n_words long, n_removed long, kept_text string")


def op9_substring(spark, sf_dir: str) -> DataFrame:
    """Repeated 35-word windows removed from every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
