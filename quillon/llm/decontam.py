"""Operator 3: benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are normalised (lower case, runs of characters that are
neither letters nor digits become one space). An occurrence of an item of m
characters with at most k edits shares at least m + 1 - q - k * q q-grams with it, on
diagonals that lie within k of each other. Shared q-grams are counted in overlapping
diagonal bands of 2 * (k + 1) diagonals; bands that meet the bound are verified by a
banded alignment of the whole item against the band's region.

The budget k is ``edit_rate`` of the item's length, lowered for short items so that
the bound stays positive. Items of fewer than q characters have no q-gram; they match
where they stand unchanged between word edges (next to a character of U+2E80 or above,
which are written without spaces, every place is an edge).

Counting makes no pair of equal grams by itself: a gram that an item repeats densely is
one interval of places, and pairs are counted in blocks of ``PAIRS``, so a periodic text
or a stem that many items share costs bounded memory.

The benchmark is read in hashed blocks of ``block_chars`` characters. The driver holds
at most two of them (one in use, the next one) and executors one, so what is held of
it at once is bounded. A benchmark of one block, the usual case, is
searched in one scan of the documents; each further block costs one more. (Grams of
texts are not shuffled to meet grams of items: in prose a large part of all places hold
a gram of some item.)

Defined cases: null and empty texts or items match nothing; an item that occurs
several times gives a row for each separate region; a null item id counts as -1;
repeated rows give repeated results; extra columns are ignored, or kept by
``drop_leaks``, which also drops leaking rows without an id; an empty benchmark or table
gives no rows. Texts take about 20 bytes a character while they are searched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.scratch import Scratch
from quillon.llm.session import bound_batches
from quillon.llm.textkernel import mix, slices

Q, EDIT_RATE, BLOCK_CHARS = 10, 0.08, 4_000_000
PAIRS, GRAM_BLOCK, DENSE = 1 << 20, 1 << 20, 16
_WIDE_SCRIPTS = 0x2E80
_BASE = 0x9E3779B97F4A7C15
_BITS = 22
_COVER = 0x3000
SPACE_CODE = 32


def _code_table() -> np.ndarray:
    """Normalised code point of each character below U+3000, from Python's own rules."""
    out = np.empty(_COVER, np.uint32)
    for i in range(_COVER):
        c = chr(i)
        low = c.lower()
        out[i] = SPACE_CODE if not c.isalnum() else ord(low) if len(low) == 1 else i
    out[0] = 0
    return out


_CODES = _code_table()


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, a 0 after each, and each code's place in the joined texts."""
    joined = np.frombuffer(("\0".join(t.replace("\0", " ") for t in texts) + "\0").encode("utf-32-le"), np.uint32)
    codes = joined.copy()
    known = codes < _COVER
    if known.all():
        codes = _CODES[codes]
    else:
        codes[known] = _CODES[codes[known]]
    space = codes == SPACE_CODE
    edge = space | (codes == 0)
    keep = ~space
    keep[1:] |= ~edge[:-1]
    keep[0] = not space[0]
    place = np.flatnonzero(keep)
    return codes[place], place


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q codes from each place on, by doubling; grams over a 0 are the caller's to drop."""
    have, width, done, out = codes.astype(np.uint64), 1, 0, None
    left = q
    while left:
        if left & 1:
            piece = have[done:]
            factor = np.uint64(pow(_BASE, width, 2**64))
            out = piece if out is None else out[: len(piece)] * factor + piece[: len(out)]
            done += width
        left >>= 1
        if left:
            n = max(len(have) - width, 0)
            have = have[:n] * np.uint64(pow(_BASE, width, 2**64)) + have[width : width + n]
            width *= 2
    n = len(codes) - q + 1
    return mix(out[: max(n, 0)]) if out is not None else np.zeros(0, np.uint64)


class Index:
    """q-grams of a block of items and where they are; shorter items by their length."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edit_rate: float = EDIT_RATE):
        self.q = q
        self.ids, self.codes, budgets, hashes, owner, spot, short = [], [], [], [], [], [], {}
        for item_id, text in items:
            codes = normalise([text or ""])[0][:-1]
            codes = codes[:-1] if len(codes) and codes[-1] == SPACE_CODE else codes
            if not len(codes):
                continue
            if len(codes) < q:
                short.setdefault(len(codes), []).append(len(self.ids))
                budgets.append(0)
            else:
                budgets.append(min(int(edit_rate * len(codes)), (len(codes) - q) // q))
                h = gram_hashes(codes, q)
                hashes.append(h)
                owner.append(np.full(len(h), len(self.ids), np.int32))
                spot.append(np.arange(len(h), dtype=np.int32))
            self.ids.append(item_id)
            self.codes.append(codes)
        self.short = {}
        for size, numbers in short.items():
            h = np.concatenate([gram_hashes(self.codes[i], size) for i in numbers])
            order = np.argsort(h, kind="stable")
            self.short[size] = (h[order], np.array(numbers)[order])
        self.budget = np.array(budgets, np.int64)
        self.lengths = np.array([len(c) for c in self.codes], np.int64)
        self.shift = 1 << int(self.lengths.max(initial=1)).bit_length()  # keeps diagonals positive
        self.bound = self.lengths + 1 - q - self.budget * q
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self._post(flat, np.concatenate(owner) if owner else np.zeros(0, np.int32), np.concatenate(spot) if spot else np.zeros(0, np.int32))
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _post(self, flat: np.ndarray, owner: np.ndarray, spot: np.ndarray) -> None:
        """Postings (item, first place, last place) by gram; an item's dense places of a gram are one posting."""
        order = np.lexsort((spot, owner, flat))
        flat, owner, spot = flat[order], owner[order], spot[order]
        head = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]))) if len(flat) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(flat)))
        low, high = spot[head], spot[head + size - 1]
        dense = np.repeat((size > 4) & (high - low < DENSE * size), size)
        start = np.zeros(len(flat), bool)
        start[head] = True
        keep = start | ~dense
        last = np.where(dense, np.repeat(high, size), spot)
        flat, self.owner, self.low, self.high = flat[keep], owner[keep], spot[keep], last[keep]
        self.grams, self.first = np.unique(flat, return_index=True)
        self.count = np.diff(np.append(self.first, len(flat)))


def _hits(index: Index, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram number) of all grams of the texts that some item has."""
    places, slots = [], []
    for a in range(0, len(codes), GRAM_BLOCK):
        h = gram_hashes(codes[a : a + GRAM_BLOCK + index.q - 1], index.q)
        at = np.flatnonzero(index.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(index.grams, h[at]), len(index.grams) - 1)
        same = index.grams[slot] == h[at]
        places.append(at[same] + a)
        slots.append(slot[same])
    return np.concatenate(places), np.concatenate(slots)


def band_counts(index: Index, hit: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item << 40 | band, shared grams or more) of all bands of the hits; bands are budget + 1 diagonals wide."""
    size = index.count[slot]
    ends = np.cumsum(size)
    keys, counts, begin = [], [], 0
    while begin < len(hit):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        n = size[begin:stop]
        at = np.repeat(index.first[slot[begin:stop]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item = index.owner[at].astype(np.int64)
        width = index.budget[item] + 1
        place = np.repeat(hit[begin:stop], n) + index.shift
        low, high = place - index.high[at], place - index.low[at]
        bands = high // width - low // width + 1
        step = np.arange(int(bands.sum())) - np.repeat(np.cumsum(bands) - bands, bands)
        band = np.repeat(low // width, bands) + step
        wide = np.repeat(width, bands)
        share = np.minimum(np.repeat(high, bands) + 1, (band + 1) * wide) - np.maximum(np.repeat(low, bands), band * wide)
        own, where = np.unique((np.repeat(item, bands) << 40) | band, return_inverse=True)
        keys.append(own)
        counts.append(np.bincount(where, weights=share).astype(np.int64))
        begin = stop
        if begin >= len(hit) or sum(map(len, keys)) > 4 * PAIRS:
            own, where = np.unique(np.concatenate(keys), return_inverse=True)
            keys, counts = [own], [np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)]
    return keys[0], counts[0]


def _search_short(index: Index, codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, item number) of the unchanged short items between word edges."""
    if not index.short:
        return []
    loose = (codes == 0) | (codes == SPACE_CODE) | (codes >= _WIDE_SCRIPTS)
    edge = np.ones(len(codes) + 1, bool)
    edge[1:-1] = loose[1:] | loose[:-1]
    out = []
    for size, (hashes, numbers) in index.short.items():
        h = gram_hashes(codes, size)
        able = np.flatnonzero(edge[: len(h)] & edge[size : size + len(h)])
        low, high = np.searchsorted(hashes, h[able]), np.searchsorted(hashes, h[able], side="right")
        for a, x, y in zip(able[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            out += [(a, a + size, int(i)) for i in numbers[x:y] if (codes[a : a + size] == index.codes[i]).all()]
    return out


def align(item: np.ndarray, region: np.ndarray, budget: int, first: int, width: int) -> tuple[int, int, int] | None:
    """(distance, start, stop) of the item's best occurrence in the region, None if over the budget.

    Only the diagonals from ``first`` to ``first + width`` are filled; a place of the
    band stands for the column (row + first + place) of the region.
    """
    m, n, never = len(item), len(region), len(item) + budget + 1
    places = np.arange(width + 1)
    column = places + first
    line = np.zeros(m + width + 1, region.dtype)  # 0 differs from every code of an item
    a, b = max(-first, 0), min(len(line), n - first)
    if a < b:
        line[a:b] = region[first + a : first + b]
    cost, start = np.where((column >= 0) & (column <= n), 0, never), column
    for i, code in enumerate(item, 1):
        swap = cost + (line[i - 1 : i + width] != code)
        drop = np.append(cost[1:] + 1, never)
        take = swap <= drop
        step = np.where(take, swap, drop)
        origin = np.where(take, start, np.append(start[1:], 0))
        slack = step - places
        best = np.minimum.accumulate(slack)
        cost = best + places
        cost[max(n - first - i + 1, 0) :] = never
        start = origin[np.maximum.accumulate(np.where(slack == best, places, 0))]
        if cost.min() > budget:
            return None
    stop = int(cost.argmin())
    return (int(cost[stop]), int(start[stop]), stop + first + m) if cost[stop] <= budget else None


def search(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, start, stop, distance) of all regions; places count code points."""
    if not index.ids or not texts:
        return []
    codes, place = normalise(texts)
    ends = np.flatnonzero(codes == 0)
    starts = np.append(0, ends[:-1] + 1)
    joined_start = np.append(0, place[ends[:-1]] + 1)
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for a, b, i in _search_short(index, codes):
        out.setdefault((int(np.searchsorted(ends, a)), i), []).append((a, b, 0))
    for d, i, *region in _search_grams(index, codes, starts, ends):
        out.setdefault((d, i), []).append(tuple(region))
    rows = []
    for (d, i), regions in sorted(out.items()):
        regions.sort(key=lambda r: (r[2], r[0]))
        chosen: list[tuple[int, int, int]] = []
        for a, b, dist in regions:
            if all(b <= x or a >= y for x, y, _ in chosen):
                chosen.append((a, b, dist))
        rows += [(d, i, int(place[a] - joined_start[d]), int(place[b - 1] + 1 - joined_start[d]), dist) for a, b, dist in sorted(chosen)]
    return rows


def _search_grams(index: Index, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item number, start, stop, distance) of the verified bands; places count codes."""
    if not len(index.grams):
        return
    hit, slot = _hits(index, codes)
    if not len(hit):
        return
    keys, counts = band_counts(index, hit, slot)
    follows = np.append(np.where(np.diff(keys) == 1, counts[1:], 0), 0)
    leads = np.append(0, np.where(np.diff(keys) == 1, counts[:-1], 0))
    owner = keys >> 40
    for k in np.flatnonzero(np.maximum(counts + follows, counts + leads) >= index.bound[owner]):
        i = int(owner[k])
        budget, m, w = int(index.budget[i]), int(index.lengths[i]), int(index.budget[i]) + 1
        lo = (int(keys[k]) & ((1 << 40) - 1)) * w - index.shift - w - budget
        hi = lo + 3 * w + 2 * budget + m
        doc = int(np.searchsorted(ends, max(min((lo + hi) // 2, len(codes) - 1), 0)))
        for d in {doc, max(doc - 1, 0), min(doc + 1, len(ends) - 1)}:
            a, b = max(lo, int(starts[d])), min(hi, int(ends[d]))
            if b - a < m - budget:
                continue
            found = align(index.codes[i], codes[a:b], budget, lo - a, 3 * w + 2 * budget)
            if found:
                yield d, i, a + found[1], a + found[2], found[0]


def _search_batches(index: Index):
    names = ["doc_id", "item_id", "start", "stop", "distance"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            rows = search(index, [t or "" for t in part.column("text").to_pylist()])
            ids = part.column("doc_id")
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            arrays = [ids.take(pa.array(cols[0], pa.int64())), pa.array([index.ids[i] for i in cols[1]], pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, pa.int64()) for c in cols[2:])], names)

    return run


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in hashed blocks of bounded text, each read when it is asked for; none for an empty benchmark."""
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("long"), F.lit(-1)).alias("item_id"), benchmark["text"].alias("text")).where("length(text) > 0")
    size = items.agg(F.coalesce(F.sum(F.char_length("text") + 32), F.lit(0))).first()[0]
    blocks = -(-int(size) // block_chars)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield sorted((r.item_id, r.text) for r in part.toLocalIterator())


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, stop, distance) of every benchmark passage in ``docs``.

    With several blocks the rows found are written block by block when the function is called.
    """
    bound_batches(docs)
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, stop long, distance long"
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    blocks = _blocks(benchmark, block_chars)
    rows, after = next(blocks, None), None
    if rows is None:
        return spark.createDataFrame([], schema)
    scratch, number, found = Scratch(spark, "decontam"), 0, None
    while True:
        after = next(blocks, None)
        held = spark.sparkContext.broadcast(rows)
        part = texts.mapInArrow(_lazy(held, q, edit_rate), schema)
        if number == 0 and after is None:
            return part
        part = scratch.write(f"block{number}", part)
        held.destroy()
        found = part if found is None else found.unionByName(part)
        if after is None:
            return found
        rows, number = after, number + 1


def _lazy(rows, q: int, edit_rate: float):
    def run(batches):
        yield from _search_batches(Index(rows.value, q, edit_rate))(batches)

    return run


def _clean(rows, text_col: str, q: int, edit_rate: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rows.value, q, edit_rate)
        for part in slices(batches, text_col):
            keep = np.ones(part.num_rows, bool)
            keep[[d for d, *_ in search(index, [t or "" for t in part.column(text_col).to_pylist()])]] = False
            yield part.filter(pa.array(keep))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark passage was found, without a shuffle.

    With several blocks the rows left are written block by block when the function is called.
    """
    bound_batches(docs)
    spark = docs.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    blocks = _blocks(benchmark, block_chars)
    rows, scratch, number = next(blocks, None), Scratch(spark, "decontam"), 0
    while rows is not None:
        after = next(blocks, None)
        held = spark.sparkContext.broadcast(rows)
        docs = docs.mapInArrow(_clean(held, text_col, q, edit_rate), schema)
        if number or after is not None:
            docs = scratch.write(f"left{number}", docs)
            scratch.keep(f"left{number}")
            held.destroy()
        rows, number = after, number + 1
    return docs


def op3_decontam(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
