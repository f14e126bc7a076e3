"""Operator 1: SentencePiece encoding and decoding by suffix-array matching.

The model file is parsed here; its byte-pair merges are applied to whole texts with
results equal to the library's. Texts are cut before spaces that follow other
characters (no piece spans such a place, which is checked when the model is read),
and the distinct new chunks of a slice are concatenated and indexed: a suffix array
over the first ``longest piece`` characters, in which every piece is binary-searched
for its range of occurrences. The occurrences are edges from start to end; they are
sorted by chunk, score and position, and relaxed: in every round each chunk takes its
best edge that joins exactly two of its symbols. (A byte-pair model has no additive
path scores, so its edges are relaxed in score order, not along shortest paths.)
Chunks of more than ``LONG`` characters use a heap over the same edges.

Encoded chunks are kept between slices by their bytes, in a table of bounded size;
inside a slice chunks are grouped by hash and then compared byte by byte. Texts of more
than ``SLICE`` bytes are encoded in runs of whole chunks. A chunk is never cut, so memory
grows with the longest run of characters without a space (about 300 bytes a character).

Defined cases: null and empty texts encode to no ids and decode to the empty text;
characters outside the vocabulary become their bytes; ids of control pieces decode to
nothing, ids outside the vocabulary raise; a literal U+2581 decodes to a space, as in
the library; repeated rows get equal ids; extra columns are kept, and one that has the
result's name is replaced.
"""

from __future__ import annotations

import heapq
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.session import bound_batches
from quillon.llm.textkernel import run_hashes, slices, utf8

#: Where the tokenizer's model file is; the environment may name another.
MODEL = os.environ.get("QUILLON_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SLICE, LONG, KEPT = 1 << 20, 128, 200_000
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces of a byte-pair model with identity normalisation, ready for matching."""

    def __init__(self, raw: bytes):
        self.pieces, scores, kinds = [], [], []
        self.prefix, squeeze, model_type = True, True, 1
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("only identity normalisation")
        self.kinds = np.array(kinds)
        if model_type != 2 or squeeze or USER in kinds:
            raise ValueError("only byte-pair models that keep white space and have no user symbols")
        self.byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        if any(MARK in p[1:] and p.lstrip(MARK).find(MARK) >= 0 for p in (self.pieces[i] for i in normal)):
            raise ValueError("a piece spans the start of a word")
        letters = sorted({ord(c) for i in normal for c in self.pieces[i]})
        self.rank = np.zeros(0x110001, np.uint16)
        self.rank[letters] = np.arange(1, len(letters) + 1)
        self.char_id = np.full(len(letters) + 1, -1, np.int64)
        for i in normal:
            if len(self.pieces[i]) == 1:
                self.char_id[self.rank[ord(self.pieces[i])]] = i
        long = sorted((i for i in normal if len(self.pieces[i]) > 1), key=lambda i: (-scores[i], i))
        self.long_ids = np.array(long)
        order = {s: k for k, s in enumerate(sorted({-scores[i] for i in long}))}
        self.grade = np.array([order[-scores[i]] for i in long], np.int64)
        self.long_size = np.array([len(self.pieces[i]) for i in long])
        self.codes = np.zeros((len(long), int(self.long_size.max())), np.int64)
        for k, i in enumerate(long):
            self.codes[k, : len(self.pieces[i])] = self.rank[[ord(c) for c in self.pieces[i]]]
        body = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.body = np.frombuffer(b"".join(body), np.uint8)
        self.body_size = np.array([len(b) for b in body], np.int64)
        self.body_at = np.cumsum(self.body_size) - self.body_size
        self.spaced = np.array([p.startswith(MARK) for p in self.pieces])

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece number) of every occurrence of every piece of two characters or more."""
        n, longest = len(codes), self.codes.shape[1]
        present = np.bincount(codes, minlength=len(self.char_id)) > 0
        present[0] = False
        able = np.flatnonzero((present[self.codes] | (self.codes == 0)).all(axis=1))
        local = np.cumsum(present) * present  # the slice's own ranks: few bits a character, few keys a suffix
        bits = int(present.sum() + 1).bit_length()
        per_key = 63 // bits
        keys = -(-longest // per_key)

        def pack(table: np.ndarray) -> np.ndarray:
            wide = np.zeros((len(table), keys * per_key), np.int64)
            wide[:, :longest] = table
            out = np.zeros((len(table), keys), np.int64)
            for i in range(per_key):
                out = (out << bits) | wide[:, i::per_key]
            return out

        patterns = local[self.codes[able]]
        free = np.arange(longest)[None, :] >= self.long_size[able][:, None]
        low, high = pack(patterns), pack(np.where(free, (1 << bits) - 1, patterns))
        high[:, -1] |= (1 << (bits * (keys * per_key - longest))) - 1
        wide = np.zeros(n + keys * per_key, np.int64)
        wide[:n] = local[codes]
        first = np.zeros(n + (keys - 1) * per_key + 1, np.int64)
        for i in range(per_key):
            first = (first << bits) | wide[i : i + len(first)]
        suffixes = np.lexsort([first[k * per_key : k * per_key + n] for k in range(keys - 1, -1, -1)])
        columns = [first[suffixes + k * per_key] for k in range(keys)]

        def bound(pattern: np.ndarray, after_equal: bool) -> np.ndarray:
            lo, hi = np.zeros(len(pattern), np.int64), np.full(len(pattern), n, np.int64)
            for _ in range(max(n, 1).bit_length()):
                mid = (lo + hi) >> 1
                at = np.minimum(mid, n - 1)
                less, equal = np.zeros(len(pattern), bool), np.ones(len(pattern), bool)
                for k in range(keys):
                    value = columns[k][at]
                    less |= equal & (value < pattern[:, k])
                    equal &= value == pattern[:, k]
                go = (less | equal if after_equal else less) & (mid < hi)
                lo, hi = np.where(go, mid + 1, lo), np.where(go, hi, np.minimum(mid, hi))
            return lo

        begin, end = bound(low, False), bound(high, True)
        count = np.maximum(end - begin, 0)
        total = int(count.sum())
        step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        return suffixes[np.repeat(begin, count) + step], np.repeat(able, count)

    def _heap(self, size: int, starts: list[int], ends: list[int], grades: list[int], numbers: list[int]) -> list[tuple[int, int, int]]:
        """Merged symbols (start, end, piece number) of one long chunk."""
        known: dict[int, dict[int, tuple[int, int]]] = {}
        for s, e, g, p in zip(starts, ends, grades, numbers, strict=True):
            known.setdefault(s, {})[e] = (g, p)
        end, left, made = list(range(1, size + 1)), [i - 1 for i in range(size + 1)], {}
        queue: list[tuple[int, int, int, int]] = []

        def offer(s: int) -> None:
            mid = end[s]
            if mid < size and (hit := known.get(s, {}).get(end[mid])):
                heapq.heappush(queue, (hit[0], s, mid, end[mid]))

        for i in range(size - 1):
            offer(i)
        while queue:
            _, s, mid, e = heapq.heappop(queue)
            if end[s] != mid or mid >= size or end[mid] != e or left[mid] != s:
                continue
            end[s], end[mid] = e, -1
            left[e] = s
            made[s] = (e, known[s][e][1])
            if s > 0:
                offer(left[s])
            offer(s)
        return [(s, e, p) for s, (e, p) in made.items() if end[s] == e]

    def encode_chunks(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each chunk; chunks hold the mark for spaces."""
        joined = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(c) for c in chunks], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        codes = self.rank[joined].astype(np.int64)
        gaps = begin + sizes
        codes[gaps] = 0
        start, number = self.edges(codes)
        end, grade = start + self.long_size[number], self.grade[number]
        owner = np.repeat(np.arange(len(chunks)), sizes + 1)[start]
        symbol = np.full(len(codes) + 1, -1, np.int64)
        symbol[: len(codes)] = self.char_id[codes]
        edge = np.ones(len(codes) + 1, bool)
        after = np.arange(1, len(codes) + 2)

        big = sizes[owner] > LONG
        for c in np.flatnonzero(sizes > LONG):
            mine = np.flatnonzero(big & (owner == c))
            for s, e, p in self._heap(int(sizes[c]), (start[mine] - begin[c]).tolist(), (end[mine] - begin[c]).tolist(), grade[mine].tolist(), number[mine].tolist()):
                a, b = s + begin[c], e + begin[c]
                edge[a + 1 : b] = False
                after[a], symbol[a] = b, self.long_ids[p]
        if big.any():
            start, end, owner, number, grade = (x[~big] for x in (start, end, owner, number, grade))
        grades, places = int(self.grade[-1] + 1).bit_length(), len(codes).bit_length()
        if len(chunks).bit_length() + grades + places <= 62:
            order = np.argsort((owner << (grades + places)) | (grade << places) | start)
        else:
            order = np.lexsort((start, grade, owner))
        start, end, owner, number = (x[order] for x in (start, end, owner, number))
        while len(start):
            live = np.flatnonzero(after[np.minimum(after[start], len(codes))] == end)
            if not len(live):
                break
            best = live[np.append(True, owner[live][1:] != owner[live][:-1])]
            s, e = start[best], end[best]
            edge[after[s]] = False
            after[s], symbol[s] = e, self.long_ids[number[best]]
            busy = np.zeros(len(chunks), bool)
            busy[owner[best]] = True
            keep = busy[owner] & edge[start] & edge[end] & (after[start] < end)
            start, end, owner, number = start[keep], end[keep], owner[keep], number[keep]

        edge[gaps] = False
        head = np.flatnonzero(edge[:-1])
        ids = symbol[head]
        unknown = ids < 0
        width = np.ones(len(head), np.int64)
        if unknown.any():
            raw = [chr(c).encode() for c in joined[head[unknown]].tolist()]
            width[unknown] = [len(r) for r in raw]
            ids = np.repeat(ids, width)
            ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        places = np.append(0, np.cumsum(width))
        cuts = places[np.searchsorted(head, begin)]
        flat, cuts = ids.astype(np.int32), [*cuts.tolist(), len(ids)]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _distinct(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(an example of each distinct chunk, each chunk's number): equal hashes and sizes, then equal bytes.

        The hash of one size maps up to eight bytes one to one, so only longer chunks are compared.
        """
        _, example, inside = np.unique(run_hashes(data, begin, end), return_index=True, return_inverse=True)
        size, first = end - begin, example[inside]
        long = np.flatnonzero(size > 8)
        n = size[long]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        own, other = (data[np.repeat(x, n) + step] for x in (begin[long], begin[first[long]]))
        if (size == size[first]).all() and (own == other).all():
            return example, inside
        raw, numbers = data.tobytes(), {}  # two chunks share a hash
        inside = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
        return np.unique(inside, return_index=True)[1], inside

    def _run(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, kept: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids before each chunk) of chunks that follow each other."""
        example, inside = self._distinct(data, begin, end)
        raw, low = data[begin[0] : end[-1]].tobytes(), int(begin[0])
        known = [raw[a - low : b - low] for a, b in zip(begin[example].tolist(), end[example].tolist(), strict=True)]
        if len(kept) > KEPT:
            kept.clear()
        new = [name for name in known if name not in kept]
        if new:
            kept.update(zip(new, self.encode_chunks([name.decode().replace(" ", MARK) for name in new]), strict=True))
        parts = [kept[name] for name in known]
        size = np.array([len(p) for p in parts], np.int64)
        flat, at = np.concatenate(parts), np.cumsum(size) - size
        n = size[inside]
        total = int(n.sum())
        step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        return flat[np.repeat(at[inside], n) + step], np.append(0, np.cumsum(n))

    def encode(self, column: pa.Array, kept: dict[bytes, np.ndarray], limit: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets) of a slice of texts."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if self.prefix:
            led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string()))
            column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, led)
        data, offsets = utf8(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        space = data == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(data))
        cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(data), 2 * limit)), len(begin)))
        runs = [self._run(data, begin[a:b], end[a:b], kept) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        total = np.append(0, np.cumsum([len(ids) for ids, _ in runs]))
        bounds = np.append(np.concatenate([at[:-1] + before for (_, at), before in zip(runs, total)]), total[-1])
        return np.concatenate([ids for ids, _ in runs]), bounds[np.searchsorted(begin, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of a slice of id lists."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id outside the vocabulary")
        size = self.body_size[ids]
        total = int(size.sum())
        step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        raw = self.body[np.repeat(self.body_at[ids], size) + step].tobytes()
        at = np.append(0, np.cumsum(size))[offsets].tolist()
        texts = []
        for i in range(len(offsets) - 1):
            text = raw[at[i] : at[i + 1]].decode(errors="replace")
            lead = self.prefix and offsets[i] < offsets[i + 1] and self.spaced[ids[offsets[i]]]
            texts.append(text[1:] if lead else text)
        return texts


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _added(rows: DataFrame, name: str, kind: str) -> tuple[list[str], str]:
    """The columns that stay beside a new one, and the schema with it."""
    fields = [f for f in rows.schema if f.name != name]
    return [f.name for f in fields], ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` {kind}"])


def encode(rows: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``rows`` with the ids of each whole text; the model's bytes are sent to the executors."""
    bound_batches(rows)
    held = rows.sparkSession.sparkContext.broadcast(model)
    stay, schema = _added(rows, ids_col, "array<int>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = Model(held.value), {}
        for part in slices(batches, text_col, SLICE):
            ids, offsets = own.encode(part.column(text_col), kept)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in stay), lists], [*stay, ids_col])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of each list of ids."""
    bound_batches(rows)
    held = rows.sparkSession.sparkContext.broadcast(model)
    stay, schema = _added(rows, text_col, "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(held.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lists = pc.fill_null(part.column(ids_col), pa.scalar([], part.column(ids_col).type))
                texts = own.decode(lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in stay), pa.array(texts, pa.string())], [*stay, text_col])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_hash, decoded_sha256, exact): the ids, and what they decode to."""
    coded = encode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model)
    brief = coded.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "ids")
    back = decode(brief, model)
    done = back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), "text_sha256")
    return done.select("doc_id", "n_tokens", "ids", "ids_hash", "decoded_sha256", (F.col("decoded_sha256") == F.col("text_sha256")).alias("exact"))


def op1_pieces(spark, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    """Every whole text encoded, and decoded again."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_model(model_path))
