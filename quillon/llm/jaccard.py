"""Operator 8: n-gram Jaccard join with PartEnum signatures.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Two sets of a
and b elements with Jaccard similarity num / den or more differ in at most
k = (den - num) * (a + b) / (den + num) elements. The hash domain of a size level (sets
of at most s elements, s = 64 * 4**j) is cut into s / 4 groups of two parts, and the
one-part subsets of a group are enumerated: a group that holds at most one differing
element gives both sets the same signature. Levels follow the larger set, so a set whose
partners may reach the next level is signed for both. Sets of at most 64 shingles sign
each shingle by itself as well.

How many parts a set signs follows from its size, and no similar pair is missed. A
differing element spoils one part. A set signs its parts in use, in order, until more
than k + r of them, where r is ``SPARE`` and a sixteenth of its size: of the parts that a
similar pair shares, both then sign the first r + 1, as at most k spoiled ones come
before them in either set. A set may therefore leave out its r hottest signatures
(prefix filtering by bucket size; fewer where it has few parts in use), so a passage that
many texts share makes no pairs of texts in which it is a small part. Of single-shingle
signatures all but a quarter are left out. A set with no more than k parts in use cannot be signed; that does not occur with hashed
shingles, but such sets are found and compared with all sets of their size.

Equal sets are merged first. Star rounds then compare each set with one hub of its
buckets, which collapses groups of near copies without their pairs; in the last round
the sets of one bucket that are still in different components are compared; in buckets
of more than ``FEW`` sets only pairs pass whose bitmaps are near. Two sets
are compared at all only if bitmaps of their hashes differ in no more bits than similar
sets can (an exact bound). Every comparison counts the shared hashes of two whole
texts, in the compared set's partition, salted where one set has many partners. Rows are
told apart by numbers of their own, so rows may share an id.

Texts of more than ``LONG_TEXT`` bytes are read in overlapping parts; memory grows with
the set (8 bytes a shingle) and its words, not with copies of the text.

Defined cases: null, empty and wordless texts have no shingles and their own id as
component; texts with fewer than five words have one shingle; rows sharing a doc_id
are one document with several texts, linked by each of them; rows with a null doc_id
get a null component; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.graph import connected_components
from quillon.scratch import Scratch
from quillon.llm.session import bound_batches
from quillon.llm.textkernel import SLICE_BYTES, Words, mix, parts_of, signed, slices, utf8

WIDTH, TINY, SPLIT, SPARE, STARS, FEW = 5, 64, 256, 16, 2, 8
NARROW, WIDE, BIG = 16, 128, 400
LONG_TEXT = 8 * SLICE_BYTES
_BASE = "doc_id long, text string, n_shingles long, spare int, d1 long, d2 long"


def _long_set(text: bytes, width: int, limit: int) -> np.ndarray | None:
    """The set of one long text, read in parts; None if it has fewer words than a shingle."""
    grams = [Words(pa.array([part], pa.large_binary()), lower=True).runs().windows(width) for _, part in parts_of(text, limit, width - 1)]
    out = np.unique(np.concatenate(grams))
    return out if len(out) else None


def shingle_sets(column: pa.Array, width: int = WIDTH, limit: int = LONG_TEXT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the rows' offsets into them."""
    if len(column) == 1:
        data, _ = utf8(column)
        if len(data) > limit and (own := _long_set(data.tobytes(), width, limit)) is not None:
            return own, np.array([0, len(own)])
    words = Words(column, lower=True)
    runs = words.runs()
    grams = runs.windows(width)
    counts = words.counts()
    few = np.flatnonzero((counts > 0) & (counts < width))
    whole = dict(zip(few.tolist(), runs.spans(words.rows[few], words.rows[few + 1]).tolist(), strict=True))
    sets = []
    for i, (a, n) in enumerate(zip(words.rows[:-1].tolist(), counts.tolist(), strict=True)):
        if n >= width:
            s = np.sort(grams[a : a + n - width + 1])
            if n > width:
                s = s[np.append(True, s[1:] != s[:-1])]
        else:
            s = np.array([whole[i]] if n else [], np.uint64)
        sets.append(s)
    offsets = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offsets


def level(size: np.ndarray) -> np.ndarray:
    """j of the level of sets of at most 64 * 4**j elements; 0 for all that are not larger than 64."""
    return np.maximum(np.frexp(np.maximum(size, 1) - 0.5)[1] - 5, 0) // 2


def budgets(size: np.ndarray, lv: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most elements in which a set can differ from a similar one of the level, which is not smaller."""
    largest = np.minimum(size * den // num, TINY << (2 * lv))
    return (den - num) * (size + largest) // (den + num)


def reserve(size: np.ndarray) -> np.ndarray:
    """How many signatures beyond its budget a set gives, to leave out as many."""
    return SPARE + size // 16


class Parts:
    """The parts in use of the rows' sets at one level each, their signatures and places among a row's parts."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, levels: np.ndarray):
        row = np.repeat(np.arange(len(levels)), np.diff(offsets))
        use = levels[row] > 0
        row, flat = row[use], flat[use]
        part = flat >> (np.uint64(59) - np.uint64(2) * levels[row].astype(np.uint64))  # a level has s / 2 = 32 * 4**j parts
        head = np.ones(len(row), bool)
        head[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
        head = np.flatnonzero(head)
        self.row = row[head]
        label = part[head] * np.uint64(64) + levels[self.row].astype(np.uint64)
        total = np.add.reduceat(mix(flat), head) if len(head) else flat
        self.signature = mix(total ^ mix(label)) & ~np.uint64(1)
        self.total = np.bincount(self.row, minlength=len(levels))
        self.before = np.arange(len(head)) - (np.cumsum(self.total) - self.total)[self.row]


def _levels(size: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The own level of each set, and the next one where partners may reach it (0: no parts)."""
    own, ahead = level(size), level(size * den // num)
    return [np.where(size > 0, own, 0), np.where((size > 0) & (ahead != own), ahead, 0)]


def spares(flat: np.ndarray, offsets: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures that each set may leave out; -1 where it has too few parts for any guarantee."""
    size = np.diff(offsets)
    out = reserve(size)
    for lv in _levels(size, num, den):
        room = Parts(flat, offsets, lv).total - budgets(size, lv, num, den) - 1
        out = np.where(lv > 0, np.minimum(out, room), out)
    return np.maximum(out, -1)


def signatures(flat: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature): odd ones of single shingles, even ones of parts."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    tiny = size[row] <= TINY
    rows, sigs = [row[tiny]], [mix(flat[tiny] + np.uint64(0x5DEECE66D)) | np.uint64(1)]
    for lv in _levels(size, num, den):
        parts = Parts(flat, offsets, lv)
        take = parts.before <= (budgets(size, lv, num, den) + reserve(size))[parts.row]
        rows.append(parts.row[take])
        sigs.append(parts.signature[take])
    return np.concatenate(rows), np.concatenate(sigs)


def _bitmaps(flat: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """Per row: 64 * words bits, set at the middle bits of each hash."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    spot = ((flat >> np.uint64(20)) & np.uint64(64 * words - 1)).astype(np.int64)
    bits = np.zeros((n, words * 64), bool)
    bits[row, spot] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _lists(rows: np.ndarray, present: np.ndarray) -> pa.Array:
    """The rows as lists, null where not present."""
    at = np.zeros(len(present) + 1, np.int32)
    np.cumsum(np.where(present, rows.shape[1] if rows.ndim == 2 else 0, 0), out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, mask=np.append(~present, False)), pa.array(rows.reshape(-1)))


def _measure(num: int, den: int):
    """Size, digests and spare signatures of each row's set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            flat, offsets = shingle_sets(part.column("text"))
            size = np.diff(offsets)
            one = np.concatenate([flat, np.zeros(1, np.uint64)])
            digests = []
            for salt in (1, 2):
                d = np.add.reduceat(mix(one ^ np.uint64(salt * 0x9E3779B9)), np.minimum(offsets[:-1], len(flat)))
                digests.append(pa.array(signed(mix(d + size.astype(np.uint64)))))
            spare = pa.array(spares(flat, offsets, num, den).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(size), spare, *digests], ["doc_id", "text", "n_shingles", "spare", "d1", "d2"])

    return run


def _sign(num: int, den: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows, sigs = signatures(*shingle_sets(part.column("text")), num, den)
            order = np.lexsort((sigs, rows))
            rows, sigs = rows[order], sigs[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (sigs[1:] != sigs[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(signed(sigs[new])), part.column("id").take(pa.array(rows[new]))], ["sig", "id"])

    return run


def _draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the sets that take part in comparisons."""
    for part in slices(batches, "text"):
        flat, offsets = shingle_sets(part.column("text"))
        size = np.diff(offsets)
        big = size > BIG
        wide = _bitmaps(flat[np.repeat(big, size)], np.append(0, np.cumsum(size[big])), WIDE)
        narrow = _lists(_bitmaps(flat, offsets, NARROW), np.ones(len(size), bool))
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), narrow, _lists(wide, big)], ["id", "n_shingles", "bits", "wide"])


def _compare(num: int, den: int):
    """Rows come sorted by (a, salt, b), the text of ``a`` first (b is null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, np.zeros(0, np.uint64)
        for part in slices(batches, "text"):
            flat, offsets = shingle_sets(part.column("text"))
            got_a, got_b = [], []
            for i, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                s = flat[offsets[i] : offsets[i + 1]]
                if b is None:
                    hub, hub_set = a, s.copy()
                    continue
                assert hub == a, "the text of the compared set comes first"
                if not len(hub_set):
                    continue
                spot = np.minimum(np.searchsorted(hub_set, s), len(hub_set) - 1)
                both = int((hub_set[spot] == s).sum())
                if den * both >= num * (len(s) + len(hub_set) - both):
                    got_a.append(a)
                    got_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(got_a, pa.int64()), pa.array(got_b, pa.int64())], ["src", "dst"])

    return run


def _verify(bodies: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar. Each pair sends one text; a set with many partners is salted."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SPLIT)).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.expr("cast(pmod(xxhash64(b), salts) as int)").alias("salt"), "b", F.col("b").alias("id"))
    hubs = salts.select("a", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("id"))
    rows = bodies.join(members.unionByName(hubs), "id").select("a", "salt", "b", "text")
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_compare(num, den), "src long, dst long")


def _differ(x: str, y: str, num: int, den: int) -> tuple[str, str]:
    """Whether two sets can be similar by their narrow and wide bitmaps, which differ in at most as many bits as the sets in elements."""
    narrow = " + ".join(f"bit_count({x}.bits[{i}] ^ {y}.bits[{i}])" for i in range(NARROW))
    wide = f"aggregate(zip_with({x}.wide, {y}.wide, (p, q) -> bit_count(p ^ q)), 0, (t, v) -> t + v)"
    most = f"{den - num} * ({x}.n_shingles + {y}.n_shingles)"
    return f"{den + num} * ({narrow}) <= {most}", f"{den + num} * {wide} <= {most}"


def _near(x: str, y: str, num: int, den: int) -> str:
    narrow, wide = _differ(x, y, num, den)
    return f"case when not ({narrow}) then false when {x}.wide is null or {y}.wide is null then true else {wide} end"


def _prefixes(live: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, id) without each set's hottest signatures; live: (sig, id, n)."""
    one = F.expr("sig % 2 <> 0")
    rarest = Window.partitionBy("id", one).orderBy(F.desc("n"), "sig")
    ranked = live.join(sets.select("id", "n_shingles", "spare"), "id").withColumn("k", F.row_number().over(rarest))
    single = F.col("k") >= F.ceil(F.col("n_shingles") * F.lit(num) / F.lit(den))
    return ranked.where(F.when(one, single).otherwise(F.col("k") > F.greatest("spare", F.lit(0)))).select("sig", "id")


def _mixed(live: DataFrame) -> DataFrame:
    """The rows (sig, id, c) of buckets that hold sets of different components, with the bucket's size."""
    count = live.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("sig", "n")
    return live.join(count, "sig")


def _stars(mixed: DataFrame, sets: DataFrame, turn: int, near: str) -> DataFrame:
    """One pair for each set: it and the hub that it shares most of its buckets with.

    On even turns a bucket's hub is the set whose buckets are fullest, else a set that changes with the turn.
    """
    score = mixed.groupBy("id").agg(F.sum("n").alias("score"))
    rank = -F.col("score") if turn % 2 == 0 else F.xxhash64("id", F.lit(turn))
    hubs = mixed.join(score, "id").groupBy("sig").agg(F.min(F.struct(rank.alias("rank"), "id", "c")).alias("h")).select("sig", F.col("h.id").alias("hub"), F.col("h.c").alias("hc"))
    shared = mixed.join(hubs.hint("shuffle_hash"), "sig").where("c <> hc").groupBy("id", "hub").agg(F.count("*").alias("n"))
    x, y = sets.alias("x"), sets.alias("y")
    able = shared.join(x, shared.id == F.col("x.id")).join(y, F.col("hub") == F.col("y.id")).where(near).select(F.col("x.id").alias("id"), "hub", "n")
    best = able.groupBy("id").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    return best.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _pairs(mixed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a < b) of sets in one bucket and in different components; bitmaps go through the hot buckets alone."""
    slim = mixed.where(F.col("n") <= FEW).select("sig", "id", "c")
    hot = mixed.where(F.col("n") > FEW).select("sig", "id", "c").join(sets.select("id", "n_shingles", "bits"), "id")
    other = "x.sig = y.sig and x.id < y.id and x.c <> y.c"
    few = slim.alias("x").join(slim.alias("y"), F.expr(other))
    many = hot.alias("x").join(hot.alias("y"), F.expr(f"{other} and {_differ('x', 'y', num, den)[0]}"))
    met = few.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).unionByName(many.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))).distinct()
    near = _near("x", "y", num, den)
    return met.join(sets.alias("x"), F.expr("a = x.id")).join(sets.alias("y"), F.expr("b = y.id")).where(near).select("a", "b")


def _unsigned(sets: DataFrame, num: int, den: int) -> DataFrame | None:
    """Pairs (a < b) of sets that cannot be signed with all sets of their size: none, for hashed shingles."""
    short = sets.where("spare < 0").select("id", "n_shingles")
    if short.isEmpty():
        return None
    x, y = short.alias("x"), sets.alias("y")
    sized = x.join(y, F.expr(f"x.id <> y.id and {den} * x.n_shingles >= {num} * y.n_shingles and {den} * y.n_shingles >= {num} * x.n_shingles"))
    return sized.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links: den * |A n B| >= num * |A u B|.

    ``num / den`` may be 3/4 or more: the levels have parts enough for that. The steps run
    when the function is called; the result reads one table.
    """
    bound_batches(docs)
    if 4 * num < 3 * den or num > den:
        raise ValueError("the signature levels hold for similarities from 0.75 to 1")
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    base = scratch.write("base", texts.mapInArrow(_measure(num, den), _BASE).withColumn("row", F.monotonically_increasing_id()))

    known = base.where("doc_id is not null and n_shingles > 0")
    first = F.min(F.struct("doc_id", "row", "n_shingles", "spare")).alias("rep")
    sets = scratch.write("sets", known.groupBy("d1", "d2").agg(first).select("d1", "d2", F.col("rep.doc_id").alias("doc_id"), F.col("rep.row").alias("id"), "rep.n_shingles", "rep.spare"))
    own = base.select(F.col("row").alias("id"), "text")
    sigs = own.join(sets.select("id"), "id", "left_semi").mapInArrow(_sign(num, den), "sig long, id long").repartition("sig")
    sizes = sigs.groupBy("sig").agg(F.min("id").alias("low"), F.max("id").alias("top"), F.count("*").alias("n")).where("low <> top").select("sig", "n")
    live = scratch.write("live", sigs.join(sizes.hint("shuffle_hash"), "sig"))
    kept = scratch.write("kept", _prefixes(live, sets, num, den))
    scratch.drop("live")
    del sigs, sizes, live
    scratch.free_shuffles()
    unsigned = _unsigned(sets, num, den)
    able = kept.select("id").distinct()
    if unsigned is not None:
        able = able.unionByName(unsigned.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    bodies = scratch.write("bodies", own.join(able, "id", "left_semi"))
    bitmaps = scratch.write("members", bodies.mapInArrow(_draw, "id long, n_shingles long, bits array<long>, wide array<long>"))

    near = _near("x", "y", num, den)
    links, tried, roots = None, None, None
    for turn in range(STARS + 1):
        parted = kept.withColumn("c", F.col("id")) if roots is None else kept.join(roots, "id", "left").select("sig", "id", F.coalesce("root", "id").alias("c"))
        mixed = scratch.write(f"mixed{turn}", _mixed(parted))
        pairs = _stars(mixed, bitmaps, turn, near) if turn < STARS else _pairs(mixed, bitmaps, num, den)
        if unsigned is not None and turn == STARS:
            pairs = pairs.unionByName(unsigned).distinct()
        pairs = scratch.write(f"pairs{turn}", pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        similar = scratch.write(f"links{turn}", _verify(bodies, pairs, num, den))
        links = similar if links is None else links.unionByName(similar)
        if turn < STARS:
            roots = connected_components(links, scratch=scratch)
        scratch.drop(f"mixed{turn}")
        scratch.free_shuffles()
    scratch.drop("kept", "bodies", "members")
    names = sets.select("id", F.col("doc_id").alias("name"))
    linked = links.join(names.withColumnRenamed("id", "src"), "src").withColumnRenamed("name", "u").join(names.withColumnRenamed("id", "dst"), "dst").select(F.col("u").alias("src"), F.col("name").alias("dst"))
    same = known.select("doc_id", "d1", "d2").join(sets.select("d1", "d2", F.col("doc_id").alias("name")), ["d1", "d2"]).where("doc_id <> name").select(F.col("name").alias("src"), F.col("doc_id").alias("dst"))
    final = connected_components(linked.unionByName(same), scratch=scratch).withColumnRenamed("id", "doc_id")
    found = base.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    out = scratch.write("out", found)
    scratch.keep("out")
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold their component's least id; rows without an id stay.

    Rows that share that id are one document, of which each different text stays once.
    """
    found = similar_components(docs, id_col, text_col)
    drop = found.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    again = found.where("doc_id is not null and component_id = doc_id").groupBy(F.col("doc_id").alias(id_col)).count().where("count > 1").select(id_col)
    left = docs.join(drop, id_col, "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    repeated = left.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(again, id_col, "left_anti").select(*docs.columns).unionByName(repeated.select(*docs.columns))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
