"""Former limits of the text operators, tested on both sides, and tables that used to go wrong."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import difference
from test_text_operators import brute_components, brute_removed, edit_distance_inside

from quillon.llm import chat, decontam, htmltext, jaccard, media, pieces, quality, queries, secretscan, substring, textkernel, urls

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def thue_morse(n, a, b):
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out


def test_hashes_tell_thue_morse_words_apart():
    x = thue_morse(2048, "a", "b")
    y = ["b" if c == "a" else "a" for c in x]
    words = textkernel.Words(pa.array(["".join(x) + " " + "".join(y), " ".join(x), " ".join(y)]))
    assert words.hashes[0] != words.hashes[1]
    runs = words.runs()
    a, b = words.rows[1:3]
    assert len({int(h) for h in runs.spans(np.array([a, b]), np.array([a + 2048, b + 2048]))}) == 2
    model = pieces.Model(pieces.read_model())
    texts = ["".join(x), "".join(y), " ".join(["".join(y), "".join(x)])]
    ids, at = model.encode(pa.array(texts), {})
    assert model.decode(ids, at) == texts


def test_spans_equal_windows():
    words = textkernel.Words(pa.array([" ".join(f"w{i % 7}" for i in range(200)), "x" * 600 + " " + "x" * 601 + " " + "x" * 600]))
    runs = words.runs()
    for width in (1, 2, 5, 6, 35, 64, 97):
        got = runs.windows(width)
        assert (got == runs.spans(np.arange(len(got)), np.arange(len(got)) + width)).all()
    assert words.hashes[200] != words.hashes[201] and words.hashes[200] == words.hashes[202]


def test_parts_hold_every_window_once():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 3000)]
    text = "".join(w + rng.choice([" ", "\n", " \t "]) for w in words).encode()
    for overlap in (0, 4, 34):
        seen = []
        for first, part in textkernel.parts_of(text, 500, overlap):
            own = part.decode().split()
            seen += [(first + i, tuple(own[i : i + overlap + 1])) for i in range(len(own) - overlap)]
        assert seen == [(i, tuple(words[i : i + overlap + 1])) for i in range(len(words) - overlap)]
    assert textkernel.parts_of(b"x" * 5000, 100, 4) == [(0, b"x" * 5000)]


def test_pieces_on_both_sides_of_the_long_chunk():
    library = pytest.importorskip("sentencepiece")
    model, own = pieces.Model(pieces.read_model()), library.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("aethinsr"), n)) for n in range(pieces.LONG - 8, pieces.LONG + 9) for _ in range(3)]
    texts.append(" ".join(texts) * 3)
    for limit in (pieces.SLICE, 300):  # in one run, and in runs of chunks
        ids, at = model.encode(pa.array(texts), {}, limit)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == own.encode(text)


def test_result_columns_replace_their_namesakes(spark):
    model = pieces.read_model()
    rows = spark.createDataFrame([(1, "some text", "x", "y", 0.9)], "doc_id long, text string, ids string, decoded string, score double")
    back = pieces.decode(pieces.encode(rows, model), model).first()
    assert back.decoded == "some text" and back.score == 0.9
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(rows, labels).collect() == rows.collect()
    assert quality.keep_good(rows.withColumnRenamed("text", "body"), labels, text_col="body").count() == 1
    two = rows.withColumnRenamed("ids", "body").withColumn("body", rows.text)
    assert secretscan.redact(two, text_col="body").columns == two.columns
    bench = spark.createDataFrame([(1, "nothing of the kind in here")], "item_id long, text string")
    more = rows.withColumnsRenamed({"ids": "item_id", "decoded": "start"})
    assert decontam.find_leaks(more, bench).count() == 0 and decontam.drop_leaks(more, bench).collect() == more.collect()


def test_jaccard_texts_of_one_id(spark):
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    a, b, c = prose(100), prose(100), prose(90)
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, c), (9, c), (None, c), (None, None), (10, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in jaccard.similar_components(df).where("doc_id is not null").collect())
    assert got == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9), (9, 9), (10, 10)]
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(df).collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (9, c), (10, ""), (None, c), (None, None)], key=str)


def test_signatures_miss_no_similar_pair():
    """Pairs as far apart as the threshold allows share a kept signature, whatever others drop."""
    rng = np.random.Generator(np.random.PCG64(9))
    for size in [*range(1, 10), 40, 48, 49, 63, 64, 65, 85, 86, 97, 127, 128, 129, 171, 172, 200, 255, 256, 257, 300, 342, 768, 1000, 1023, 1025, 3000] * 3:
        pool = rng.integers(0, 2**64, 3 * size + 8, dtype=np.uint64)
        shared = pool[:size]
        for extra_a in {0, (size // 3) // 2, size // 3}:
            extra_b = size // 3 - extra_a
            a, b = np.sort(np.append(shared, pool[size : size + extra_a])), np.sort(np.append(shared, pool[2 * size : 2 * size + extra_b]))
            if 4 * size < 3 * (size + extra_a + extra_b):
                continue
            flat, offsets = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            rows, sigs = jaccard.signatures(flat, offsets, 75, 100)
            x, y = set(sigs[rows == 0].tolist()), set(sigs[rows == 1].tolist())
            spare = jaccard.spares(flat, offsets, 75, 100)
            assert (spare >= 0).all()
            odd, even = {s for s in x & y if s % 2}, {s for s in x & y if s % 2 == 0}
            tiny = max(len(a), len(b)) <= jaccard.TINY
            assert len(even) > max(spare) or (tiny and len(odd) >= 0.75 * max(len(a), len(b))), size


def test_jaccard_long_text(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 4000)]
    text = " ".join(words)
    whole, _ = jaccard.shingle_sets(pa.array([text]))
    parts, _ = jaccard.shingle_sets(pa.array([text]), limit=2000)
    assert (whole == parts).all()


def test_substring_long_text(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    shared = [prose(n) for n in (35, 60, 200)]
    rows = [(i, " ".join(x for n in range(6) for x in (prose(rng.integers(0, 90)), shared[(i + n) % 3]))) for i in range(6)] + [(9, "y " * 400), (10, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for limit in (400, 1 << 22):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(df, long_text=limit).collect()), key=str)
        assert got == brute_removed(rows)


def test_short_benchmark_items(spark):
    items = [(1, "short one"), (2, "夢の話"), (3, "q"), (4, "ten chars!"), (5, "?!"), (6, "a longer item of the benchmark")]
    docs = [(1, "a short   ONE, here"), (2, "shorter ones"), (3, "今日は夢の話をする"), (4, "q"), (5, "quiz"), (6, "x ten chars y"), (7, "short-one"), (8, None), (None, "so short one"), (9, "in a longer item of the benchmarks")]
    rows, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = sorted({(r.doc_id, r.item_id) for r in decontam.find_leaks(rows, bench).collect()}, key=str)
    assert got == sorted([(1, 1), (3, 2), (4, 3), (6, 4), (7, 1), (None, 1), (9, 6)], key=str)
    for size in (20, 10**6):
        left = decontam.drop_leaks(rows, bench, block_chars=size).collect()
        assert {r.doc_id for r in left} == {2, 5, 8}


def test_repetitive_items_and_shared_stems():
    item, text = "abcdefghijklm " * 70, "abcdefghijklm " * 3000
    index = decontam.Index([(0, item), (1, "x" * 1000), *((2 + i, f"which of the following is the case for number {i}") for i in range(2000))])
    codes, _ = decontam.normalise([text, "x" * 40000, "which of the following is the case " * 400])
    hit, slot = decontam._hits(index, codes)
    keys, counts = decontam.band_counts(index, hit, slot)
    assert len(keys) < 3 * decontam.PAIRS and (counts > 0).all()
    rng = np.random.default_rng(5)
    noise = "".join(rng.choice(list("abcdefgh "), 3000))
    small = decontam.Index([(0, "abcab" * 20), (1, noise[500:700]), (2, "z" * 60)])
    texts = [noise, "z" * 59 + "y", "abcab" * 19 + "xabcab", noise[480:590] + "h" + noise[591:720], "z" * 50]
    want = set()
    for d, t in enumerate(texts):
        for i, own in enumerate(small.codes):
            norm = decontam.normalise([t])[0][:-1]
            if edit_distance_inside(own.tolist(), norm.tolist()) <= small.budget[i]:
                want.add((d, i))
    assert {(d, i) for d, i, *_ in decontam.search(small, texts)} == want


def test_quality_learns_from_whole_texts(spark):
    rng = np.random.default_rng(6)
    net = quality.Net()
    texts = ["", "short", "é" * 400, "".join(map(chr, rng.integers(32, 127, 2000)))]
    tables = net.tables()
    got = [net.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), tables)[0] for t in texts]
    for text, score in zip(texts, got, strict=True):
        raw, logits, hop = text.encode(), [], quality.CHUNK - quality.OVERLAP
        for a in range(0, max(len(raw) - quality.OVERLAP, 1), hop):
            chunk = raw[a : a + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            starts = range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
            pooled = np.array([[sum(tables[k][chunk[s + k]][f] for k in range(quality.WIDTH)) for s in starts] for f in (0, 7, 31)]).max(axis=1)
            mine = net.pooled(np.frombuffer(chunk, np.uint8)[None], tables)[0]
            assert np.allclose(pooled + net.p["fbias"][[0, 7, 31]], mine[[0, 7, 31]], atol=1e-5)
            logits.append(net.logits(mine[None])[0])
        assert score == pytest.approx(1 / (1 + np.exp(-np.mean(logits))), abs=1e-6)
    long = np.frombuffer(("word " * 100_000).encode(), np.uint8)
    whole = net.scores(long, np.array([0, len(long)]), tables)
    saved, quality.LONG_TEXT = quality.LONG_TEXT, 10_000
    try:
        assert net.scores(long, np.array([0, len(long)]), tables) == pytest.approx(whole, abs=1e-8)
    finally:
        quality.LONG_TEXT = saved


def test_png_writes_and_reads_all_filters():
    rng = np.random.default_rng(8)
    for shape in ((1, 576), (7, 576), (9, 7, 3), (5, 4, 2), (1, 1), (40, 3, 4)):
        pixels = np.cumsum(rng.integers(0, 4, shape), axis=1).astype(np.uint8)
        for kinds in ((0,), (1,), (2,), (3,), (4,), (0, 1, 2), (0, 1, 2, 3, 4)):
            assert (media.read_png(media.write_png(pixels, kinds=kinds)) == pixels).all()
    text = np.frombuffer(b"the quick brown fox jumps over the lazy dog. " * 64, np.uint8)[:2304].reshape(4, 576)
    assert media._filtered(text, 1, (0, 1, 2))[0].any()  # what the query stores needs the unfilter


def test_conversation_over_many_fragments(spark):
    rows = [(1, None if i % 3 else i, "assistant" if i % 2 else "user", f"text {i} " * 40) for i in range(200)] + [(2, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    small, large = chat.format_chats(turns, fragment_bytes=2000), chat.format_chats(turns)
    assert small.where("conv_id = 1").count() > 20 > large.count()
    assert sorted(chat.read_chats(small).collect()) == sorted(chat.read_chats(large).collect())


def test_urls_against_sql_and_held_out_rows(spark):
    assert urls.held_out_accuracy() >= 0.9
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in urls.op6_urls(spark, SMALL).collect()}
    sql = f"""with u as (select page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') as h, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from '{SMALL}/pages.parquet'),
     p as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u), r(rule, says) as (values ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
     f as (select page_id, rule, says, row_number() over (partition by page_id order by length(rule) desc) as k from p, r where ('.' || host) like '%.' || split_part(rule, '/', 1) and starts_with(path, substr(rule, position('/' in rule))))
     select p.page_id, host, path, rule, says from p left join f on p.page_id = f.page_id and k = 1"""
    weights, bias = urls.train()
    want = duckdb.connect().execute(sql).fetchall()
    assert len(want) == pages.count()
    for page, host, path, rule, says in want:
        grams = [(1, f"^{host}$" if host else ""), (2, path)]
        cells = [(s, g.encode()[i : i + n]) for s, g in grams for n in urls.GRAMS for i in range(len(g.encode()) - n + 1)]
        total = 0.0
        for s, own in cells:
            code = s * 16 + len(own)
            for c in own:
                code = (code * 257 + c) % 2**64
            total += weights[int(textkernel.mix(np.array([code], np.uint64))[0]) % urls.BUCKETS]
        score = 1 / (1 + np.exp(-(total / np.sqrt(max(len(cells), 1)) + bias)))
        g = got[page]
        assert (g.host, g.path, g.rule) == (host, path, rule) and g.score == pytest.approx(score)
        assert g.verdict == (says or ("block" if score >= 0.5 else "allow"))


def brute_base_spans(text):
    """The three patterns, character by character."""
    low, out, i = "0123456789abcdef", [], 0
    run = lambda at, ok: next((j for j in range(at, len(text)) if not ok(text[j])), len(text))
    ascii_only = "".join(c.lower() if c.isascii() else "\0" for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    while i < len(text):
        key = next((k for k in ("password", "passwd", "secret", "token", "api_key", "apikey") if ascii_only.startswith(k, i)), None)
        if key:
            j = i + len(key)
            j += j < len(text) and text[j] in "\"'"
            j = run(j, lambda c: c == " ")
            if j < len(text) and text[j] in ":=":
                j = run(j + 1, lambda c: c == " ")
                j += j < len(text) and text[j] in "\"'"
                end = run(j, lambda c: c in value)
                if end > j:
                    if end - j >= 12:
                        out.append((i, end, 0))
                    i = end
                    continue
        i += 1
    for kind, head, ok, least in ((1, "AKIA", lambda c: c.isascii() and (c.isdigit() or c.isupper()), 18), (2, "", lambda c: c in low, 16)):
        i = 0
        while i < len(text):
            if text.startswith(head, i) and run(i + len(head), ok) > i + len(head):
                end = run(i + len(head), ok)
                if end - i >= least:
                    out.append((i, end, kind))
                i = end
            else:
                i += 1
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_against_brute_force(spark):
    rng = np.random.default_rng(12)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apiKey", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "x", ".", "ſ", "é", "\n", "Zq9/+", "0f"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r.text]
    for text in texts:
        assert sorted(secretscan.base_spans(text), key=lambda s: (s[0], s[2])) == brute_base_spans(text)
    rows = spark.createDataFrame([(1, "token=abcdefabcdefabcd")] * 3, SCHEMA)
    assert [len(r.spans) for r in secretscan.scan(rows).collect()] == [2, 2, 2]


def test_template_stage_decides(spark):
    rng = np.random.default_rng(13)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    rows, truth = [], []
    for n in range(40):  # pages without telling names: only recurrence says what is template
        body = [prose(20) for _ in range(3)]
        top, side = "<div><ul><li>Start<li>News<li>Shop</ul></div>", f"<div><p>Our offers of the week<p>Visit us in Main Street {n % 2}</div>"
        rows.append((n, f"http://h{n % 2}.example/{n}", f"<body>{top}{''.join(f'<p>{b}</p>' for b in body)}{side}<div>All rights reserved</div></body>"))
        truth.append("\n".join(body))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    on = {r.page_id: r.text for r in htmltext.main_text(df).collect()}
    off = {r.page_id: r.text for r in htmltext.main_text(df, templates=False).collect()}
    assert [on[n] for n in range(40)] == truth
    assert all(off[n] != truth[n] for n in range(40))


def test_titles_that_articles_share_stay(spark):
    rng = np.random.default_rng(14)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    rows = [(n, "http://a.example/", f"<article><h1>Daily report</h1><p>{prose(30)}</p><p>Read more of us</p></article>") for n in range(30)]
    got = [r.text.split("\n") for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert all(t[0] == "Daily report" and len(t) == 2 for t in got)


def test_lines_that_some_articles_share_stay(spark):
    rng = np.random.default_rng(15)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    rows, want = [], {}
    for n in range(120):  # a licence line in 30 articles, a box in 30, a note in 90
        own = [prose(30), prose(30)]
        line = ["Released under the MIT License."] * (n % 4 == 0)
        box = "<div>Our picks of the week</div>" * (n % 4 == 1)
        note = "<p>Tell your friends about us</p>" * (n % 4 != 0)
        rows.append((n, f"http://a.example/{n}", f"<article>{box}<p>{own[0]}</p>{''.join(f'<p>{x}</p>' for x in line)}<p>{own[1]}</p>{note}</article>"))
        want[n] = "\n".join([own[0], *line, own[1]])
    got = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    assert {r.page_id: r.text for r in got.collect()} == want


def test_deep_and_long_pages():
    deep = "<div>" * 20000 + "text" + "</div>" * 20000
    blocks, parts = htmltext.parse(deep)
    assert blocks == ["text"] and not parts
    long = "<body><article>" + "".join(f"<p>paragraph {i}</p>" for i in range(20000)) + "</article>"
    assert len(htmltext.parse(long)[0]) == 20000


def test_pages_against_brute_force(spark):
    """The given pages have one article of h1, p, b and br: its text by a plain reading."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: r.text for r in htmltext.op10_htmltext(spark, "/root/testdata/sf0.01").collect()}
    for page, source in pages.items():
        inner = re.search(r"<article>(.*?)</article>", source or "", re.S)
        blocks = re.split(r"</?(?:h1|p)>", inner[1]) if inner else []
        texts = [" ".join(html.unescape(re.sub(r"</?(?:b|br)>", lambda m: " " if "br" in m[0] else "", b)).split()) for b in blocks]
        assert got[page] == "\n".join(t for t in texts if t), page


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMALL), queries.ORACLE[name], SMALL) == ""


def test_near_pairs_found_on_the_tables(spark):
    """Recall of similar pairs: rows whose id 100 divides, against all rows, by brute force."""
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op8_jaccard(spark, d).collect()}
    assert found == brute_components(docs)
