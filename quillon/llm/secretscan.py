"""Operator 7: secret scans with character Markov models.

Base spans come from three patterns; their spans are whole matches. The method adds
spans of kind ``markov``: token-like runs (16 characters or more of A-Z a-z 0-9 + / _ -
with at least one letter) whose log-likelihood ratio between a character bigram model
of random strings and one of ordinary identifiers is high. A run of more than 512
characters is scored by overlapping windows and is a span, whole, when one of them is.
Both models are trained from labelled samples: random strings drawn from the usual
secret alphabets with a fixed seed, and the identifiers listed below. Runs without a
digit have models of their own, from alphabets without digits and from the identifiers
in both cases, ordinary long words, repeated characters and alphabet or keyboard order.

Defined cases: null and empty texts have no spans; spans count code points, end
exclusive, ordered by start and then kind; a ``markov`` run that touches a base span
is left out; repeated rows get equal spans; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.session import bound_batches
from quillon.llm.textkernel import slices

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+")
_LETTER = re.compile(r"[A-Za-z]")
_DIGIT = re.compile(r"[0-9]")
WINDOW = 512

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Labelled samples of ordinary identifiers.
IDENTIFIERS = (
    "get_user_name set_default_value parse_json_response max_retry_count connection_pool_size input_file_path output_directory_name "
    "calculate_total_price is_valid_email_address created_at_timestamp user_account_settings http_request_handler load_configuration_file "
    "number_of_partitions shuffle_write_metrics background_color_picker navigation_bar_item2 test_case_0042 chapter_12_section_3 "
    "getElementById addEventListener XMLHttpRequest innerTextContent StringBuilder ArrayList1 HashMapEntry IllegalArgumentException "
    "applicationContext requestMappingHandler transactionManager2 ThreadPoolExecutor serializeToString DeserializationFeature "
    "utf8_general_ci iso-8859-15 windows-1252 x86_64-linux-gnu python3-dev_amd64 lib64/site-packages node_modules/react-dom "
    "src/main/java/com/example/service docs/release-notes/version-2024 images/holiday-photos/summer-2019 news/2024/05/17/elections-results "
    "the-quick-brown-fox-2 how-to-cook-pasta-in-10-minutes best-practices-for-testing-2023 annual-report-2021-final meeting-minutes-03-2020 "
    "international2024conference internationalization18n communication responsibility understanding4all straightforward extraordinary "
    "sternberg-und-hauptstrasse-12 rechtsschutzversicherung2 responsabilidades internacionalmente developpement-durable-2030 "
    "page12345 item_998877 order-20240517 invoice_000123456 id-1234567890123456 2024-05-17_12-30-00 20240517123000 0000000000000001"
).split()
#: Labelled samples of ordinary long words, for runs without a digit.
WORDS = (
    "Geschwindigkeitsbegrenzung Verantwortlichkeit Empfangsbescheinigung Wahrscheinlichkeitsrechnung Krankenversicherungspflicht "
    "Aufmerksamkeitsdefizit Zusammenarbeitsvereinbarung Beschaeftigungsmoeglichkeiten Wissenschaftlichkeit Unabhaengigkeitserklaerung "
    "institutionnellement gouvernementaux particulierement renouvellements quotidiennement malheureusement representationnelle "
    "desafortunadamente caracteristicamente constitucionalidad aprovechamientos extraordinariamente reconocimientos "
    "notwithstanding characteristically misunderstandings acknowledgements thoughtfulness nevertheless telecommunications"
).split()
THRESHOLD = 0.55


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, stop, number of the kind) of the three patterns."""
    spans = []
    if _WORD.search(text):
        spans += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return spans


def _bigrams(texts: list[str]) -> np.ndarray:
    n = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = np.zeros((n + 1, n))
    for t in texts:
        last = n
        for c in t:
            if c in place:
                counts[last, place[c]] += 1
                last = place[c]
    return counts


@lru_cache(maxsize=2)
def ratios(digits: bool = True) -> np.ndarray:
    """log P(random) - log P(ordinary) of each character after each character (last row: at the start)."""
    rng = np.random.Generator(np.random.PCG64(29))
    random, ordinary = [], list(IDENTIFIERS)
    alphabets = (ALPHABET[:62], ALPHABET[:62], ALPHABET, ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[52:62] + "abcdef")
    if not digits:
        alphabets = (ALPHABET[:52], ALPHABET[:52], ALPHABET[:52] + ALPHABET[62:], ALPHABET[:26], ALPHABET[26:52])
        ordinary += WORDS + [ALPHABET[26:52], "qwertyuiopasdfghjklzxcvbnm"] * 4
        ordinary += [t.upper() for t in ordinary] + [c * 4 for c in ALPHABET]
    for letters in alphabets:
        random += ["".join(letters[i] for i in rng.integers(0, len(letters), 40)) for _ in range(300)]
    n = len(ALPHABET)

    def log_model(counts: np.ndarray) -> np.ndarray:
        unigram = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * n)
        return np.log((counts + 6 * unigram) / (counts.sum(axis=1, keepdims=True) + 6))

    return log_model(_bigrams(random)) - log_model(_bigrams(ordinary))


_PLACE = np.zeros(128, np.int64)
_PLACE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def randomness(run: str, digits: bool = True) -> float:
    """Mean log-likelihood ratio of a run's characters."""
    code = _PLACE[np.frombuffer(run.encode("ascii"), np.uint8)]
    before = np.append(len(ALPHABET), code[:-1])
    return float(ratios(digits)[before, code].mean())


def is_random(run: str, threshold: float = THRESHOLD) -> bool:
    """Whether a run, or a window of a long one, is likelier random than ordinary."""
    starts = [*range(0, len(run) - WINDOW, WINDOW // 2), max(len(run) - WINDOW, 0)]
    windows = (run[a : a + WINDOW] for a in starts)
    return any(_LETTER.search(w) and randomness(w, bool(_DIGIT.search(w))) >= threshold for w in windows)


def find_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """All spans of a text, by start and then kind."""
    if not text:
        return []
    spans = base_spans(text)
    by_start = sorted(spans)
    starts, reach = [a for a, _, _ in by_start], [0, *accumulate((b for _, b, _ in by_start), max)]
    for m in _RUN.finditer(text):
        touches = reach[bisect_left(starts, m.end())] > m.start()
        if not touches and is_random(m[0], threshold):
            spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 4 << 20):
        found = [[{"kind": KINDS[k], "start": a, "stop": b} for a, b, k in find_spans(t)] if t else [] for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, _SPANS)], ["doc_id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row of ``docs``; spans: array of (kind, start, stop)."""
    bound_batches(docs)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:int,stop:int>>")


def _redact(text_col: str, mark: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 4 << 20):
            texts = []
            for t in part.column(text_col).to_pylist():
                spans = find_spans(t) if t else []
                if spans:
                    pieces, at = [], 0
                    for a, b, k in spans:
                        if b <= at:
                            continue
                        pieces += [t[at : max(a, at)], mark.format(KINDS[k])] if a >= at else []
                        at = b
                    t = "".join([*pieces, t[at:]])
                texts.append(t)
            arrays = [pa.array(texts, pa.string()) if n == text_col else part.column(n) for n in part.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, part.schema.names)

    return run


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """The rows of ``docs`` with each span replaced by its kind in brackets."""
    bound_batches(docs)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_redact(text_col, mark), schema)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = {k: F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS}
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"
    base = joined.format("filter(spans, s -> s.kind <> 'markov')")
    return found.select("doc_id", *(count[k] for k in KINDS[:3]), F.sha2(F.expr(base), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"), count["markov"])
