"""Quality rules by distribution divergence.

A document's character-class and common-word histograms are compared with references of its language by
Jensen-Shannon distance. A reference is the sum of the histograms of all other documents of that language, so it
follows the corpus, but no document is its own measure; one that holds too little is replaced by the sum over all
languages (characters), or not used (words). A sample of n from a distribution of k cells lies (k - 1) / (8 n ln 2) from
it on average (in bits, as divergence): that much is subtracted, or short texts would look unlike their language. Minimum
lengths guard texts whose histograms say nothing at all.

Defined results: null and empty texts have no words and fail the base rule; a language is a code of two or three
letters (what follows a hyphen or underscore doesn't count), and all documents with any other value or null are one
language; texts of languages without a word list are compared by character classes only; repeated rows are judged
each by itself; an empty table gives an empty result; columns beyond doc_id, text and lang are left alone.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import utf8

# The most common function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by this at from or have an they which",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il avec",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
    "it": "di e il la che in a un del per è una le con i si da non dei al come della più nel sono",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi",
    "nl": "de van het een en in is dat op te zijn met voor niet die aan er om ook als dan maar bij uit door",
}
OTHER, ALL = "other", "*"
WORDS = {lang: {w.encode(): i for i, w in enumerate(text.split())} for lang, text in COMMON_WORDS.items()}
N_COMMON = 26  # 25 words and the rest

#: At or above these distances a text is unlike its language. Set once from the labels of sf0.1: of 3,302 documents
#: labelled clean that pass the base rule 9 lie at or above one of them, of 301 labelled otherwise 292.
MAX_CHAR_DISTANCE = 0.20
MAX_WORD_DISTANCE = 0.24
#: Shorter texts are not compared.
MIN_CHARS = 200
MIN_WORDS = 40
#: References of fewer characters or words than these are not used.
MIN_REFERENCE_CHARS = 20_000
MIN_REFERENCE_WORDS = 4_000
MIN_BASE_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

SYMBOLS = b"#*$%&|<>"
# Character classes by the first byte of a code point's UTF-8 form.
LOWER, UPPER, DIGIT, BLANK, NEWLINE, STOP, SYMBOL, SEPARATOR, QUOTE, CONTROL, LATIN, TWO, THREE, FOUR, INNER = range(15)
N_CLASSES = 14


def _classes() -> np.ndarray:
    kinds = np.full(256, CONTROL, np.uint8)
    for chars, kind in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b" \t\x0b\x0c\r", BLANK), (b"\n", NEWLINE), (b".,;:!?", STOP), (b"'\"()[]-_/", QUOTE), (b"#*$%&<>=+@`{}", SYMBOL), (b"|\\^~", SEPARATOR)):
        kinds[list(chars)] = kind
    kinds[0x80:0xC0], kinds[0xC0:0xC9], kinds[0xC9:0xE0], kinds[0xE0:0xF0], kinds[0xF0:] = INNER, LATIN, TWO, THREE, FOUR
    return kinds


CLASS_OF = _classes()
#: Lower-cases A-Z and blanks what isn't part of an alphanumeric word.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


_CODE = re.compile(r"([a-z]{2,3})(?:[-_].*)?", re.DOTALL)


def language(lang: str | bytes | None) -> str:
    found = _CODE.fullmatch(lang.decode() if isinstance(lang, bytes) else lang) if lang else None
    return found[1] if found else OTHER


def histograms(text: bytes, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes (with INNER, which is no class, last), and of common words and the rest."""
    chars = np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=N_CLASSES + 1)
    words = np.zeros(N_COMMON, np.int64)
    known = WORDS.get(lang)
    for k, n in Counter(map(known.get, text.translate(PLAIN).split())).items() if known else ():
        words[N_COMMON - 1 if k is None else k] += n
    return chars, words


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    flat = array("I", [ids.setdefault(w, len(ids)) for w in words]).tobytes()
    size = 4 * window
    if n <= 50_000:
        windows = [flat[i : i + size] for i in range(0, 4 * n, 4)]
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        starts = np.array([i for i, w in enumerate(windows) if counts[w] > 1])
    else:
        rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(flat, np.uint32), window)
        whole = np.ascontiguousarray(rows).view(np.dtype((np.void, size))).ravel()
        _, inverse, counts = np.unique(whole, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: bytes, chars: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    seen: set[bytes] = set()
    dups = 0
    for line in text.split(b"\n"):
        if line and line.strip():
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    return (
        len(words),
        int(chars[:N_CLASSES].sum() - chars[BLANK] - chars[NEWLINE]),
        sum(text.count(c) for c in SYMBOLS),
        dups,
        repeated_words(words),
    )


def js_divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (base 2, 0 to 1) of each row of p from each row of q; rows are counts."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2

    def gain(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    return np.clip((gain(p) + gain(q)) / 2, 0, 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The root of the divergence beyond that of a sample of p's size."""
    sampling = (p.shape[1] - 1) / (8 * np.log(2) * np.maximum(p.sum(axis=1), 1))
    return np.sqrt(np.maximum(js_divergence(p, q) - sampling, 0))


References = dict[str, tuple[list[int], list[int]]]


def language_references(docs: DataFrame) -> References:
    """Summed histograms of all documents of each language, and of all (of these the characters only). Languages are
    codes of two or three letters, so at most 18,253 small rows, whatever the column holds."""

    def sums(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in stream:
            langs = batch.column(0).to_pylist()
            for start in range(0, batch.num_rows, 512):
                for lang, text in zip(langs[start : start + 512], utf8(batch.column(1).slice(start, 512))):
                    if text:
                        both = np.concatenate(histograms(text, key := language(lang)))
                        totals[key] = totals[key] + both if key in totals else both
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array([x.tolist() for x in totals.values()], pa.list_(pa.int64()))],
            ["lang", "counts"],
        )

    width = N_CLASSES + 1 + N_COMMON
    rows = (
        docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        .mapInArrow(sums, "lang string, counts array<long>")
        .groupBy("lang")
        .agg(*(F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(width)))
        .collect()
    )
    return with_all({r["lang"]: (list(r)[1 : N_CLASSES + 1], list(r)[N_CLASSES + 2 :]) for r in rows})


def with_all(references: References) -> References:
    total = np.sum([c for c, _ in references.values()], axis=0).tolist() if references else [0] * N_CLASSES
    return references | {ALL: (total, [0] * N_COMMON)}


def judge(langs: list, texts: list[bytes | None], references: References, among: bool = True) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    among: the references hold these documents, which are each taken out for their own comparison.
    """
    keys = [language(x) for x in langs]
    texts = [t or b"" for t in texts]
    found = [histograms(t, k) for t, k in zip(texts, keys)]
    if not found:
        return []
    blank = ([0] * N_CLASSES, [0] * N_COMMON)
    chars, words = np.stack([f[0][:N_CLASSES] for f in found]), np.stack([f[1] for f in found])
    own = 1 if among else 0
    everything = np.array(references.get(ALL, blank)[0], np.int64) - own * chars
    char_refs, word_refs = (np.array([references.get(k, blank)[i] for k in keys], np.int64) - own * x for i, x in enumerate((chars, words)))
    few = char_refs.sum(axis=1) < MIN_REFERENCE_CHARS
    char_refs = np.where(few[:, None], everything, char_refs)
    long_enough = chars.sum(axis=1) >= MIN_CHARS
    by_chars = long_enough & (char_refs.sum(axis=1) >= MIN_REFERENCE_CHARS)
    by_words = long_enough & (words.sum(axis=1) >= MIN_WORDS) & (word_refs.sum(axis=1) >= MIN_REFERENCE_WORDS)
    char_distances, word_distances = js_distance(chars, char_refs), js_distance(words, word_refs)
    out = []
    for i, text in enumerate(texts):
        base = base_counts(text, found[i][0])
        failed = base[0] < MIN_BASE_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
        dc = float(char_distances[i]) if by_chars[i] else None
        dw = float(word_distances[i]) if by_words[i] else None
        unlike = (dc is not None and dc >= MAX_CHAR_DISTANCE) or (dw is not None and dw >= MAX_WORD_DISTANCE)
        out.append((*base, failed, not failed and not unlike, dc, dw))
    return out


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def quality_verdicts(docs: DataFrame, references: References | None = None) -> DataFrame:
    """doc_id and the verdict on each document; references default to those of the other documents."""
    among = references is None
    references = language_references(docs) if references is None else references
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    names = ["doc_id", *(x.split()[0] for x in VERDICT.split(", "))]

    def verdicts(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = judge(part.column(1).to_pylist(), utf8(part.column(2)), references, among)
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(
        verdicts, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {VERDICT}"
    )


def keep_quality(docs: DataFrame, references: References | None = None) -> DataFrame:
    """The documents that pass, with all their columns."""
    among = references is None
    references = language_references(docs) if references is None else references
    at_lang, at_text = docs.columns.index("lang"), docs.columns.index("text")

    def passing(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                kept = [r[6] for r in judge(part.column(at_lang).to_pylist(), utf8(part.column(at_text)), references, among)]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(passing, docs.schema)
