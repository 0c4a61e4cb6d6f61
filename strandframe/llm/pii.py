"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Base kinds (email, ip, card, phone) are kept whatever their score. Added kinds are iban (mod-97), kept by its
checksum; ssn (dashed 3-2-4 digits) and secret (32 to 64 hexadecimal digits of many kinds, as keys and tokens are
written), weak patterns that only context words raise above the threshold; and secret in forms that name themselves.

Offsets count code points, the end exclusive. Patterns are walked so that time is linear in the text.
Defined results: null and empty texts hold nothing; repeated rows are treated each by itself; added spans that
overlap a base span are dropped; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_texts

Span = tuple[str, int, int]

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does: from inside the run it would go on to the same place.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])")
_KEY = re.compile(r"(?<![0-9A-Za-z_])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|sk_(?:live|test)_[0-9A-Za-z]{24,64})(?![0-9A-Za-z_])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")

# Score of each kind, context words that raise or lower it, the reach of context in characters.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.3}
CONTEXT = {
    "email": "mail email contact e-mail write courriel correo",
    "ip": "ip address server host client login",
    "card": "card visa mastercard credit payment carte karte tarjeta",
    "phone": "phone call tel telephone mobile fax contact telefon teléfono",
    "iban": "iban account bank transfer konto compte cuenta",
    "ssn": "ssn social security",
    "secret": "token secret key apikey password passwd api auth authorization bearer credential credentials",
}
AGAINST = frozenset("version release example sample order isbn part serial".split())
NEARBY, RAISED, LOWERED, THRESHOLD = 48, 0.35, 0.2, 0.5
_CONTEXT = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    """Doubles every second digit from the right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        n *= 1 + i % 2
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def mixed(digits: str) -> bool:
    """Digits and letters, ten kinds of them at least: no number, no run, no pattern."""
    return len(set(digits)) >= 10 and not digits.isdigit() and not digits.isalpha()


def _emails(text: str) -> Iterator[Span]:
    free = 0  # a local part reaches back no further than the last match or the last @
    at = text.find("@")
    while at >= 0:
        head = text[free:at]
        start = len(head.rstrip(_LOCAL)) + free
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    spans = list(_emails(text))
    if _DIGIT.search(text) is None:
        return spans
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]  # of any length, so only short ones become numbers
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def score(text: str, span: Span) -> float:
    kind, start, end = span
    words = {w.lower() for w in _WORD.findall(text[max(0, start - NEARBY) : start] + " " + text[end : end + NEARBY])}
    change = RAISED * bool(words & _CONTEXT[kind]) - LOWERED * bool(words & AGAINST)
    return round(min(1.0, max(0.0, SCORE[kind] + change)), 2)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """All confirmed spans with their scores, by kind as listed, then start."""
    base = base_spans(text)
    more: list[Span] = []
    sure: set[Span] = set()
    if _DIGIT.search(text) is not None:
        more = [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0])]
        more += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        sure = {("secret", *m.span()) for m in _KEY.finditer(text)}
        more += sorted([*sure, *(("secret", *m.span()) for m in _HEX.finditer(text) if mixed(m[0]))], key=lambda x: x[1])
        if more:
            taken = sorted((s, e) for _, s, e in base)
            more = [x for x in more if not any(s < x[2] and x[1] < e for s, e in taken)]
    scored = [(*s, score(text, s)) for s in base]
    return scored + [x for x in ((*s, score(text, s)) for s in more) if x[3] >= THRESHOLD or x[:3] in sure]


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, n_added, n_spans, the spans as kind:start:end and their scores."""

    def row(doc_id: object, text: bytes | None) -> tuple:
        spans = find_spans(text.decode()) if text else []
        counts = {k: 0 for k in BASE_KINDS}
        written: dict[bool, list[str]] = {True: [], False: []}
        for kind, start, end, _ in spans:
            written[kind in counts].append(f"{kind}:{start}:{end}")
            if kind in counts:
                counts[kind] += 1
        base, every = ",".join(written[True]), ",".join(written[True] + written[False])
        return doc_id, *counts.values(), len(written[False]), len(spans), base, every, ",".join(f"{s[3]:g}" for s in spans)

    kind = "long" if docs.schema["doc_id"].dataType.simpleString() == "bigint" else docs.schema["doc_id"].dataType.simpleString()
    return map_texts(
        docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id", "text"], row,
        f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, n_spans long, base string, spans string, scores string",
    )


def pii_digest(docs: DataFrame) -> DataFrame:
    found = pii_spans(docs)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", "n_spans", "scores")


def mask(text: str) -> str:
    """Each span replaced by its kind in brackets; overlapping spans by the kind of the first. Found again until none is left."""
    while spans := sorted((s, -e, k) for k, s, e, _ in find_spans(text)):
        out, at = [], 0
        for start, end, kind in spans:
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, -end)
        text = "".join([*out, text[at:]])
    return text


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in text and n_chars set anew; all columns and rows stay."""
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                old = part.column(at_text).to_pylist()
                new = [mask(t) if t else t for t in old]
                if new != old:
                    arrays = list(part.columns)
                    arrays[at_text] = pa.array(new, part.column(at_text).type)
                    if at_chars is not None:
                        lengths = part.column(at_chars).to_pylist()
                        lengths = [n if a == b else len(b) for n, a, b in zip(lengths, old, new)]
                        arrays[at_chars] = pa.array(lengths, part.column(at_chars).type)
                    part = pa.RecordBatch.from_arrays(arrays, schema=part.schema)
                yield part

    return docs.mapInArrow(clean, docs.schema)
