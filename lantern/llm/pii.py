"""Personal data: patterns propose spans, checksums confirm them, and words nearby move their score.

Four base kinds (email, ip, card, phone) are reported whenever pattern and validator agree. Two more, bank account
numbers (iban, confirmed by mod 97) and social security numbers (ssn, of which no checksum exists), are reported if
pattern, validator and the words around them together reach a threshold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import prepare, read

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Score of a confirmed span before its context, by kind, and what reports the kinds that are not base.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
THRESHOLD = 0.6
#: Characters on either side whose words count as nearby.
NEAR = 48
FOR, AGAINST = 0.25, 0.3

# Words that speak for a kind, and words that speak against any.
CONTEXT = {
    "email": {"email", "e-mail", "mail", "contact", "write", "courriel", "correo"},
    "ip": {"ip", "host", "server", "address", "login", "client"},
    "card": {"card", "credit", "debit", "visa", "mastercard", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta", "transfer"},
    "ssn": {"ssn", "social", "security"},
}
DOUBT = {"version", "example", "sample", "test", "isbn", "invoice", "order", "release", "build", "serial"}
# Lengths of international bank account numbers by country: fixed values of their public registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
_ACCOUNT = re.compile(r"[A-Z0-9](?: ?[A-Z0-9])*")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NUMBER = re.compile(r"[0-9]++")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a dotted domain, in time linear in the text."""
    at = text.find("@")
    pos = 0
    while at >= 0:
        start = at
        while start > pos and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            pos = m.end()
        else:
            pos = max(pos, start)
        at = text.find("@", max(at + 1, pos))


def ips(text: str) -> Iterator[tuple[int, int]]:
    pos = 0
    while run := _NUMBER.search(text, pos):
        if (m := _IP.match(text, run.start())) is None:
            pos = run.end()
            continue
        pos = m.end()
        if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length that pass mod 97; single spaces may stand inside. The search goes on behind a number, or right behind the start of what is none."""
    pos = 0
    while m := _IBAN.search(text, pos):
        pos, size = m.start() + 1, IBAN_LENGTH.get(m[1])
        if not size:
            continue
        run = _ACCOUNT.match(text, m.start(), m.start() + 2 * size)[0]
        kept = run.replace(" ", "")[:size]
        end, left = m.start(), size
        while left and end < m.start() + len(run):
            left -= text[end] != " "
            end += 1
        if len(kept) == size and mod97(kept) and not text[end : end + 1].isalnum():
            yield m.start(), end
            pos = end


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def scored(text: str, kind: str, start: int, end: int) -> Span:
    near = re.findall(r"[\w-]+", f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower())
    score = PRIOR[kind] + FOR * (not CONTEXT[kind].isdisjoint(near)) - AGAINST * (not DOUBT.isdisjoint(near))
    return Span(kind, start, end, min(1.0, max(0.0, score)))


def spans(text: str) -> list[Span]:
    """All spans of a text by start, then kind; ends are exclusive, in code points."""
    found = []
    if "@" in text:
        found += (scored(text, "email", *x) for x in emails(text))
    if _DIGIT.search(text):
        found += (scored(text, k, *x) for k, f in (("ip", ips), ("card", cards)) for x in f(text))
        if "+" in text:
            found += (scored(text, "phone", *x) for x in phones(text))
        found += (s for k, f in (("iban", ibans), ("ssn", ssns)) for x in f(text) if (s := scored(text, k, *x)).score >= THRESHOLD)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def listed(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found array<struct<kind, start, end, value, score>>): one row per input row; no shuffle.

    A null or empty text has no spans. Null ids, repeated ids and repeated rows are kept as they are. Extra columns
    are not read.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x in b.column(1):
                text = x.as_py() or ""
                found.append([s._asdict() | {"value": text[s.start : s.end]} for s in spans(text)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return source.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long, value: string, score: double>>")


def redact(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for s in spans(text):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
            at = s.end
    return "".join([*out, text[at:]])


def digest(found: list[Span]) -> str:
    return hashlib.sha256(listed([s for s in found if s.kind in BASE]).encode()).hexdigest()


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """All documents: spans counted and listed per document."""
    found = find_pii(read(spark, sf_dir, "documents"))
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), F.transform("found", lambda s: F.round(s["score"], 2)).alias("scores"))
