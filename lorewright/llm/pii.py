"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, digits and plus signs, schemes and
identifier cues. From an anchor a small deterministic parser expands to the left and right and
validates what it has found. No pattern is tried at places without an anchor.

Kinds: email, ip, card, phone (the base kinds), then login (scheme://user:password@host), iban (cue,
country, check digits by the rule of 97), ssn (cue, three groups of digits) and secret (cue such as
token or api key, a sign of assignment, a value of eight characters or more).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "ssn", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}

# Anchors.
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")
CUES = {
    "iban": ("iban", "IBAN", "Iban"),
    "ssn": ("ssn", "SSN", "social security"),
    "secret": ("token", "Token", "TOKEN", "api_key", "API_KEY", "api key", "apikey", "password", "Password", "PASSWORD", "passwd", "secret", "SECRET"),
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: All that an address or number can hold; a match of the next three lies inside one such zone.
ZONE = re.compile(r"[0-9+][0-9 .()+-]*")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/:@]+:[^\s/@]+@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[ :=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8})(?![A-Z0-9])")
SSN = re.compile(r"[ :=#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
SECRET = re.compile(r"""["']?[ \t]{0,3}[:=][ \t]{0,3}["']?([A-Za-z0-9_+/=.-]{8,})""")


def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    for c in "0123456789+":
        a.add_word(c, ("#", 1))
    for s in SCHEMES:
        a.add_word(s, ("login", len(s)))
    for kind, cues in CUES.items():
        for c in cues:
            a.add_word(c, (kind, len(c)))
    a.make_automaton()
    return a


ANCHORS = _anchors()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _numbers(text: str, start: int, out: list) -> int:
    """Addresses and numbers of the zone that begins at start; the zone's end."""
    end = ZONE.match(text, start).end()
    if end - start < 7:
        return end
    for m in IP.finditer(text, start, end):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text, start, end):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    for m in PHONE.finditer(text, start, end):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), "phone", m.end()))
    return end


def spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, end exclusive, by start and then kind as listed."""
    out: list[tuple[int, str, int]] = []
    zone_end = mail_end = 0
    ends = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in ANCHORS.iter(text):
        at = last + 1 - length
        if kind == "#":
            if at >= zone_end:
                zone_end = _numbers(text, at, out)
        elif kind == "@":
            left = at
            while left > mail_end and text[left - 1] in LOCAL:
                left -= 1
            if left < at and (m := DOMAIN.match(text, at + 1)):
                mail_end = m.end()
                out.append((left, "email", mail_end))
        elif at >= ends[kind]:
            if kind == "login":
                if m := LOGIN.match(text, last + 1):
                    ends[kind] = m.end()
                    out.append((at, kind, m.end()))
            elif kind == "iban":
                m = IBAN.match(text, last + 1)
                if m and _iban(m[1]):
                    ends[kind] = m.end(1)
                    out.append((m.start(1), kind, m.end(1)))
            elif m := (SSN if kind == "ssn" else SECRET).match(text, last + 1):
                ends[kind] = m.end(1)
                out.append((m.start(1), kind, m.end(1)))
    out.sort(key=lambda x: (x[0], ORDER[x[1]]))
    return out


def redacted(text: str, found: list[tuple[int, str, int]]) -> str:
    """text with each run of overlapping spans replaced by the kind of its first span, as <kind>."""
    parts, at = [], 0
    for start, kind, end in found:
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def digest(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, list[int]] = {k: [] for k in BASE}
        hashes, all_spans, n_spans = [], [], []
        for text in b.column(1):
            found = spans(text.as_py() or "")
            base = [x for x in found if x[1] in BASE]
            for k in BASE:
                counts[k].append(sum(x[1] == k for x in base))
            hashes.append(hashlib.sha256(digest(base).encode()).hexdigest())
            all_spans.append(digest(found))
            n_spans.append(len(found))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(hashes, pa.string()), pa.array(all_spans, pa.string()), pa.array(n_spans, pa.int64())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"],
        )


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document with its spans.

    Null text counts as empty; equal rows give equal rows, whatever doc_id is. Texts may be of any length and digits
    of any number. Of spans that start together the kinds come as listed. An empty table gives an empty result;
    other columns of docs, whatever their names, are not read.
    """
    return docs.select(doc_id, text).mapInArrow(_report, SCHEMA)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, with personal data in text replaced by its kind.

    Null text stays null, empty text empty; other columns stay, whatever their names, and so do repeated rows.
    """
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if (t := x.as_py()) is None else redacted(t, spans(t)) for x in b.column(place)]
            columns = b.columns
            columns[place] = pa.array(new, b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))
