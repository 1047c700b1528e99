"""Personal data in text: patterns propose spans, checksums confirm, context adjusts.

Each kind has a pattern and, where one exists, a validator (octet range, Luhn, digit
count, mod-97).  Base kinds (email, ip, card, phone) are reported as they are proposed
and confirmed.  Further kinds count only if a validator confirms them (iban: mod-97;
national id and phone without "+": the ranges of their groups; secret: entropy and mixed
characters), if their score, raised or lowered by words near the span on both sides,
reaches the threshold, and where they overlap no base span.

Offsets are code points, end exclusive.  Null and empty texts have no spans.  Repeated
rows are treated one by one; an empty table gives no rows.  Every pattern is applied to
the whole text in time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as U

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id", "local_phone", "secret")
#: Words that raise or lower a span's score when they stand within ``WINDOW`` characters of it.
WINDOW = 48
RAISE = {
    "iban": ("iban", "account", "konto", "cuenta", "compte", "bank"),
    "national_id": ("ssn", "social", "security", "passport", "ausweis", "dni"),
    "local_phone": ("phone", "tel", "call", "mobile", "telefon", "telefono", "fax"),
    "secret": ("token", "secret", "password", "passwd", "passwort", "credential", "apikey", "api_key", "access_key", "private_key", "bearer", "auth"),
}
LOWER = ("order", "invoice", "version", "isbn", "sku", "serial", "example")
START = {"iban": 0.7, "national_id": 0.3, "local_phone": 0.3, "secret": 0.3}
THRESHOLD = 0.6

#: Bits a character that a secret has at least, and its least length.
SECRET_BITS = 2.8
SECRET_SIZE = 16

_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.(-])\(?([0-9]{3})\)?[ .-]([0-9]{3})[ .-][0-9]{4}(?![0-9.-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_IN_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _emails(t: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost non-overlapping matches: each has one "@", so work goes from "@" to "@"."""
    done, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > done and t[s - 1] in _IN_LOCAL:
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            yield "email", s, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)  # what stands before this "@" cannot belong to a later one
        at = t.find("@", max(done, at + 1))


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four base kinds, by start, then kind as listed."""
    out = [(s, e, k) for k, s, e in _emails(t)] if "@" in t else []
    if t.count(".") >= 3:
        for m in _IP.finditer(t):
            if all(len(g.lstrip("0")) <= 3 and int(g[-4:]) <= 255 for g in m.groups()):
                out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda x: (x[0], BASE_KINDS.index(x[2])))
    return out


def entropy(s: str) -> float:
    """Bits a character."""
    counts = Counter(s)
    return log2(len(s)) - sum(c * log2(c) for c in counts.values()) / len(s) if s else 0.0


def issued(area: str, group: str, serial: str) -> bool:
    """Whether a national id's groups are in ranges that are given out."""
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def dialled(area: str, exchange: str) -> bool:
    """Whether a phone number's area and exchange begin with 2 to 9."""
    return area[0] > "1" and exchange[0] > "1"


def secret_like(s: str) -> bool:
    """Letters and digits mixed, with the entropy of a random key."""
    return len(s) >= SECRET_SIZE and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= SECRET_BITS


def _context(t: str, start: int, end: int, kind: str) -> float:
    near = re.findall(r"\w+", (t[max(0, start - WINDOW) : start] + " " + t[end : end + WINDOW]).lower())
    score = START[kind]
    score += 0.4 * any(w.startswith(RAISE[kind]) for w in near)
    score -= 0.3 * any(w.startswith(LOWER) for w in near)
    return score


def _added(t: str) -> Iterator[tuple[int, int, str]]:
    """Spans of the further kinds that their validators confirm."""
    for m in _IBAN.finditer(t):
        body = m[0].replace(" ", "")
        if 15 <= len(body) <= 34 and mod97(body):
            yield m.start(), m.end(), "iban"
    for m in _NATIONAL.finditer(t):
        if issued(*m.groups()):
            yield m.start(), m.end(), "national_id"
    for m in _LOCAL_PHONE.finditer(t):
        if dialled(*m.groups()):
            yield m.start(), m.end(), "local_phone"
    for m in _SECRET.finditer(t):
        if secret_like(m[0]):
            yield m.start(), m.end(), "secret"


def added_spans(t: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Confirmed spans of the further kinds whose context speaks for them and that touch no base span."""
    found = [x for x in _added(t) if _context(t, *x) >= THRESHOLD]
    if not found:
        return []
    starts = sorted((s, e) for s, e, _ in base)
    ends = list(accumulate((e for _, e in starts), max))
    out = []
    for s, e, kind in found:
        k = bisect_left(starts, (e, e))  # base spans that begin before this one's end
        if not k or ends[k - 1] <= s:
            out.append((s, e, kind))
    return out


def all_spans(t: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind as listed."""
    if not t or not _ANY.search(t):
        return [], []
    base = base_spans(t)
    every = base + added_spans(t, base)
    every.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return base, every


def redact(t: str) -> str:
    """The text with every span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for s, e, k in all_spans(t)[1]:
        if s >= at:
            out += [t[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, t[at:]]) if out else t


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, the digests of base spans and all spans, and the counts of secrets and of all spans of each text."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_secret", "n_spans"]

    def run(batches):
        for b in batches:
            for lo, hi in U.spans(b.column(1)):
                cols: list[list] = [[] for _ in names]
                for t in b.column(1)[lo:hi].to_pylist():
                    base, every = all_spans(t or "")
                    kinds = [k for _, _, k in every]
                    base_text = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
                    row = (*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(base_text.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, e, k in every), kinds.count("secret"), len(kinds))
                    for c, x in zip(cols, row):
                        c.append(x)
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *(pa.array(c, t) for c, t in zip(cols, types))], [id_col, *names])

    schema = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long"
    return docs.select(id_col, text_col).mapInArrow(U.tidy(run), schema)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced; null texts stay null; the length column follows."""

    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for lo, hi in U.spans(b.column(at)):
                cols = [c[lo:hi] for c in b.columns]
                cols[at] = pa.array([t if t is None else redact(t) for t in cols[at].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    out = docs.mapInArrow(U.tidy(run), docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out
