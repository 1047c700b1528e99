"""SentencePiece BPE encoding and decoding.

Encoding is exact and does no global merge queue: the longest vocabulary match at
each position comes from an Aho-Corasick automaton, a token is accepted only if it
is compatible with the one before it (merging the two tokens' text afresh gives the
same two tokens), and on failure the search backs up, noting failed positions in a
bitfield so that none is tried twice.  A sequence whose neighbours are all
compatible is the unique result of merging by score.

Null text counts as empty; empty text has no ids and decodes to the empty string.
Characters outside the vocabulary become byte pieces (or the unknown id where the
model has no byte fallback).  Only models with the identity normaliser are taken.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _util as U

SPACE = "▁"
#: Words whose encodings a task remembers before it starts a new generation; it holds two (after ``forget`` none).
CACHE_WORDS = 200_000


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""

    def varint(i: int) -> tuple[int, int]:
        x = s = 0
        while True:
            c = b[i]
            x |= (c & 127) << s
            i, s = i + 1, s + 7
            if c < 128:
                return x, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class PieceModel:
    """A BPE piece model read from the bytes of its file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        spec: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
                self.pieces.append((f.get(1, b"").decode(), score, f.get(3, 1)))
            elif number == 2:
                if dict(_fields(value)).get(3, 1) != 2:
                    raise ValueError("not a BPE model")
            elif number == 3:
                spec = dict(_fields(value))
        if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1) or any(p[2] in (4, 5) for p in self.pieces):
            raise ValueError("only identity-normalised models without user-defined or unused pieces are supported")
        self.normal = {p: (i, s) for i, (p, s, kind) in enumerate(self.pieces) if kind == 1}
        self.number = {p: i for p, (i, _) in self.normal.items()}
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == 2)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == 6}
        self.bytes_of = {i: v for v, i in self.byte_ids.items()}
        self.control = {i for i, p in enumerate(self.pieces) if p[2] == 3}
        self.plain = [("" if i in self.control else p.replace(SPACE, " ")) for i, (p, _, _) in enumerate(self.pieces)]
        self.plain[self.unk] = " ⁇ "
        # Pieces never span "x▁", so text can be cut there; checked, not assumed.
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in self.normal)
        self.letters = {c for p in self.normal for c in p}
        self.solo = "\n" not in self.letters
        self.auto = ahocorasick.Automaton()
        self.short: dict[str, str | None] = {}
        sound = {p for p in self.normal if self.merge(p) == [p]}
        for p in sound:
            self.auto.add_word(p, p)
            self.short[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in sound), None)
        self.auto.make_automaton()
        self.most = max(map(len, sound))
        # The longest token that starts a stretch, by the path it takes through the automaton.
        self.best: dict[str, str | None] = {}
        for p in sound:
            token = None
            for n in range(1, len(p) + 1):
                if p[:n] in sound:
                    token = p[:n]
                self.best[p[:n]] = token
        self.fits: dict[tuple[str, str], bool] = {}
        # Packed ids of words after a space (two generations), and of words after a line feed.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop what a task has remembered; the model itself stays with the worker."""
        self.fits, self.cache, self.older, self.bare = {}, {}, {}, {}

    def merge(self, text: str) -> list[str]:
        """Merging by score, best pair first, leftmost on ties: the reference for short strings."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                e = self.normal.get(parts[i] + parts[i + 1])
                if e and (best is None or e[1] > best):
                    best, at = e[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 2 * CACHE_WORDS:
                self.fits.clear()
            got = self.fits[a, b] = self.merge(a + b) == [a, b]
        return got

    def _known(self, text: str) -> list[str]:
        """Tokens of a text whose every character is in the vocabulary."""
        size = len(text)
        reach, best, most = self.auto.longest_prefix, self.best, self.most
        failed: bytearray | None = None  # a bit for each position, once one has failed
        fits, short = self.fits, self.short
        out: list[str] = []
        rest = text[:most]
        pos, last, token = 0, None, best.get(rest[: reach(rest)])
        while pos < size:
            if token is None:
                if not out:
                    return self.merge(text)  # no compatible sequence: a vocabulary with unsound characters
                if failed is None:
                    failed = bytearray((size >> 3) + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                token = out.pop()
                pos -= len(token)
                last = out[-1] if out else None
                token = short[token]
                continue
            end = pos + len(token)
            if failed is not None and failed[end >> 3] >> (end & 7) & 1:
                token = short[token]
                continue
            if last is not None:
                ok = fits.get((last, token))
                if ok is None:
                    ok = self.compatible(last, token)
                if not ok:
                    token = short[token]
                    continue
            out.append(token)
            pos, last, rest = end, token, text[end : end + most]
            token = best.get(rest[: reach(rest)])
        return out

    def _word(self, word: str) -> bytes:
        """Packed ids of a word that follows a space; line feeds stand alone."""
        if "\n" in word:
            first, *rest = word.split("\n")
            feed = self._after_feed("\n")
            return b"".join([self.cache.get(first) or self._word(first), *(feed + self._after_feed(x) if x else feed for x in rest)])
        ids = self.older.get(word)
        if ids is None:
            ids = _packed(self._segment(SPACE + word))
        if len(word) < 64:
            if len(self.cache) >= CACHE_WORDS:
                self.older, self.cache = self.cache, {}
            self.cache[word] = ids
        return ids

    def _after_feed(self, word: str) -> bytes:
        ids = self.bare.get(word)
        if ids is None:
            ids = _packed(self._segment(word))
            if len(word) < 64:
                if len(self.bare) >= CACHE_WORDS:
                    self.bare = {}
                self.bare[word] = ids
        return ids

    def _segment(self, text: str) -> list[int]:
        number = self.number
        if self.letters.issuperset(text):
            tokens = self._known(text)
            try:
                return [number[t] for t in tokens]
            except KeyError:  # a letter that occurs only inside longer pieces
                return [x for t in tokens for x in ([number[t]] if t in number else self._spelt(t))]
        ids: list[int] = []
        for known, part in _runs(text, self.letters):
            ids += self._segment(part) if known else self._spelt(part)
        return ids

    def _spelt(self, text: str) -> list[int]:
        """Byte pieces of characters outside the vocabulary."""
        if not self.byte_ids:
            return [self.unk] * len(text)
        return [self.byte_ids[b] for b in text.encode("utf-8", "replace")]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        known, word = self.cache.get, self._word
        if self.cut and self.solo and text[0] != " " and "  " not in text and SPACE not in text:
            raw = [known(w) or word(w) for w in text.split(" ")]
        else:
            whole = SPACE + text.replace(" ", SPACE)
            parts = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", whole) if self.cut else [whole]
            single = [self.solo and p[0] == SPACE and p[1:2] not in ("", SPACE) for p in parts]
            raw = [known(p[1:]) or word(p[1:]) if one else _packed(self._segment(p)) for p, one in zip(parts, single)]
        ids = array("I", b"".join(raw)).tolist()
        if self.byte_ids or self.unk not in ids:
            return ids
        return [x for i, x in enumerate(ids) if x != self.unk or not i or ids[i - 1] != self.unk]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces are joined as UTF-8, the dummy first space goes."""
        plain = self.plain
        if self.bytes_of.keys().isdisjoint(ids):
            text = "".join([plain[i] for i in ids])
            return text[1:] if ids and self.pieces[ids[0]][0].startswith(SPACE) else text
        out: list[str] = []
        held = bytearray()
        for n, i in enumerate(ids):
            b = self.bytes_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            out.append(plain[i][1:] if n == 0 and self.pieces[i][0].startswith(SPACE) else plain[i])
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _utf8(b: bytes) -> str:
    """UTF-8 with one replacement character for each byte that starts no valid character."""
    try:
        return b.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(b):
            for n in (1, 2, 3, 4):
                try:
                    out.append(b[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def _runs(text: str, letters: set[str]) -> Iterator[tuple[bool, str]]:
    at = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or (text[i] in letters) != (text[at] in letters):
            yield text[at] in letters, text[at:i]
            at = i


_MODELS: dict[str, PieceModel] = {}


def model_of(data: bytes) -> PieceModel:
    """One model for each worker process."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = PieceModel(data)
    return _MODELS[key]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id_col, n_tokens, ids, exact`` and the columns ``keep``: every text's ids, and whether they decode to it.

    The model file is read on the driver and shipped.
    """
    data = docs.sparkSession.sparkContext.broadcast(_read(model_path))
    keep = keep or []
    kind = docs.schema[id_col].dataType.simpleString()
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        model = model_of(data.value)
        for b in batches:
            for lo, hi in U.spans(b.column(1)):
                texts = [t or "" for t in b.column(1)[lo:hi].to_pylist()]
                ids = [model.encode(t) for t in texts]
                exact = [model.decode(x) == t for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(exact), *(c[lo:hi] for c in b.columns[2:])],
                    [id_col, "n_tokens", "ids", "exact", *keep],
                )
        model.forget()

    return docs.select(id_col, text_col, *keep).mapInArrow(U.tidy(run), f"`{id_col}` {kind}, n_tokens long, ids array<int>, exact boolean{kept}")


def _read(path: str) -> bytes:
    with open(path, "rb") as f:  # a parameter of the driver's: at most a few MB, shipped with the job
        return f.read()


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode, every text in one pass; return counts and digests of both."""
    data = docs.sparkSession.sparkContext.broadcast(_read(model_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = model_of(data.value)
        decimal = [str(i) for i in range(len(model.pieces))]
        sha = hashlib.sha256
        for b in batches:
            n, digest, back = [], [], []
            for t in b.column(1):
                ids = model.encode(t.as_py() or "")
                n.append(len(ids))
                digest.append(sha(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                back.append(sha(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(U.tidy(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
