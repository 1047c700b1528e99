"""Token ids in ORC files.

Documents are range-partitioned and sorted by id *before* encoding, so only their
text is shuffled and each task encodes, numbers and writes its own stretch.  A file
row is (block, doc_id, local_start, n_tokens, ids): ORC keeps the integers in
run-length-encoded streams, a row index in every stripe and a Bloom filter on
``doc_id``, so a reader prunes stripes by id and reads stripes in parallel.  Global
offsets need only the blocks' totals (one row for each written partition).

Null text counts as empty (only the end id).  A null ``doc_id`` sorts first; rows
that share an id are ordered by their text and may lie in several files.  An empty table
gives no rows.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _util as U

#: Parts that one worker remembers before it starts a new generation.
CACHE_PARTS = 250_000
#: Bytes of text that are cut and encoded at once.
SLICE_BYTES = 8 << 20
_LETTER, _DIGIT, _OTHER, _SPACE, _UNSAFE = 0, 1, 2, 3, 4


def _byte_kinds() -> np.ndarray:
    """The kind of each byte: of ASCII characters, and of those that begin no Latin-1 letter."""
    kind = np.full(256, _UNSAFE, np.uint8)
    kind[33:127] = _OTHER
    kind[48:58] = _DIGIT
    kind[65:91] = kind[97:123] = _LETTER
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    return kind


_KIND = _byte_kinds()


class ChunkEncoder:
    """Ids of texts, found once for each distinct part of a slice of text.

    The tokenizer drops white space and never joins across it.  A chunk (a run without ASCII
    white space) of ASCII signs and Latin-1 letters is lower-cased and cut into the parts of
    the tokenizer's own split; any other chunk is one part.  Cutting, numbering the distinct
    parts and putting the ids in place are passes over whole arrays; parts not met lately go
    to the library in one call.
    """

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tok = Tokenizer.from_str(data)
        #: For parts that are lower-cased Latin-1 already, which the normaliser leaves as they are.
        self.bare = Tokenizer.from_str(data)
        self.bare.normalizer = normalizers.Sequence([])
        vocabulary = self.tok.get_vocab()
        #: Tokens that end a part, where the vocabulary marks them.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: list[dict[str, bytes]] = [{}, {}]

    def _library(self, parts: list[str], into: dict[str, bytes]) -> None:
        """Ids of any parts, told apart by the library's own word numbers."""
        enc = self.tok.encode(parts, is_pretokenized=True, add_special_tokens=False)
        raw = np.array(enc.ids, "<u4").tobytes()
        cut = (4 * np.searchsorted(np.array(enc.word_ids, np.int64), np.arange(len(parts) + 1))).tolist()
        for w, i, j in zip(parts, cut, cut[1:]):
            into[w] = raw[i:j]

    def _plain(self, parts: list[str], into: dict[str, bytes]) -> None:
        """Ids of parts that the tokenizer's split leaves whole: encoded as running text, told apart by the tokens that end them."""
        lines = [" ".join(parts[i : i + 1000]) for i in range(0, len(parts), 1000)]
        ids = np.array([x for e in self.bare.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids], "<u4")
        cut = 4 * np.flatnonzero(self.last[ids]) + 4
        if len(cut) != len(parts):
            return self._library(parts, into)
        raw, i = ids.tobytes(), 0
        for w, j in zip(parts, cut.tolist()):
            into[w] = raw[i:j]
            i = j

    def _ids(self, parts: list[str], odd: np.ndarray) -> list[bytes]:
        """The ids of distinct parts; what was asked for in this or the last generation is remembered."""
        now, before = self.known
        whole = {parts[i] for i in odd}
        plain, other = [], []
        for p in parts:
            if p not in now:
                ids = before.get(p)
                if ids is not None:
                    now[p] = ids
                elif p in whole:
                    other.append(p)
                else:
                    plain.append(p)
        if plain:
            self._plain(plain, now)
        if other:
            self._library(other, now)
        out = [now[p] for p in parts]
        if len(now) > CACHE_PARTS:
            self.known = [{}, now]
        return out

    def encode(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text); texts are UTF-8, one after the other, each followed by a line feed."""
        ids, upto, lo = [], np.zeros(len(ends) + 1, np.int64), 0
        while lo < len(buf):
            hi = _after_space(buf, lo + SLICE_BYTES)  # a very long text is encoded in stretches
            found, counts = self._stretch(buf[lo:hi], ends - lo)
            ids.append(found)
            upto[1:] += counts
            lo = hi
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.diff(upto)

    def _stretch(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids before each end)."""
        text, stop, chunk, odd = _cut(buf)
        at = np.concatenate(([0], np.cumsum(stop - text)))
        if not len(text):
            return np.empty(0, np.uint32), np.zeros(len(ends), np.int64)
        parts = pa.StringArray.from_buffers(len(text), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(chunk))
        coded = parts.dictionary_encode()
        code = coded.indices.to_numpy()
        raw = self._ids(coded.dictionary.to_pylist(), np.unique(code[odd]))
        flat = np.frombuffer(b"".join(raw), "<u4")
        length = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        first = np.cumsum(length) - length
        n = length[code]
        done = np.cumsum(n)
        ids = flat[np.repeat(first[code] - done + n, n) + np.arange(int(done[-1]))]
        return ids, np.concatenate(([0], done))[np.searchsorted(text, ends, side="left")]


def _after_space(buf: np.ndarray, at: int) -> int:
    """The place after the first ASCII white space at or after ``at``; at most the end."""
    while at < len(buf):
        found = np.flatnonzero(_KIND[buf[at : at + 4096]] == _SPACE)
        if len(found):
            return at + int(found[0]) + 1
        at += 4096
    return len(buf)


def _cut(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every part, the parts' own bytes in turn, lower-cased where the chunk is plain, and the numbers of parts that are other chunks."""
    kind = _KIND[buf]
    # Two-byte letters À-ÿ: C3 80-96, 98-B6, B8-BF.
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    tail = buf[lead + 1]
    lead = lead[(tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    kind[np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C))] = _UNSAFE  # "<|" may begin a special token
    low = buf.copy()
    low[(buf >= 65) & (buf <= 90)] += 32
    upper = lead[buf[lead + 1] < 0x9F] + 1
    low[upper] += 32

    solid = kind != _SPACE
    edge = np.diff(np.concatenate((np.zeros(1, np.int8), solid.view(np.int8), np.zeros(1, np.int8))))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # chunks
    unsafe = np.flatnonzero(kind == _UNSAFE)
    odd = np.zeros(len(first), bool)
    odd[np.searchsorted(first, unsafe, side="right") - 1] = True

    # A part begins where a chunk does, where the kind changes, and at every digit.
    begin = np.empty(len(buf) + 1, bool)
    begin[0], begin[-1] = True, True
    begin[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begin[:-1] &= solid
    _clip(buf, low, kind, begin)
    for i, j in zip(first[odd], last[odd]):  # such chunks stay whole, and as they are written
        begin[i + 1 : j] = False
        low[i:j] = buf[i:j]
    start = np.flatnonzero(begin[:-1])
    # A part ends where the next one begins, or with its chunk.
    own_end = last[np.searchsorted(first, start, side="right") - 1] if len(start) else start
    stop = np.minimum(np.concatenate((start[1:], [len(buf)])), own_end).astype(np.int64)
    return start, stop, low[solid], np.searchsorted(start, first[odd])


def _clip(buf: np.ndarray, low: np.ndarray, kind: np.ndarray, begin: np.ndarray) -> None:
    """Move parts' beginnings where an apostrophe that begins a part is followed by a clipped ending."""
    for q in np.flatnonzero((buf == 39) & begin[:-1]).tolist():
        while q < len(buf) and buf[q] == 39:
            tail = low[q + 1 : q + 3].tobytes()
            n = 2 if tail[:1] in (b"s", b"t", b"m", b"d") else 3 if tail in (b"re", b"ve", b"ll") else 0
            if not n:
                break
            begin[q + 1] = False
            end = q + n
            if end < len(buf) and kind[end] != _SPACE:
                begin[end] = True
            q = end


_ENCODERS: dict[int, ChunkEncoder] = {}


def write_token_orc(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` in ascending id order and write the ORC files under ``path``."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # the driver's parameter: under 2 MB, shipped with the job
        data = spark.sparkContext.broadcast(f.read())
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        key = zlib.crc32(data.value.encode())
        if key not in _ENCODERS:
            _ENCODERS[key] = ChunkEncoder(data.value)
        encoder, block, at = _ENCODERS[key], TaskContext.get().partitionId(), 0
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(size, dtype=np.int64) // SLICE_BYTES
            lo = 0
            while lo < len(b):
                hi = int(np.searchsorted(group, group[lo], side="right"))
                texts = pc.binary_join_element_wise(pc.fill_null(b.column(1)[lo:hi], ""), "", "\n")
                upto = np.concatenate(([0], np.cumsum(size[lo:hi].astype(np.int64) + 1)))
                ids, counts = encoder.encode(np.frombuffer(texts.buffers()[2], np.uint8, upto[-1]), upto[1:] - 1)
                counts += 1
                stops = np.cumsum(counts)
                full = np.full(int(stops[-1]), end_id, np.int32)
                inner = np.ones(len(full), bool)
                inner[stops - 1] = False
                full[inner] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), pa.array(full))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, block, np.int32)), b.column(0)[lo:hi], pa.array(at + stops - counts), pa.array(counts), lists], ["block", id_col, "local_start", "n_tokens", "ids"])
                at += int(stops[-1])
                lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    (
        docs.select(id_col, text_col)
        .repartitionByRange(n, F.col(id_col), F.substring(text_col, 1, 32))  # an id of very many rows is cut by their texts
        .sortWithinPartitions(id_col, text_col)
        .mapInArrow(run, f"block int, `{id_col}` {kind}, local_start long, n_tokens long, ids array<int>")
        .write.option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .option("orc.stripe.size", str(64 << 20))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_orc(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids``: rows of the files with their global offsets."""
    rows = spark.read.orc(path)
    order = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_tokens").alias("n")).select("block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    # Broadcast: one row for each written partition, so that the ids themselves are not shuffled.
    return rows.join(F.broadcast(blocks), "block").select(id_col, (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def ids_crc(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Replace ``ids`` by their count and the CRC-32 of their little-endian 32-bit form."""

    def run(batches):
        for b in batches:
            ids = b.column(2)
            flat, off = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            n = np.diff(off).astype(np.int64)
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "start", "ids").mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")
