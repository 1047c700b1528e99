"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history).  Frequent words (the
head) share ``HEAD_CLASSES`` classes; the rest fall into tail classes by their ending.
The class is a softmax over hashed features of the history: the last word, the word
before it (a skip), and both together (n-gram), plus a bias.  Inside a head class the
word is a softmax over hashed (last word, class) features; inside a tail class it has
its smoothed share of the class's counts, so unseen words have a probability too and
everything sums to one.

Training: rounds of distributed gradient updates.  Documents are dealt to shards by a
hash of id and text, as many as their bytes ask for, and ordered within by another, so
the model does not depend on partitions, retries or the size of the cluster.  In each
round every shard takes AdaGrad steps on its documents of that round from the shared
weights and returns the changed rows; a row's new value is the mean over the shards that
used it, by use.  Each training document is used in exactly one round.  Words are 64-bit
hashes.

Scoring needs each word's training count.  The ``COMMON`` most frequent words' counts are
broadcast, so that no frequent word is a key of a join.  Texts are dealt into blocks of
bounded size; a block's other distinct words meet the counts in a join and come back to
the block as one small table, so neither the vocabulary nor all (document, word) pairs
ever gather.

Null text counts as empty (one end token).  With no training documents every count is 0
and the model is its uniform start.  Repeated rows are scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _util as U

HEAD_CLASSES, TAIL_CLASSES, WIDTH = 16, 16, 32
CLASSES = HEAD_CLASSES + TAIL_CLASSES
FEATURE_ROWS = 4_096
WORD_ROWS = 8_192
CLASS_SHAPE = (3 * FEATURE_ROWS + 1, CLASSES)
WORD_SHAPE = (WORD_ROWS + HEAD_CLASSES, WIDTH)
ROUNDS = 2
BATCH = 8_192
RATE = 0.3
SMOOTH = 0.1
END = np.uint64(0x0E4D0E4D0E4D0E4D)
START = np.uint64(0x57A2757A2757A27)
#: Bytes of text in a scoring block, rows of weights that travel together.
BLOCK_BYTES = 6 << 20
#: Bytes of text in a training shard; words whose counts are sent to all.
SHARD_BYTES = 24 << 20
COMMON = 1 << 16
CHUNK_ROWS = 256


@dataclass
class Vocabulary:
    total: int
    distinct: int
    head: np.ndarray  # sorted hashes
    head_class: np.ndarray
    head_place: np.ndarray
    tail_total: np.ndarray
    tail_distinct: np.ndarray
    head_counts: np.ndarray


@dataclass
class Model:
    vocabulary: Vocabulary
    by_class: np.ndarray
    by_word: np.ndarray


def sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, tail class) of every token, each text followed by its end token."""
    row, h, last = U.words_and_ends(texts)
    n = len(row) + len(texts)
    at = np.arange(len(row)) + row
    out_h, out_t, out_r = np.full(n, END, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    out_h[at], out_t[at], out_r[at] = h, tail_class(last), row
    ends = np.cumsum(np.bincount(row, minlength=len(texts)) + 1) - 1
    out_r[ends] = np.arange(len(texts))
    return out_r, out_h, out_t


def tail_class(last: np.ndarray) -> np.ndarray:
    return (U.mix64(last.astype(np.uint64)) >> np.uint64(60)).astype(np.int64) % TAIL_CLASSES


def contexts(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word before and of the one before that; a start mark outside the text."""
    one, two = np.full(len(h), START, np.uint64), np.full(len(h), START, np.uint64)
    one[1:] = np.where(row[1:] == row[:-1], h[:-1], START)
    two[2:] = np.where(row[2:] == row[:-2], h[:-2], START)
    return one, two


def class_rows(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - 12)
    skip = U.mix64(two + np.uint64(0x2545F4914F6CDD1D))
    both = U.mix64(one * np.uint64(0x9E3779B97F4A7C15) + two)
    rows = [(x >> shift).astype(np.int64) + k * FEATURE_ROWS for k, x in enumerate((one, skip, both))]
    return [*rows, np.full(len(one), 3 * FEATURE_ROWS)]


def word_rows(one: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
    x = U.mix64(one + cls.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return [(x >> np.uint64(64 - 13)).astype(np.int64), WORD_ROWS + cls]


def _logits(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = w[rows[0]]
    for r in rows[1:]:
        z += w[r]
    return z


def _log_softmax_at(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z[np.arange(len(z)), target] - np.log(np.exp(z).sum(1))


def _segment_sums(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; most segments are short, so all first rows are added, then all second ones, and so on."""
    out = x[start]
    more, k = np.flatnonzero(size > 1), 1
    while len(more) >= 64:
        out[more] += x[start[more] + k]
        k += 1
        more = more[size[more] > k]
    for i in more:
        out[i] += x[start[i] + k : start[i] + size[i]].sum(0)
    return out


def _step(w: np.ndarray, seen: np.ndarray, used: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> None:
    """One AdaGrad step on the rows that the batch uses."""
    z = _logits(w, rows)
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(z)), target] -= 1
    # Hashed rows by sorted segments; the few bias rows by a product with their 0/1 matrix.
    idx = np.concatenate(rows[:-1]).astype(np.uint16)
    order = np.argsort(idx, kind="stable")
    idx = idx[order]
    start = np.concatenate(([0], np.flatnonzero(np.diff(idx)) + 1))
    few, of = np.unique(rows[-1], return_inverse=True)
    ones = (of == np.arange(len(few))[:, None]).astype(np.float32)
    size = np.diff(np.concatenate((start, [len(idx)])))
    g = np.concatenate((_segment_sums(z[order % len(z)], start, size), ones @ z))
    n = np.concatenate((size, ones.sum(1))).astype(np.float32)
    g /= np.sqrt(n)[:, None]
    r = np.concatenate((idx[start].astype(np.int64), few))
    seen[r] += (g * g).mean(1)
    w[r] -= RATE * g / np.sqrt(seen[r] + 1e-3)[:, None]
    used[r] += n


def place(v: Vocabulary, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, place in a head class or -1) of tokens."""
    if not len(v.head):
        return HEAD_CLASSES + tail, np.full(len(h), -1)
    k = np.minimum(np.searchsorted(v.head, h), len(v.head) - 1)
    known = v.head[k] == h
    return np.where(known, v.head_class[k], HEAD_CLASSES + tail), np.where(known, v.head_place[k], -1)


def _start(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Weights whose bias rows give the unigram shares."""
    by_class, by_word = np.zeros(CLASS_SHAPE, np.float32), np.full(WORD_SHAPE, 0, np.float32)
    mass = np.concatenate((np.bincount(v.head_class, v.head_counts, minlength=HEAD_CLASSES)[:HEAD_CLASSES], v.tail_total)).astype(float)
    by_class[-1] = np.log(mass + 0.5)
    bias = np.full((HEAD_CLASSES, WIDTH), -20.0)
    bias[v.head_class, v.head_place] = np.log(v.head_counts)
    by_word[WORD_ROWS:] = bias
    return by_class, by_word


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``h, tail, c``: every distinct token of the texts and its count."""

    def run(batches):
        for b in batches:
            for _, texts in U.slices(b.column(0), 8 * U.SLICE_BYTES):
                _, h, tail = sequence(texts)
                u, first, c = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": u.view(np.int64), "tail": tail[first].astype(np.int8), "c": c.astype(np.int64)})

    rows = docs.select(text_col).mapInArrow(U.tidy(run), "h long, tail tinyint, c long")
    return rows.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(HEAD_CLASSES * WIDTH).select("h", "tail", "c").toArrow()  # at most that many rows
    h, tail, c = (top.column(i).to_numpy() for i in range(3))
    order = np.argsort(h.view(np.uint64))
    total, distinct = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # one row for each class
        total[r["tail"]], distinct[r["tail"]] = r["n"], r["v"]
    np.subtract.at(total, tail, c)
    np.subtract.at(distinct, tail, 1)
    return Vocabulary(sums["n"], sums["v"], h.view(np.uint64)[order], (order % HEAD_CLASSES).astype(np.int64), (order // HEAD_CLASSES).astype(np.int64), total, distinct, c[order].astype(float))


def _chunks(tag: int, new: np.ndarray, old: np.ndarray, used: np.ndarray):
    for k in range(0, len(new), CHUNK_ROWS):
        u = used[k : k + CHUNK_ROWS]
        if u.any():
            d = (new[k : k + CHUNK_ROWS] - old[k : k + CHUNK_ROWS]) * u[:, None]
            yield tag * 100_000 + k // CHUNK_ROWS, np.concatenate((d.ravel(), u)).astype(np.float32).tobytes()


def _shard_steps(sent):
    """What one shard does in a round: steps from the sent weights over its documents, in their order."""

    def run(group: pa.Table) -> pa.Table:
        v, class0, word0 = sent.value
        c, w = class0.copy(), word0.copy()
        state = [(np.zeros(len(x), np.float32), np.zeros(len(x), np.float32)) for x in (c, w)]
        group = group.take(np.argsort(group.column("_order").to_numpy(), kind="stable")).combine_chunks()
        for chunk in group.column("_text").chunks:
            for _, texts in U.slices(chunk):
                row, h, tail = sequence(texts)
                cls, spot = place(v, h, tail)
                one, two = contexts(row, h)
                for lo in range(0, len(h), BATCH):
                    s = slice(lo, lo + BATCH)
                    _step(c, *state[0], class_rows(one[s], two[s]), cls[s])
                    head = np.flatnonzero(spot[s] >= 0)
                    if len(head):
                        _step(w, *state[1], word_rows(one[s][head], cls[s][head]), spot[s][head])
        rows = [*_chunks(0, c, class0, state[0][1]), *_chunks(1, w, word0, state[1][1])]
        shard = group.column("_shard")[0].as_py()
        return pa.table([pa.array([k for k, _ in rows], pa.int32()), pa.array([shard % 64] * len(rows), pa.int32()), pa.array([shard] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["k", "salt", "shard", "x"])

    return run


def train(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Rounds of local steps and row-wise means over the given (training) documents."""
    spark = docs.sparkSession
    by_class, by_word = _start(v)
    if not v.total:
        return Model(v, by_class, by_word)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-size // SHARD_BYTES))
    own = [F.col(id_col), F.col(text_col)]
    dealt = docs.select(
        F.pmod(F.xxhash64(F.lit("round"), *own), F.lit(ROUNDS)).alias("_round"), F.pmod(F.xxhash64(F.lit("shard"), *own), F.lit(shards)).cast("int").alias("_shard"), F.xxhash64(F.lit("order"), *own).alias("_order"), F.col(text_col).alias("_text"),
    )
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast((v, by_class, by_word))  # about 3 MB, whatever the input

        schema = "k int, salt int, shard int, x binary"
        got = dealt.where(F.col("_round") == r).groupBy("_shard").applyInArrow(_shard_steps(sent), schema)
        got = got.groupBy("k", "salt").applyInPandas(_total, schema).withColumns({"shard": F.col("salt"), "salt": F.lit(0)})
        for k, _, _, x in got.groupBy("k", "salt").applyInPandas(_total, schema).toLocalIterator():  # one row for each chunk of weights
            w = (by_class, by_word)[k // 100_000]
            lo = k % 100_000 * CHUNK_ROWS
            n = min(CHUNK_ROWS, len(w) - lo)
            a = np.frombuffer(bytes(x), np.float32)
            used = a[-n:]
            w[lo : lo + n] += a[:-n].reshape(n, -1) / np.maximum(used, 1)[:, None]
    return Model(v, by_class, by_word)


def _total(group: pd.DataFrame) -> pd.DataFrame:
    """The sum of a chunk's changes, in the order of the shards, so that it rounds alike each time."""
    group = group.sort_values("shard")
    total = None
    for x in group["x"]:
        a = np.frombuffer(x, np.float32)
        total = a.astype(np.float64) if total is None else total + a
    return pd.DataFrame({"k": group["k"].iloc[:1], "salt": group["salt"].iloc[:1], "shard": group["shard"].iloc[:1], "x": [total.astype(np.float32).tobytes()]})


def log10_scores(m: Model, texts: list[bytes], words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, known tokens, base score, model score) of each text; ``words`` sorted."""
    v = m.vocabulary
    row, h, tail = sequence(texts)
    c = np.zeros(len(h))
    if len(words):
        k = np.minimum(np.searchsorted(words, h), len(words) - 1)
        c = np.where(words[k] == h, counts[k], 0).astype(float)
    base = np.log10((c + SMOOTH) / (v.total + SMOOTH * (v.distinct + 1)))
    cls, spot = place(v, h, tail)
    one, two = contexts(row, h)
    score = np.empty(len(h))
    for lo in range(0, len(h), BATCH):
        s = slice(lo, lo + BATCH)
        score[s] = _log_softmax_at(_logits(m.by_class, class_rows(one[s], two[s])), cls[s])
    head = np.flatnonzero(spot >= 0)
    for lo in range(0, len(head), BATCH):
        i = head[lo : lo + BATCH]
        score[i] += _log_softmax_at(_logits(m.by_word, word_rows(one[i], cls[i])), spot[i])
    rest = np.flatnonzero(spot < 0)
    t = cls[rest] - HEAD_CLASSES
    score[rest] += np.log((c[rest] + SMOOTH) / (v.tail_total[t] + SMOOTH * (v.tail_distinct[t] + 1)))
    n = len(texts)
    return np.bincount(row, minlength=n), np.bincount(row, c > 0, minlength=n).astype(np.int64), np.bincount(row, base, minlength=n), np.bincount(row, score, minlength=n) / np.log(10)


def score(docs: DataFrame, m: Model, counts: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_BYTES))
    # Texts hash to blocks by content and id, so that no hot source or id range shares one.
    dealt = docs.select(F.pmod(F.xxhash64(*keep, text_col), F.lit(blocks)).alias("_block"), *keep, F.col(text_col).alias("_text")).repartition("_block")
    sent = spark.sparkContext.broadcast(m)  # about 3 MB
    top = counts.orderBy(F.desc("c"), "h").limit(COMMON).select("h", "c").toArrow()  # at most COMMON rows
    order = np.argsort(top.column(0).to_numpy().view(np.uint64))
    known = spark.sparkContext.broadcast((top.column(0).to_numpy().view(np.uint64)[order], top.column(1).to_numpy()[order]))

    def distinct(group: pa.Table) -> pa.Table:
        found = [np.unique(sequence(texts)[1]) for chunk in group.column("_text").chunks for _, texts in U.slices(chunk, 8 * U.SLICE_BYTES)]
        u = np.setdiff1d(np.concatenate(found), known.value[0])
        return pa.table({"_block": pa.array(np.full(len(u), group.column("_block")[0].as_py()), pa.int64()), "h": u.view(np.int64)})

    met = dealt.groupBy("_block").applyInArrow(distinct, "_block long, h long").join(counts.select("h", "c"), "h")
    schema = dealt.select(*keep).schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = np.concatenate((known.value[0], right.column("h").to_numpy().view(np.uint64)))
        order = np.argsort(words)
        words, c = words[order], np.concatenate((known.value[1], right.column("c").to_numpy()))[order]
        model = sent.value
        parts = [log10_scores(model, texts, words, c) for chunk in left.column("_text").chunks for _, texts in U.slices(chunk)]
        cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0)] * 4
        cols.insert(2, np.full(len(left), model.vocabulary.total))
        types = [pa.int64()] * 3 + [pa.float64()] * 2
        return pa.table([*(left.column(k) for k in keep), *(pa.array(c).cast(t) for c, t in zip(cols, types))], names=schema.names)

    return dealt.groupBy("_block").cogroup(met.groupBy("_block")).applyInArrow(run, schema)


def fit_and_score(docs: DataFrame, teaches: Column, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count and train on the rows where ``teaches`` holds, then score every row."""
    taught = docs.where(F.coalesce(teaches, F.lit(False)))
    counts = U.stored(count_words(taught, text_col), "counts")
    model = train(taught, vocabulary(counts), id_col, text_col)
    U.settle(docs.sparkSession)
    return score(docs, model, counts, keep, text_col)
