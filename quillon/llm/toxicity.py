"""Toxicity by gradient-boosted trees over dense text features, calibrated isotonically.

Features: densities of two lexicons (words, and word beginnings, that labelled toxic
texts prefer), hits near second-person words, capitals, punctuation and obfuscation
rates.  The lexicons, the trees and the calibration are fitted on three disjoint parts
of at most ``sample_rows`` labelled rows, those of the lowest id hashes; only word
counts and one short feature row for each of them reach the driver.

Null and empty texts have all-zero features and get the score of such a row.  Rows
without a label, or with a null one, teach nothing; of several labels for one id the
largest counts.  With no labels, or one class only, the score is that class's share.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as U

#: Most labelled rows that a model is fitted on.
SAMPLE_ROWS = 20_000
#: Entries a lexicon may have, the least toxic texts an entry is in, and its least log-odds.
LEXICON = 2_000
LEAST_TEXTS = 4
LEAST_ODDS = 2.5
PREFIX = 4
NEAR = 5
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes ti tus su vosotros".split())
_WORD = re.compile(r"\w+")
_UPPER = bytes(range(65, 91))
_WIDE = re.compile(r"[^\x00-\x7f]")
_SIGNS = re.compile(r"[!?]")
_MANY = re.compile(r"[!?.]{2,}")
_STRETCHED = re.compile(r"([^\W\d])\1\1")
_HIDDEN = re.compile(r"(?<![^\W\d_])[^\W\d_]++[*@$#0-9][^\W_]*[^\W\d_]")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "#": None, "-": None, ".": None})
FEATURES = ("log_words", "hits", "hit_density", "weight", "max_weight", "prefix_hits", "prefix_density", "distinct_hits", "near_you", "you_density", "capitals", "all_caps", "signs", "many_signs", "stretched", "hidden", "hidden_hits")


@dataclass
class Lexicon:
    words: dict[str, float]
    prefixes: dict[str, float]


def _capitals(text: str) -> int:
    """Upper-case characters: A to Z as bytes, the others one by one."""
    b = text.encode("utf-8", "surrogatepass")
    return len(b) - len(b.translate(None, _UPPER)) + (0 if len(b) == len(text) else sum(map(str.isupper, _WIDE.findall(text))))


def features(text: str, lex: Lexicon) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    tokens = _WORD.findall(text.lower())
    n = len(tokens) or 1
    words, prefixes = lex.words, lex.prefixes
    at = [i for i, w in enumerate(tokens) if w in words or w[:PREFIX] in prefixes]
    direct = [tokens[i] for i in at if tokens[i] in words]
    begun = [tokens[i] for i in at if tokens[i][:PREFIX] in prefixes]
    weights = [max(words.get(tokens[i], 0.0), prefixes.get(tokens[i][:PREFIX], 0.0)) for i in at]
    near = sum(not SECOND_PERSON.isdisjoint(tokens[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
    you = sum(w in SECOND_PERSON for w in tokens)
    upper = _capitals(text)
    hidden = [m.translate(_PLAIN).lower() for m in _HIDDEN.findall(text)] if re.search(r"[*@$#0-9]", text) else []
    return [
        np.log1p(n),
        float(len(at)),
        len(at) / n,
        sum(weights) / n**0.5,
        max(weights, default=0.0),
        float(len(begun)),
        len(begun) / n,
        float(len(set(direct))),
        float(near),
        you / n,
        upper / len(text),
        0.0 if upper * 4 < len(text) else 1.0,
        len(_SIGNS.findall(text)) / n,
        len(_MANY.findall(text)) / n,
        len(_STRETCHED.findall(text)) / n,
        len(hidden) / n,
        float(sum(h in words or h[:PREFIX] in prefixes for h in hidden)),
    ]


# --- trees -------------------------------------------------------------------


@dataclass
class Boosted:
    """Depth-limited trees on binned features: node arrays for each tree, then a calibration."""

    prior: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature (-1: leaf), threshold, value
    depth: int
    xs: np.ndarray
    ys: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > threshold[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return np.interp(m, self.xs, self.ys) if len(self.xs) else 1 / (1 + np.exp(-m))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (midpoints, values) of the rising steps, for interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order], y[order]):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, t = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][2] += t
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0]) / (p[1]) for p in pools])


def fit_trees(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32) -> Boosted:
    """Second-order boosting of the logistic loss on quantile bins; calibrated on (cx, cy)."""
    share = float(y.mean()) if len(y) else 0.0
    if len(y) == 0 or share in (0.0, 1.0):
        return Boosted(0.0, [], depth, np.array([0.0]), np.array([share]))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    width = bins + 1
    flat = binned + np.arange(x.shape[1]) * width
    prior = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(y), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        size = 2 ** (depth + 1) - 1
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for k in range(2**depth - 1):
            rows = np.flatnonzero(node == k)
            if len(rows) < 20:
                continue
            idx = flat[rows].ravel()
            reps = x.shape[1]
            hg = np.bincount(idx, np.repeat(g[rows], reps), minlength=reps * width).reshape(reps, width)
            hh = np.bincount(idx, np.repeat(h[rows], reps), minlength=reps * width).reshape(reps, width)
            lg, lh = hg.cumsum(1), hh.cumsum(1)
            tg, th = lg[:, -1:], lh[:, -1:]
            gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
            gain[(lh < 0.5) | (th - lh < 0.5)] = 0
            for j, c in enumerate(cuts):
                gain[j, len(c) :] = 0
            j, b = divmod(int(gain.argmax()), width)
            if gain[j, b] <= 1e-6:
                continue
            feature[k], threshold[k] = j, cuts[j][b]
            node[rows] = 2 * k + 1 + (x[rows, j] > cuts[j][b])
        sg, sh = np.bincount(node, g, minlength=size), np.bincount(node, h, minlength=size)
        value = -rate * sg / (sh + 1)
        value[feature >= 0] = 0
        margin += value[node]
        trees.append((feature, threshold, value))
    model = Boosted(prior, trees, depth, np.empty(0), np.empty(0))
    if len(cy) and 0 < cy.mean() < 1:
        model.xs, model.ys = isotonic(model.margin(cx), cy)
    return model


# --- Spark -------------------------------------------------------------------


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosted

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t or "", self.lexicon) for t in texts], float).reshape(len(texts), len(FEATURES))
        return np.clip(self.trees.predict(x), 0.0, 1.0) if len(texts) else np.empty(0)


def _choose(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    scored = sorted(((float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))), w) for w, t, c in rows), key=lambda x: (-x[0], x[1]))
    return {w: s for s, w in scored if s >= LEAST_ODDS}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on ``labels`` (already restricted to the rows that may teach)."""
    spark = docs.sparkSession
    sample = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.max((F.col(label_col) == 1).cast("int")).alias("_y"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(sample_rows)
        .withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), id_col), F.lit(10)).cast("int"))
    )
    texts = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(text_col, "_y", "_part")  # broadcast: at most sample_rows short rows

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        docs_seen = Counter()
        for b in batches:
            rows = (x for lo, hi in U.spans(b.column(0)) for x in zip(*(c[lo:hi].to_pylist() for c in b.columns)))
            for t, y, part in rows:
                if part < 4:
                    ws = set(_WORD.findall((t or "").lower()))
                    seen[y].update(ws)
                    seen[y].update({"^" + w[:PREFIX] for w in ws})
                    docs_seen[y] += 1
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict(
            {"w": ["", *words], "t": pa.array([docs_seen[1], *(seen[1][w] for w in words)], pa.int64()), "c": pa.array([docs_seen[0], *(seen[0][w] for w in words)], pa.int64())}
        )

    counts = texts.mapInArrow(U.tidy(count), "w string, t long, c long").groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 1) / (F.col("c") + 1))
    top = counts.where((F.col("w") == "") | (F.col("t") >= LEAST_TEXTS)).orderBy((F.col("w") != ""), odds.desc(), "w").limit(2 * LEXICON).collect()
    toxic, clean = next(((r.t, r.c) for r in top if r.w == ""), (0, 0))
    entries = [(r.w, r.t, r.c) for r in top if r.w]
    lex = Lexicon(
        _choose([e for e in entries if e[0][0] != "^"], toxic, clean),
        _choose([(w[1:], t, c) for w, t, c in entries if w[0] == "^" and len(w) == PREFIX + 1], toxic, clean),
    )
    sent = spark.sparkContext.broadcast(lex)

    def measure(batches):
        for b in batches:
            ts, ys, parts = (c.to_pylist() for c in b.columns)
            keep = [i for i, p in enumerate(parts) if p >= 4]
            yield pa.RecordBatch.from_pydict(
                {
                    "x": pa.array([features(ts[i] or "", sent.value) for i in keep], pa.list_(pa.float64())),
                    "y": pa.array([ys[i] for i in keep], pa.int32()),
                    "part": pa.array([parts[i] for i in keep], pa.int32()),
                }
            )

    got = texts.mapInArrow(U.tidy(measure), "x array<double>, y int, part int").toArrow().to_pydict()  # at most sample_rows rows of 17 numbers
    x = np.array(got["x"], float).reshape(-1, len(FEATURES))
    y, part = np.array(got["y"], float), np.array(got["part"])
    order = np.lexsort((*x.T, y, part))  # the same whatever order the rows came in
    x, y, part = x[order], y[order], part[order]
    fit_on = part < 8
    return ToxicityModel(lex, fit_trees(x[fit_on], y[fit_on], x[~fit_on], y[~fit_on]))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``keep`` columns of every row and ``score_col`` double."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    if score_col in keep:
        raise ValueError(f"a column {score_col} is already there")
    extra = [] if text_col in keep else [text_col]
    src = docs.select(*keep, *extra)
    at = [*keep, *extra].index(text_col)
    schema = docs.select(*keep).schema.add(score_col, "double")

    def run(batches):
        for b in batches:
            for lo, hi in U.spans(b.column(at)):
                s = sent.value.scores(b.column(at)[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[: len(keep)]), pa.array(s, pa.float64())], schema.names)

    return src.mapInArrow(U.tidy(run), schema)
