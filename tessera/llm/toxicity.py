"""Toxicity scores: gradient-boosted trees over dense features, isotonic calibration.

Features of a text are densities of a general insult lexicon and of words and
word beginnings learned from labels, nearness of those to second-person words,
and rates of capitals, punctuation and obfuscation.  Nothing but the text
enters a score: not id, language, source or label.

Training takes at most ``sample_rows`` labelled rows (those with the smallest
hash of their id; a documented bound that does not grow with the data), reads
their whole texts in one pass behind a broadcast of their ids, and fits on the
driver.  Scoring is one pass over all documents with the model broadcast
(a few hundred kB): no shuffle of texts, no state besides.

Defined results: null and empty texts get the score of a text without any
sign; without labels of both kinds every score is 0; a document labelled
several times is toxic if any label says so; null labels count as none;
repeated rows get repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from tessera.llm.common import give_back, scan

INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers trash scum scumbag pathetic worthless disgusting clown clowns"
    " imbecile fool garbage filth vermin pig ugly hate jerk creep bastard bitch retard freak shut kill die"
    " idiota imbecil estupido estúpido basura asqueroso payaso inutil inútil tonto"
    " imbécile stupide crétin débile ordure dégoûtant connard salope abruti nul"
    " dumm dummkopf trottel abschaum wertlos ekelhaft widerlich versager müll arschloch".split()
)
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted vosotros vuestro".split())
LEET = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"\b(?=\w*[a-z])(?=\w*[0-9@$])[\w@$]+\b|(?<![\w.])(?:[a-z][.\-*_]){2,}[a-z]\b", re.IGNORECASE)
RUN = re.compile(r"(.)\1{3,}")
SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("held_out", BooleanType()),
    StructField("score", DoubleType()), StructField("predicted", IntegerType()),
])


def features(text: str, words_of: frozenset, starts_of: dict[int, frozenset]) -> list[float]:
    """Dense features of one whole text; 14 numbers whatever its length."""
    low = text.lower()
    words = WORD.findall(low)
    n = max(1, len(words))
    general = [k for k, w in enumerate(words) if w in INSULTS]
    learned = [k for k, w in enumerate(words) if w in words_of]
    begun = 0
    for size, starts in starts_of.items():
        begun += sum(w[:size] in starts for w in words)
    near, hits = 0, sorted({*general, *learned})
    if hits:
        you = [k for k, w in enumerate(words) if w in SECOND]
        at = np.searchsorted(you, hits) if you else []
        for h, a in zip(hits, at):
            near += (a < len(you) and you[a] - h <= 5) or (a > 0 and h - you[a - 1] <= 5)
    chars = max(1, len(text))
    odd = ODD.findall(text)
    hidden = sum(re.sub(r"[^a-z]", "", o.lower().translate(LEET)) in INSULTS for o in odd)
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    marks = text.count("!") + text.count("?")
    return [
        math.log1p(n), math.log1p(len(general)), len(general) / n, math.log1p(len(learned)), len(learned) / n,
        math.log1p(begun), begun / n, near / n, math.log1p(len(hits)), capitals / chars, marks / chars,
        (len(odd) - hidden) / n, hidden / n, len(RUN.findall(text)) / n,
    ]


def learn_lexicon(texts: list[str], y: np.ndarray, least: int = 6) -> tuple[frozenset, dict[int, frozenset]]:
    """Words and word beginnings that toxic documents hold far oftener than others."""
    pos, neg = Counter(), Counter()
    for t, label in zip(texts, y):
        found = set(WORD.findall(t.lower()))
        (pos if label else neg).update(found)
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))

    def strong(a, b, times):
        return a >= least and a / n1 >= times * (b + 0.5) / n0

    words = frozenset(w for w, a in pos.items() if len(w) > 2 and strong(a, neg[w], 12))
    starts: dict[int, frozenset] = {}
    taken: set[str] = set()
    for size in (4, 5, 6, 7):
        a, b = Counter(), Counter()
        for side, out in ((pos, a), (neg, b)):
            for w, c in side.items():
                if len(w) > size and w not in words | INSULTS:
                    out[w[:size]] += c
        new = {s for s, c in a.items() if strong(c, b[s], 12) and not any(s[:k] in taken for k in range(4, size))}
        taken |= new
        if new:
            starts[size] = frozenset(new)
    return words, starts


class Boosted:
    """Gradient-boosted trees on binned features, logistic loss."""

    def __init__(self, rounds=80, depth=3, rate=0.15, bins=48, least=8, ridge=1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        qs = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = []
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            both = np.concatenate([np.quantile(v, qs), np.quantile(x[:, j], qs)]) if len(v) > 1 else np.array([])
            self.cuts.append(np.unique(both))
        b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = math.log(rate / (1 - rate))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(b, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._run(tree, x)
        return self

    def _grow(self, b, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = self.rate * gs / (hs + self.ridge)
        best = (1e-6, None)
        if depth and len(rows) >= 2 * self.least:
            for j, c in enumerate(self.cuts):
                if not len(c):
                    continue
                k = b[rows, j]
                gl = np.bincount(k, g[rows], len(c) + 1).cumsum()[:-1]
                hl = np.bincount(k, h[rows], len(c) + 1).cumsum()[:-1]
                nl = np.bincount(k, minlength=len(c) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                t = int(gain.argmax())
                if gain[t] > best[0]:
                    best = (gain[t], (j, t))
        if best[1] is None:
            return leaf
        j, t = best[1]
        left = b[rows, j] <= t
        return (j, float(self.cuts[j][t]), self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1))

    def _run(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, a, b = tree
        return np.where(x[:, j] <= cut, self._run(a, x), self._run(b, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._run(t, x) for t in self.trees)

    def raw_one(self, v: list[float]) -> float:
        s = self.base
        for t in self.trees:
            while isinstance(t, tuple):
                t = t[2] if v[t[0]] <= t[1] else t[3]
            s += t
        return s


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and calibrated values of the blocks."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of labels, sum of scores
    for s, t in zip(score[order], y[order]):
        blocks.append([1.0, float(t), float(s)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            w, t2, s2 = blocks.pop()
            blocks[-1][0] += w
            blocks[-1][1] += t2
            blocks[-1][2] += s2
    return np.array([b[2] / b[0] for b in blocks]), np.array([(b[1] + 0.02) / (b[0] + 0.04) for b in blocks])


class Model:
    """Lexicon, trees and calibration, ready to broadcast."""

    def __init__(self, texts: list[str], y: np.ndarray):
        y = np.asarray(y, float)
        self.ready = 0 < y.sum() < len(y)
        if not self.ready:
            return
        self.words, self.starts = learn_lexicon(texts, y)
        x = np.array([features(t, self.words, self.starts) for t in texts])
        fold, out = np.arange(len(y)) % 3, np.zeros(len(y))
        for k in range(3):  # calibrate on scores that trees gave to rows they had not seen
            train = fold != k
            if 0 < y[train].sum() < train.sum():
                out[~train] = Boosted().fit(x[train], y[train]).raw(x[~train])
        self.at, self.value = isotonic(out, y)
        self.trees = Boosted().fit(x, y)

    def score(self, text: str) -> float:
        if not self.ready:
            return 0.0
        raw = self.trees.raw_one(features(text, self.words, self.starts))
        level = float(np.interp(raw, self.at, self.value))
        # a trace of the raw score keeps the order within a calibrated step
        return min(1.0, max(0.0, 0.999 * level + 0.001 / (1 + math.exp(-max(-30.0, min(30.0, raw))))))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, id_col="doc_id", text_col="text", label_col="toxic") -> Model:
    """Fit on at most ``sample_rows`` labelled documents, whole texts."""
    known = (
        labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_y")).where("_id is not null")
        .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    )
    rows = (
        docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t"))
        .join(F.broadcast(known), "_id")
        .groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))
    )
    found = sorted((r["_id"], r["_t"] or "", r["_y"]) for r in rows.collect())  # at most sample_rows
    return Model([t for _, t, _ in found], np.array([y for _, _, y in found]))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: one in five by CRC of its id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = docs.sparkSession.sparkContext.broadcast(
        train(docs, labels.where(~held_out(id_col)), sample_rows, id_col, text_col, label_col))

    def start():
        m = model.value

        def one(i, out, text):
            s = m.score(text or "")
            yield i, out, s, int(s >= 0.5)

        return one

    cols = [docs[id_col].cast("long"), held_out(id_col), docs[text_col].cast("string")]
    return scan(docs.select(*[c.alias(f"_{k}") for k, c in enumerate(cols)]), ["_0", "_1", "_2"], start, SCHEMA)


def reject(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, all columns kept.

    The verdict is computed beside the row in one pass, so rows with equal or
    null ids keep their own verdicts and no join is needed.
    """
    from pyspark.sql.types import StructType as S

    model = docs.sparkSession.sparkContext.broadcast(
        train(docs, labels.where(~held_out(id_col)), sample_rows, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                keep = [model.value.score(t or "") < 0.5 for t in part.column(at).cast(pa.string()).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))
            del b, part
        give_back()

    return docs.mapInArrow(run, S(docs.schema.fields))
