"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text becomes words and runs of punctuation. Hashed into 2**BITS slots: each word, each pair of neighbours, each pair
and triple of neighbours' shapes (case, digits, the punctuation itself), and whether neighbours repeat. A feature's
value is the square root of its share of the text, so scores are sparse dot products that don't depend on length.
Training takes a bounded sample of labelled texts; scoring reads whole texts.

Defined results: null and empty texts have no features and get the intercept's score. Labels other than 0 and 1 and
labels of unknown documents are ignored; of several labels of one document the least counts. Without labels every score
is 0.5. Repeated rows each get a row; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 18
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MEMO_LIMIT = 500_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


def _shape(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return 16 + zlib.crc32(token[:4].encode("utf-8", "replace")) % 240
    if token.isdigit():
        return 1
    if token.isupper():
        return 2 if len(token) == 1 else 3
    if token.islower():
        return 4
    return 5 if token.istitle() else 6


class _Memo(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > _MEMO_LIMIT:
            self.clear()
        v = self[token] = (zlib.crc32(token.lower().encode("utf-8", "replace")) << 8) | _shape(token)
        return v


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * _M2
    x ^= x >> np.uint64(32)
    x *= _M1
    return x >> np.uint64(64 - BITS)


def features(text: str | None, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a whole text."""
    tokens = _TOKEN.findall(text) if text else []
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    code = np.fromiter(map(memo.__getitem__, tokens), np.uint64, n)
    word, shape = code >> np.uint64(8), code & np.uint64(255)
    slots = [_mix(word, 1)]
    if n > 1:
        same = (word[:-1] == word[1:]).astype(np.uint64)
        slots.append(_mix(word[:-1] * np.uint64(1_000_003) + word[1:], 2))
        slots.append(_mix((shape[:-1] * np.uint64(256) + shape[1:]) * np.uint64(2) + same, 3))
        if n > 2:
            slots.append(_mix((shape[:-2] * np.uint64(256) + shape[1:-1]) * np.uint64(256) + shape[2:], 4))
    slot, count = np.unique(np.concatenate(slots), return_counts=True)
    return slot.astype(np.int64), np.sqrt(count / n)


@dataclass
class QualityModel:
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None, memo: dict) -> float:
        slot, value = features(text, memo)
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[slot] @ value, -35, 35))))


def train(examples: list[tuple[str | None, int, float]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> QualityModel:
    """FTRL-proximal over (text, label, weight); the order is the one given."""
    size = 1 << BITS
    z, g2 = np.zeros(size), np.zeros(size)
    b_z = b_n = 0.0
    memo = _Memo()
    rows = [(*features(t, memo), y, w) for t, y, w in examples]

    def at(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    bias = 0.0
    for _ in range(epochs):
        for slot, value, y, weight in rows:
            w = at(z[slot], g2[slot])
            bias = -b_z / ((beta + np.sqrt(b_n)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(bias + w @ value, -35, 35)))
            g = (p - y) * weight
            gv = g * value
            sigma = (np.sqrt(g2[slot] + gv * gv) - np.sqrt(g2[slot])) / alpha
            z[slot] += gv - sigma * w
            g2[slot] += gv * gv
            s = (np.sqrt(b_n + g * g) - np.sqrt(b_n)) / alpha
            b_z += g - s * bias
            b_n += g * g
    return QualityModel(at(z, g2).astype(np.float32), float(-b_z / ((beta + np.sqrt(b_n)) / alpha)) if rows else 0.0)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 2048, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Train on ``per_label`` labelled documents of each label (all, if fewer), whole texts, weighted back to the labels' shares."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_y"))
    share = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    rows = common.bounded_sample(known, key, "_y", per_label, {})
    label_of = {r["_key"]: r["_y"] for r in rows}
    if not label_of:
        return train([])
    texts = docs.where(F.col(key).isin(list(label_of))).groupBy(key).agg(F.min(text).alias("_text")).orderBy(F.xxhash64(key), key).collect()
    found = {y: sum(label_of[r[key]] == y for r in texts) for y in share}
    total = sum(share[y] for y in share if found[y])
    weight = {y: share[y] / total * len(texts) / found[y] for y in share if found[y]}
    model = train([(r["_text"], label_of[r[key]], weight[label_of[r[key]]]) for r in texts])
    del texts
    common.give_back(docs.sparkSession)
    return model


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3, keep: list[str] | None = None, text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(*keep, *extra, score, predicted) for every row; predicted is 1 where score >= threshold."""
    common.python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    narrow = docs.select(*(keep or ["doc_id"]), F.col(text).alias("_scored_text"), *[c.alias(k) for k, c in (extra or {}).items()])

    def work():
        m, memo = QualityModel(*shared.value), _Memo()

        def compute(texts: list) -> list[pa.Array]:
            scores = [m.score(t, memo) for t in texts]
            return [pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())]

        return compute

    return common.map_column(narrow, "_scored_text", "score double, predicted int", work)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document's quality, learnt from the labels whose crc32(doc_id) mod 5 is not 0."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(common.crc_mod("doc_id", 5) != 0))
    return score(docs, model, extra={"held_out": F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False))})


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    common.python_ready(docs.sparkSession)
    shared, names = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept)), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = QualityModel(*shared.value), _Memo()
        at = names.index(text)
        for b in batches:
            yield b.filter(pa.array([m.score(t, memo) >= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
