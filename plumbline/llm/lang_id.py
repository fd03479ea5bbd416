"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Characters that are worked on at a time; longer texts go in pieces.
PIECE = 400_000
#: The fitted matrix is broadcast, so its size is checked.
MODEL_BYTES = 256 << 20


@lru_cache(1)
def _fold() -> np.ndarray:
    """Lower-case letter for each code point below 0x20000; 32 for what is no letter."""
    table = np.full(0x20000, 32, dtype=np.uint32)
    for i in range(0x20000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    fold = _fold()
    code = fold[np.minimum(raw, len(fold) - 1)]
    return np.where(raw >= len(fold), raw, code)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index of text, bucket) of all n-grams, a bounded number at a time. Runs of non-letters count as one space."""
    group: list[tuple[int, str]] = []
    held = 0
    for i, t in enumerate(texts):
        for at in range(0, len(t or ""), PIECE):
            group.append((i, t[at : at + PIECE]))
            held += len(group[-1][1])
            if held >= PIECE:
                yield _grams(group)
                group, held = [], 0
    if group:
        yield _grams(group)


def _grams(group: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    codes, owner = [], []
    for i, t in group:
        codes += [np.array([32], np.uint32), _codes(t), np.array([32], np.uint32)]
        owner.append(np.full(len(codes[-2]) + 2, i, np.int32))
    c, o = np.concatenate(codes), np.concatenate(owner)
    same = np.r_[False, (c[1:] == 32) & (c[:-1] == 32) & (o[1:] == o[:-1])]
    c, o = c[~same].astype(np.uint64), o[~same]
    who, what = [], []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + c[k : len(c) - n + 1 + k]
        ok = o[: len(h)] == o[n - 1 :]
        if n == 1:
            ok &= c != 32
        who.append(o[: len(h)][ok])
        what.append((mix(h[ok]) & np.uint64(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(who), np.concatenate(what)


class Model:
    """labels in ascending order, prior[label], weight[bucket, label]; all logarithms."""

    def __init__(self, labels: list[str], prior: np.ndarray, weight: np.ndarray):
        self.labels, self.prior, self.weight = labels, prior, weight

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        score = np.tile(self.prior, (len(texts), 1))
        for who, what in grams([t or "" for t in texts]):
            if len(who):
                at = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                np.add.at(score, who[at], np.add.reduceat(self.weight[what], at, axis=0, dtype=np.float64))
        top = score.argmax(1) if self.labels else np.zeros(len(texts), int)
        p = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1) if self.labels else np.zeros(len(texts))
        told = [bool(self.labels) and has_letter(t) for t in texts]
        return [self.labels[k] if ok else "und" for k, ok in zip(top, told)], np.where(told, p, 0.0)


def fit(docs: DataFrame, max_rows: int = 50_000, smoothing: float = 0.5) -> Model:
    """Learns from text and lang of docs where both are given.

    At most about max_rows rows, chosen by a hash of id and text, are counted (all of them where there are fewer): a documented
    bound, so that fitting costs the same at any size. Counting is distributed; the driver gets one row per label and bucket.
    Texts without letters add nothing. No rows give a model without labels.
    """
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    most = MODEL_BYTES // (4 * BUCKETS)
    if rows.select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} labels make a model that is too large to broadcast; use fewer buckets")
    total = rows.select("lang").count()
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(77)), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for who, what in grams(b.column(0).to_pylist()):
                cut = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else []
                for s, e in zip(cut, [*cut[1:], len(who)]):
                    c = seen.setdefault(langs[who[s]], np.zeros(BUCKETS, np.int64))
                    c += np.bincount(what[s:e], minlength=BUCKETS)
            for x in langs:
                n[x] = n.get(x, 0) + 1
        for x in n:
            c = seen.get(x, np.zeros(BUCKETS, np.int64))
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": [x] * (len(at) + 1), "bucket": np.r_[-1, at].astype(np.int32), "n": np.r_[n[x], c[at]]})

    got = bounded_batches(rows).select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(got.lang.unique())
    if not labels:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    counts = np.zeros((BUCKETS + 1, len(labels)))
    counts[got.bucket.to_numpy() + 1, np.searchsorted(labels, got.lang.to_numpy().astype(str))] = got.n.to_numpy()
    docs_of, c = counts[0], counts[1:] + smoothing
    return Model(labels, np.log(docs_of / docs_of.sum()), np.log(c / c.sum(0)).astype(np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred string and score double: the most probable label and its posterior probability.

    Only the text is an input. 'und' and 0.0 for null texts, texts without letters, or a model without labels; ties go to the
    first label in order. Other columns stay; existing columns lang_pred and score are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            label, p = sent.value.predict([x if isinstance(x, str) else None for x in t])
            yield pd.DataFrame({"lang_pred": label, "score": p})

    out = bounded_batches(docs).withColumn("__guess", guess(F.col(text)))
    return out.withColumns({"lang_pred": F.col("__guess.lang_pred"), "score": F.col("__guess.score")}).drop("__guess")
