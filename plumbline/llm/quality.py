"""Document quality: a weak-label model over heuristic labellers, whose posteriors train a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, lean, materialise, mix
from .words import packs, words

#: Each labeller votes bad above the first bound, good below the second, and abstains between and on texts of few words.
LABELLERS = {
    "symbols": (0.12, 0.07),  # share of characters that are neither letters, digits nor blanks
    "upper": (0.30, 0.15),  # share of the ASCII letters that are capitals
    "repeats": (0.20, 0.05),  # share of words that equal the word before
    "cycles": (0.50, 0.25),  # share of three-word windows that occurred before
    "doubled": (0.20, 0.05),  # share of words with the same symbol twice in a row
    "separators": (0.15, 0.05),  # share of words that are a single symbol
    "one_symbol": (0.03, 0.015),  # share of characters that are the text's most frequent symbol but for full stops and commas
}
FEW_WORDS = 8
DIM = 1 << 12
_BINS = 12

_CLASS = np.full(256, 2, np.uint8)  # letters, and all bytes of non-ASCII characters
_CLASS[:128] = 8 + np.arange(128) % 24
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3


def _share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return count / np.maximum(of, 1)


def _sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[end] - total[start]


def statistics(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For a group of texts at a time: the labellers' shares [text, labeller], word counts, character classes, offsets."""
    for _, buf, offsets in packs(texts):
        raw = np.frombuffer(buf + b"\n", np.uint8)
        cls = _CLASS[raw]
        h, start, end = words(buf)
        s, e = offsets[:-1], offsets[1:] - 1
        ws, we = np.searchsorted(start, offsets[:-1]), np.searchsorted(start, offsets[1:])
        symbol = cls >= 8
        twin = np.r_[False, (raw[1:] == raw[:-1]) & symbol[1:]]
        n = we - ws
        same = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
        three = mix(h[:-2] + mix(h[1:-1] + mix(h[2:]))) if len(h) > 2 else np.zeros(0, np.uint64)
        cycles = np.array([1 - len(np.unique(w)) / len(w) if len(w := three[a : max(a, b - 2)]) else 0.0 for a, b in zip(ws, we)])
        doubled = _sums(twin, start, end) > 0 if len(h) else np.zeros(0, bool)
        lone = symbol[start] & (end - start == 1) if len(h) else np.zeros(0, bool)
        upper = _sums(cls == 1, s, e)
        odd = symbol & (raw != ord(".")) & (raw != ord(","))
        at, owner = raw[odd], np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1
        top = np.bincount(owner * 128 + at, minlength=128 * len(s))[: 128 * len(s)].reshape(-1, 128).max(1)
        share = np.column_stack([
            _share(_sums(symbol, s, e), e - s),
            _share(upper, upper + _sums((raw >= 97) & (raw <= 122), s, e)),
            _share(_sums(same, np.minimum(ws + 1, we), we), n - 1),  # a text's first word has none before it
            cycles,
            _share(_sums(doubled, ws, we), n),
            _share(_sums(lone, ws, we), n),
            _share(top, e - s),
        ])
        yield share, n, cls, offsets


def votes(share: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """0 bad, 1 good, 2 abstains: [text, labeller]."""
    bad, good = np.array(list(LABELLERS.values())).T
    v = np.where(share > bad, 0, np.where(share < good, 1, 2))
    v[n_words < FEW_WORDS] = 2
    return v


def features(share: np.ndarray, cls: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each text: (index, value). N-grams of character classes, of length 1 in all, and a bin per share."""
    c = cls.astype(np.uint64)
    grams = []
    for n in (1, 2, 3):
        h = np.full(max(len(c) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(41) + c[k : k + len(h)]
        grams.append((mix(h) & np.uint64(DIM - 1)).astype(np.int64))
    bins = np.minimum((np.sqrt(share) * _BINS).astype(np.uint64), np.uint64(_BINS - 1))
    own = (mix(bins + np.arange(share.shape[1], dtype=np.uint64) * np.uint64(64) + np.uint64(1 << 32)) & np.uint64(DIM - 1)).astype(np.int64)
    for i, (s, e) in enumerate(zip(offsets[:-1], offsets[1:] - 1)):
        x = np.zeros(DIM)
        for n, g in enumerate(grams):
            if e - s > n:
                x += np.bincount(g[s : e - n], minlength=DIM)
        x = np.sqrt(x)
        x /= max(np.sqrt((x * x).sum()), 1e-9)
        np.add.at(x, own[i], 0.5)
        x *= (e - s) / (e - s + 100)  # short texts say little, so the bias decides
        at = np.flatnonzero(x)
        yield at, x[at]


@dataclass
class LabelModel:
    """prior of good; p[vote, labeller, class]: how often a labeller gives each vote to bad and good texts."""

    prior: float
    p: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(pattern), 1))
        for j in range(pattern.shape[1]):
            log += np.log(self.p[pattern[:, j], j])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


#: Labellers are built to be precise: none is taken to call more than this share of good texts bad.
FALSE_ALARMS = 0.002


def estimate(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and their counts, with weak priors that keep it defined on few texts."""
    m = pattern.shape[1]
    p = np.empty((3, m, 2))
    p[:, :, 0], p[:, :, 1] = np.array([0.5, 0.3, 0.2])[:, None], np.array([0.02, 0.9, 0.08])[:, None]
    base, model = p * 5, LabelModel(0.8, p)
    for k in range(rounds):
        # It starts from the vote of any labeller, as kinds of bad texts are told by different ones.
        good = model.posterior(pattern) if k else np.where((pattern == 0).any(1), 0.1, 0.98)
        w = np.stack([(1 - good) * count, good * count])
        p = np.array([[[w[c][pattern[:, j] == v].sum() for c in (0, 1)] for j in range(m)] for v in range(3)]) + base
        p /= p.sum(0)
        over = np.maximum(p[0, :, 1] - FALSE_ALARMS, 0)
        p[0, :, 1] -= over
        p[1, :, 1] += over
        model = LabelModel((w[1].sum() + 4) / (w.sum() + 5), p)
    return model


@dataclass
class Scorer:
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of good; 0 for null and blank texts."""
        out = []
        for share, n, cls, offsets in statistics(texts):
            z = [v @ self.weight[at] + self.bias for at, v in features(share, cls, offsets)]
            out.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0))
        return np.concatenate(out) if out else np.zeros(0)


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by accelerated gradient steps. The bias stays at the labels' mean, so texts of few features get that."""
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    back, rate = w.copy(), 4.0 / max(1.0, float((x * x).sum(1).mean()))
    for k in range(rounds):
        v = w + k / (k + 3) * (w - back)
        g = (1 / (1 + np.exp(-np.clip(x @ v + b, -50, 50))) - y).astype(np.float32) / len(y)
        back, w = w, v - rate * (x.T @ g + decay * v)
    return Scorer(w.astype(np.float64), b)


def fit(docs: DataFrame, sample_rows: int = 4_000) -> tuple[Scorer, LabelModel]:
    """The scorer and the label model of docs(doc_id, text).

    Votes are counted over all texts; the label model needs only the count of each vote pattern (at most 3^7). The scorer is
    trained on posterior labels of a sample of about sample_rows texts, chosen by a hash of id and text, and of twice as many at
    most: a documented bound on what reaches the driver. Null and blank texts are left out. Without texts every non-blank text is good.
    """
    rows = docs.where("text is not null").select("doc_id", "text")
    rate = int((1 << 30) * min(1.0, sample_rows / max(1, docs.select("doc_id").count())))
    rows = rows.select("text", (F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(5)), F.lit(1 << 30)) < rate).alias("chosen"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            yield from counted(batches)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(3 ** len(LABELLERS), np.int64)
        power = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            code, at, value = [], [], []
            chosen, done = batch.column(1).to_numpy(zero_copy_only=False), 0
            for share, n, cls, offsets in statistics(batch.column(0).to_pylist()):
                own = votes(share, n) @ power
                seen += np.bincount(own[n > 0], minlength=len(seen))
                pick = chosen[done : done + len(n)] & (n > 0)
                if pick.any():
                    for ok, k, (i, v) in zip(pick, own, features(share, cls, offsets)):
                        if ok:
                            code.append(int(k))
                            at.append(i.astype(np.int32).tobytes())
                            value.append(v.astype(np.float32).tobytes())
                done += len(n)
            if code:
                yield pa.RecordBatch.from_pydict({"code": pa.array(code, pa.int32()), "n": pa.nulls(len(code), pa.int64()), "at": at, "value": value})
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"code": k.astype(np.int32), "n": seen[k], "at": pa.nulls(len(k), pa.binary()), "value": pa.nulls(len(k), pa.binary())})

    got = materialise(rows.mapInArrow(vote, "code int, n long, at binary, value binary"), "votes")
    patterns = got.where("n is not null").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    # Copies of one row share their hash, so the sample is bounded by number as well.
    sample = got.where("n is null").select("code", "at", "value").orderBy(F.xxhash64("at", "value"), "code").limit(2 * sample_rows).toPandas().sort_values(["code", "at", "value"])
    discard(got)

    def decode(code: pd.Series) -> np.ndarray:
        return code.to_numpy().astype(int)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3

    model = estimate(decode(patterns.code), patterns.n.to_numpy().astype(float))
    if not len(sample):
        return Scorer(np.zeros(DIM), 1.0), model
    x = np.zeros((len(sample), DIM), np.float32)
    for i, (a, v) in enumerate(zip(sample["at"], sample["value"])):
        x[i, np.frombuffer(a, np.int32)] = np.frombuffer(v, np.float32)
    return _train(x, model.posterior(decode(sample.code))), model


def classify(docs: DataFrame, scorer: Scorer | None = None, threshold: float = 0.5) -> DataFrame:
    """docs with score double and accepted boolean (score >= threshold); fits a scorer on docs where none is given.

    Null and blank texts get 0.0 and are rejected. An empty table stays empty. Other columns stay as they are; existing
    columns score and accepted are replaced.
    """
    docs = bounded_batches(docs)
    scorer = scorer or fit(docs)[0]
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with lean():
            for t in texts:
                yield pd.Series(sent.value.score([x if isinstance(x, str) else None for x in t]), dtype="float64")

    return docs.withColumn("score", score(F.col("text"))).withColumn("accepted", F.col("score") >= threshold)
