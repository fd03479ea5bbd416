"""Language identification and quality against plain re-computations, a text and a vote at a time."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lang_id, quality

from .test_operators import DATA, ODD


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# 3


def _grams(text):
    """Buckets of the n-grams of a text, a character at a time."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in (text or "")]
    chars = [" "]
    for c, x in zip(text or "", low):
        c = x if c.isalpha() else " "
        if c != " " or chars[-1] != " ":
            chars.append(c)
    if chars[-1] != " ":
        chars.append(" ")
    out = Counter()
    for n in lang_id.ORDERS:
        for k in range(len(chars) - n + 1):
            gram = chars[k : k + n]
            if gram == [" "]:
                continue
            h = n
            for c in gram:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> shift)) * factor % 2**64
            out[(h ^ (h >> 31)) % lang_id.BUCKETS] += 1
    return out


def _bayes(rows, texts):
    """Predictions for texts by naive Bayes over rows(text, lang)."""
    labels = sorted({lang for _, lang in rows})
    counts = {x: Counter() for x in labels}
    for t, lang in rows:
        counts[lang].update(_grams(t))
    total = {x: sum(counts[x].values()) + 0.5 * lang_id.BUCKETS for x in labels}
    n = Counter(lang for _, lang in rows)
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        score = np.array([np.log(n[x] / len(rows)) + sum(k * np.log((counts[x][g] + 0.5) / total[x]) for g, k in _grams(t).items()) for x in labels])
        p = np.exp(score - score.max())
        out.append((labels[int(score.argmax())], 1 / p.sum()))
    return out


def test_language_matches_brute_force(spark, docs):
    rows = [(r.text, r.lang) for r in docs.where("text is not null and lang is not null").limit(60).collect()]
    rng = random.Random(1)
    rows += [("aé Ñb", "x"), ("", "x"), ("İ ß ﬁ 123", "y")]
    texts = [*(t for t in ODD if t is None or len(t) < 5_000), "aé", "ñ b", "ﬁ İ", *(" ".join(rng.choice(t.split() or [""]) for _ in range(6)) for t, _ in rows)]
    made = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    got = lang_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lang_id.fit(made)).orderBy("doc_id").collect()
    for r, (label, p) in zip(got, _bayes(rows, texts), strict=True):
        assert r.lang_pred == label and abs(r.score - p) < 1e-3


def test_language_ties_and_odd_tables(spark):
    rows = spark.createDataFrame([(1, "abc", "b"), (2, "abc", "a"), (None, "abc", "a"), (None, "abc", "b"), (1, None, "a"), (1, "zz", None)], "doc_id long, text string, lang string")
    model = lang_id.fit(rows)
    one = lang_id.predict(rows.withColumn("lang_pred", F.lit("own")), model)
    assert sorted(one.columns) == ["doc_id", "lang", "lang_pred", "score", "text"] and {(r.lang_pred, r.score) for r in one.where("text = 'abc'").collect()} == {("a", 0.5)}
    assert lang_id.predict(rows.limit(0), model).count() == 0
    same = spark.createDataFrame([(None, f"text {k}", "a" if k % 2 else "b") for k in range(400)], "doc_id long, text string, lang string")
    assert lang_id.fit(same, max_rows=40).labels == ["a", "b"]  # rows without ids are sampled by their texts


def test_language_of_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "MODEL_BYTES", 4 * lang_id.BUCKETS * 5)
    rows = spark.createDataFrame([(k, "abc", f"l{k}") for k in range(6)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        lang_id.fit(rows)
    assert len(lang_id.fit(rows.where("doc_id < 5")).labels) == 5


# 8


def _shares(text):
    """The labellers' shares of a text and its words, a byte and a word at a time."""
    raw = (text or "").encode()
    words = raw.split()
    letter = lambda b: chr(b).isalnum() and b < 128 or b >= 128
    symbol = lambda b: not letter(b) and b not in (0x20, *range(9, 14))
    n_upper, n_lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    threes = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    odd = Counter(b for b in raw if symbol(b) and b not in b".,")
    part = lambda a, b: a / max(b, 1)
    return [
        part(sum(map(symbol, raw)), len(raw)),
        part(n_upper, n_upper + n_lower),
        part(sum(a == b for a, b in zip(words, words[1:])), len(words) - 1),
        1 - len(set(threes)) / len(threes) if threes else 0.0,
        part(sum(any(a == b and symbol(a) for a, b in zip(w, w[1:])) for w in words), len(words)),
        part(sum(len(w) == 1 and symbol(w[0]) for w in words), len(words)),
        part(max(odd.values(), default=0), len(raw)),
    ], len(words)


def _votes(share, n):
    out = []
    for s, (bad, good) in zip(share, quality.LABELLERS.values()):
        if n < quality.FEW_WORDS:
            out.append(2)
        else:
            out.append(0 if s > bad else 1 if s < good else 2)
    return out


def test_quality_votes_match_brute_force(docs):
    texts = [r.text for r in docs.collect()] + [t for t in ODD if t is None or len(t) < 40_000] + ["a | b | c |", "| |", "|", "!! ?? ..", "ok fine"]
    share, n = zip(*((s, k) for s, k, _, _ in quality.statistics(texts)))
    share, n = np.concatenate(share), np.concatenate(n)
    want = [_shares(t) for t in texts]
    assert n.tolist() == [k for _, k in want] and np.allclose(share, [s for s, _ in want])
    assert quality.votes(share, n).tolist() == [_votes(s, k) for s, k in want]


def _expect(votes, rounds=100):
    """Expectation-maximisation over single texts' votes, from the same start and with the same weak priors."""
    m = len(votes[0])
    start = {0: (0.5, 0.02), 1: (0.3, 0.9), 2: (0.2, 0.08)}
    base = [[[5 * start[v][c] for c in (0, 1)] for _ in range(m)] for v in range(3)]
    prior, p = 0.8, [[[start[v][c] for c in (0, 1)] for _ in range(m)] for v in range(3)]
    for k in range(rounds):
        good = []
        for own in votes:
            if not k:
                good.append(0.1 if 0 in own else 0.98)
                continue
            one, two = 1 - prior, prior
            for j, v in enumerate(own):
                one, two = one * p[v][j][0], two * p[v][j][1]
            good.append(two / (one + two))
        p = [[[base[v][j][c] + sum(g if c else 1 - g for g, own in zip(good, votes) if own[j] == v) for c in (0, 1)] for j in range(m)] for v in range(3)]
        for j in range(m):
            for c in (0, 1):
                total = sum(p[v][j][c] for v in range(3))
                for v in range(3):
                    p[v][j][c] /= total
            over = max(p[0][j][1] - quality.FALSE_ALARMS, 0)
            p[0][j][1] -= over
            p[1][j][1] += over
        prior = (sum(good) + 4) / (len(votes) + 5)
    return prior, p


def test_label_model_matches_brute_force():
    rng = random.Random(5)
    truth = [rng.random() < 0.8 for _ in range(300)]
    votes = [[rng.choices((0, 1, 2), (2, 90, 8) if good else (50, 30, 20))[0] for _ in range(4)] for good in truth]
    seen = Counter(map(tuple, votes))
    model = quality.estimate(np.array(list(seen)), np.array(list(seen.values()), float))
    prior, p = _expect(votes)
    assert abs(model.prior - prior) < 1e-6 and np.allclose(model.p, p, atol=1e-6)
    got = model.posterior(np.array(votes))
    for own, g in zip(votes, got):
        one = (1 - prior) * np.prod([p[v][j][0] for j, v in enumerate(own)])
        two = prior * np.prod([p[v][j][1] for j, v in enumerate(own)])
        assert abs(g - two / (one + two)) < 1e-6
    assert np.mean((got > 0.5) == truth) > 0.9


def test_scorer_is_where_the_loss_is_least():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 6)).astype(np.float32)
    y = 1 / (1 + np.exp(-(x @ np.array([2, -1, 0, 0.5, 0, 0]))))
    s = quality._train(x, y, rounds=2_000)
    error = 1 / (1 + np.exp(-(x @ s.weight + s.bias))) - y
    assert np.abs(x.T @ error / len(y) + 1e-4 * s.weight).max() < 1e-3


def test_quality_of_odd_tables(spark, docs):
    rows = spark.createDataFrame([(None, t) for t in ODD] * 2, "doc_id long, text string").withColumns({"score": F.lit("own"), "accepted": F.lit(3)})
    got = quality.classify(rows)
    assert got.columns == rows.columns and got.count() == rows.count() and len({(r.text, r.score) for r in got.collect()}) == len(ODD)
    many = docs.select(F.lit(7).cast("long").alias("doc_id"), "text")  # one id for all: the sample is of texts
    scorer, _ = quality.fit(many, sample_rows=20)
    assert np.abs(scorer.weight).sum() > 0


def test_pipeline_stages_on_odd_tables(spark, docs):
    import corpus_pipeline as p

    rows = docs.limit(40).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "a b c d e f g h i j", "en", None, 3), (900, "", "en", "s", 0), (900, "", "en", "s", 0), (901, "word " * 50_000, None, "s", None), (902, "Some words that stand here twice over", "en", "s", 1), (902, "Some words that stand here twice over", "en", "s", 1)], docs.schema))
    clash = rows.withColumns({"score": F.lit("own"), "n_lines": F.lit(1), "kept": F.lit(True), "n_hit": F.lit("x"), "items": F.lit(2)})
    for k, (name, stage) in enumerate(p.STAGES):
        for table in (rows, clash, rows.limit(0)):
            out = stage(spark, table, DATA)
            got = out.collect()
            assert len(got) <= table.count(), name
            if k < len(p.STAGES) - 1:
                assert out.columns == table.columns, name
        twice = {r.doc_id: 0 for r in got}
        assert not twice  # an empty table stays empty
    encoded = p.STAGES[-1][1](spark, rows, DATA)
    assert encoded.count() == rows.count() and {tuple(r)[1] for r in encoded.where("doc_id = 900").collect()} == {0}
    kept = p.STAGES[2][1](spark, rows, DATA).collect()
    assert sum(r.doc_id == 902 for r in kept) == 2 and sum(r.doc_id is None for r in kept) == 2
