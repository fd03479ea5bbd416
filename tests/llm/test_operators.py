import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontam, embed_dedup, graph, lang_id, line_dedup, minhash, pii, quality, token_store, url_filter

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "é🙂", "a", "a b c", "x" * 50_000, "the of and " * 3_000, " \n\n  x\ty ", "a\x00b", "!!! ???"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, "own") for i, t in enumerate(ODD)] + [(None, None, None, None, None), (3, "\n", "en", None, "own"), (3, "\n", "en", None, "own")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def _union(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_by_rounds_and_at_once(spark, monkeypatch):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    want = {k: v for k, v in _union(pairs, {x for p in pairs for x in p}).items()}
    for limit in (graph.LOCAL_EDGES, 0):
        monkeypatch.setattr(graph, "LOCAL_EDGES", limit)
        got = {r.id: r.component for r in graph.components(spark.createDataFrame([*pairs, (5, 5), (None, 7)], "a long, b long")).collect()}
        assert got == {k: want[k] for k in got}
        assert {k for k in want if want[k] != k} <= set(got)


# 1


def _brute_pii(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def ok(k, t):
        digits = re.sub("[^0-9]", "", t)
        if k == "card":
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and luhn % 10 == 0
        return all(int(x) <= 255 for x in t.split(".")) if k == "ip" else 9 <= len(digits) <= 15 if k == "phone" else True

    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(k, m[0]))


def test_pii_matches_brute_force(spark, odd):
    rng = random.Random(3)
    alphabet = "ab.@-+ (1) 2 3 4 5.6 \n🙂é_%9"
    texts = [*ODD, "a@b.c_x@d.e a@b.c@d.e", "+12 +1----- +123456789", "4242 4242 4242 4242", "4" * 400, "1.2.3.4.5.6.7.8 010.0.0.255 1.1.1.256", "a" * 20_000 + "@b.cc"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(800)]
    texts += ["call contact foo@bar.com", "contact x@y.zz please"] * 8 + ["nothing here"] * 100
    got = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        base = _brute_pii(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[3] == k for b in base) for k in pii.KINDS]
        assert [x for x in r.spans.split(",") if x and x[:4] not in ("term", "secr")] == [f"{k}:{s}:{e}" for s, _, e, k in base]
    clean = {r.text: r.clean for r in got}
    assert "contact" not in clean["call contact foo@bar.com"] and clean["call contact foo@bar.com"].endswith("[EMAIL]")
    assert clean["nothing here"] == "nothing here" and clean[None] is None


def test_pii_terms_beside_entities_and_far_from_them(spark):
    texts = ["Mr Keller\nmail keller@x.com\n\nuntil then"] * 6 + ["Today Keller rang, KELLER too"] * 9 + ["Kellerman\nfair weather\nuntil then"] * 200 + [None, ""]
    got = pii.sanitise(spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    clean, spans = {r.text: r.clean for r in got}, {r.text: r.spans for r in got}
    assert clean[texts[0]] == "Mr [EMAIL TERM]\n [EMAIL]\n\nuntil then" and spans[texts[0]] == "term:3:9,term:10:14,email:15:27"
    assert clean[texts[6]] == "Today [EMAIL TERM] rang, [EMAIL TERM] too" and spans[texts[6]] == "term:6:12,term:19:25"
    assert all(clean[t] == t for t in (texts[20], None, ""))


def _brute_terms(texts, support, disclosure, removal):
    """Of each disclosing term: what it becomes."""
    kinds = pii.PROTECTED
    lines, n_kind, n_term, both = 0, {}, {}, {}
    for t in (x for x in texts if x is not None):
        spans = [*_brute_pii(t), *((m.start(), 9, m.end(), "secret") for m in _SECRET.finditer(t))]
        chars, marks = list(t), [set() for _ in t]
        for a, _, b, k in spans:
            chars[a:b] = " " * (b - a)
            for i in range(a, b):
                marks[i].add(k)
        blank, own, at = "".join(chars).split("\n"), [], 0
        for x in blank:
            own.append(set().union(*marks[at : at + len(x)]))
            at += len(x) + 1
        lines += len(blank)
        plain = t.split("\n")
        for i, x in enumerate(blank):
            near = own[i] | (own[i - 1] if i else set()) | (own[i + 1] if i + 1 < len(own) else set())
            events = [*own[i], *(f"{k}_near" for k in near)]
            for k in events:
                n_kind[k] = n_kind.get(k, 0) + 1
            for w in {w.lower() for w in re.findall(r"[^\W\d_]{3,}", x)}:
                for k in events:
                    both[w, k] = both.get((w, k), 0) + 1
            for w in {w.lower() for w in re.findall(r"[^\W\d_]{3,}", plain[i])}:
                n_term[w] = n_term.get(w, 0) + 1
    shares = {}
    for (w, k), n in both.items():
        if n >= support and n_kind[k] < lines:
            share = np.log2(n * lines / (n_term[w] * n_kind[k])) / np.log2(lines / n_kind[k])
            if share >= disclosure:
                shares.setdefault(w, []).append((share, k))
    return {w: "" if max(x)[0] >= removal else f"[{max(x)[1].removesuffix('_near').upper()} TERM]" for w, x in shares.items()}


_SECRET = re.compile(r"""(?<![A-Za-z0-9])(?i:api[_-]?key|access[_-]?key|secret|token|password|passwd)["']?[ \t]{0,3}[:=][ \t]{0,3}["']?(?=[^\s"']{0,80}[0-9])[^\s"']{8,}["']?""")


def test_pii_terms_match_brute_force(spark):
    rng = random.Random(12)
    words = ["alpha", "Bravo", "CHARLIE", "délta", "echo", "fox", "golf", "hotel", "ab", "india"]
    things = {"alpha": "a.b@c.de", "Bravo": "10.0.0.7", "délta": "+49 30 1234567", "echo": 'token = "12ab34cd56ef"', "golf": "4242 4242 4242 4242"}

    def line():
        w = [rng.choice(words) for _ in range(rng.randint(0, 3))]
        return " ".join([*w, *(things[x] for x in w if x in things and rng.random() < 0.6)])

    texts = ["\n".join(line() for _ in range(rng.randint(1, 4))) for _ in range(250)] + ["nothing of note"] * 300 + [None, ""]
    for support, disclosure, removal in ((5, 0.5, 0.8), (3, 0.2, 0.4)):
        want = _brute_terms(texts, support, disclosure, removal)
        got = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), support, disclosure, removal).collect()
        assert want and len(got) == len(texts)
        for r in got:
            spans = sorted([*((a, 0, b, k) for a, _, b, k in _brute_pii(r.text)), *((m.start(), 0, m.end(), "secret") for m in _SECRET.finditer(r.text or ""))])
            chars = list(r.text or "")
            for a, _, b, _ in spans:
                chars[a:b] = " " * (b - a)
            terms = [(m.start(), 1, m.end(), "term", want[m[0].lower()]) for m in re.finditer(r"[^\W\d_]{3,}", "".join(chars)) if m[0].lower() in want]
            told = sorted([*spans, *terms])
            assert r.spans == ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in told)
            clean, at = "", 0
            for x in told:
                clean += r.text[at : x[0]] + (x[4] if x[3] == "term" else f"[{x[3].upper()}]")
                at = x[2]
            assert (r.clean or "") == clean + (r.text or "")[at:] and r.clean_sha256 == hashlib.sha256((r.clean or "").encode()).hexdigest()
            assert r.n_private == len(spans) and r.n_secret == sum(x[3] == "secret" for x in spans)


def test_pii_of_odd_tables(spark, odd, none):
    got = pii.sanitise(odd.withColumns({"n_ip": F.lit("own"), "clean": F.lit(1)}))
    assert sorted(got.columns) == sorted([*odd.columns, *pii.RESULTS]) and got.count() == odd.count() and pii.sanitise(none).count() == 0
    same = [tuple(r) for r in got.where("doc_id = 3").drop("lang", "source").collect()]
    assert len(same) == 3 and len(set(same)) == 1
    assert [r.clean for r in got.where("doc_id is null").collect()] == [None]


def test_pii_of_texts_with_very_many_spans(spark):
    import time

    texts = [" ".join(f"u{i}@h{i}.org" for i in range(n)) for n in (5_000, 20_000)]
    times = []
    for t in [texts[0], *texts]:
        began = time.time()
        r = pii.sanitise(spark.createDataFrame([(1, t)], "doc_id long, text string")).select("n_email", "clean").first()
        times.append(time.time() - began)
        assert r.n_email == t.count("@") and r.clean == " ".join(["[EMAIL]"] * r.n_email)
    assert times[2] < 8 * times[1] + 5  # the first call compiles


def test_pii_overlapping_spans_go_together(spark):
    df = spark.createDataFrame([("0123456789" * 600,)], "t string").withColumn("x", F.expr("array(named_struct('s', 2, 'e', 7), named_struct('s', 5, 'e', 9), named_struct('s', 9, 'e', 9), named_struct('s', 2040, 'e', 2060), named_struct('s', 4000, 'e', 5990))"))
    t = "0123456789" * 600
    assert df.select(pii.replaced(F.col("t"), F.col("x"), lambda c: F.lit("#")).alias("y")).first().y == t[:2] + "#" + "#" + t[9:2040] + "#" + t[2060:4000] + "#" + t[5990:]


# 2


@pytest.mark.parametrize("block", [1024, 7])
def test_embeddings_match_brute_force(spark, block):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.02 * rng.standard_normal((20, 16)), base[:1] + 0.01 * rng.standard_normal((40, 16)), base[:5], base[:3] * 7])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want = _union([(int(a), int(b)) for a, b in np.argwhere(near)], range(len(u)))
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [1.0, 2.0]), (906, [float("inf")] * 16), (None, x[0].tolist())]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"), block=block).collect()
    by = {r.vec_id: r for r in got}
    assert len(got) == len(rows) + len(bad)
    for i in range(len(u)):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (int(near[i].sum()), want[i], want[i] == i)
    for i, _ in bad[:-1]:
        assert tuple(by[i]) == (i, 0, i, True)
    assert tuple(by[None]) == (None, 0, None, True)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_vectors(empty).count() == 0


# 3


def test_language_on_held_out_rows(docs, odd, none):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = lang_id.fit(docs.where(~held))
    got = lang_id.predict(docs.where(held), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)
    by = {r.text: r for r in lang_id.predict(odd, model).collect()}
    assert all(by[t].lang_pred == "und" and by[t].score == 0 for t in (None, "", " ", "\n", "!!! ???")) and by["é🙂"].lang_pred in model.labels
    empty = lang_id.fit(none)
    assert empty.labels == [] and {r.lang_pred for r in lang_id.predict(odd, empty).collect()} == {"und"}


# 4


def _tiktoken():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def test_bpe_equals_the_library(docs, odd):
    path, library = _tiktoken()
    rng = random.Random(1)
    alphabet = "ab cde'stll  \n\t1234é漢字🙂\u00a0\u3000\x1c!?.ABC re've"
    texts = ["" if t is None else t for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(2_000)]
    assert bpe.codec(path, public_tokenizers.PATTERN).ids(pa.array(texts)).to_pylist() == [library.encode_ordinary(t) for t in texts]
    for r in bpe.digests(docs.unionByName(odd.drop("score").withColumn("n_chars", F.lit(0))), path, public_tokenizers.PATTERN).collect():
        ids = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert all(r.decoded == (r.text or "") for r in back.collect())


def test_bpe_of_very_long_texts_in_parts(docs, monkeypatch):
    from plumbline.llm import pieces

    path, library = _tiktoken()
    text = " ".join(r.text or "" for r in docs.limit(60).collect()) + "  x\n\ny \t" + "z" * 3_000 + " end of it "
    monkeypatch.setattr(pieces, "LONG", 1_000)
    monkeypatch.setattr(bpe, "MANY", 700)
    c = bpe.Codec(path, public_tokenizers.PATTERN)
    want = library.encode_ordinary(text)
    for t in (text, "a b " * 2_000, "no cut" + "é" * 5_000):
        ids = library.encode_ordinary(t)
        assert c.ids(pa.array([t])).to_pylist() == [ids] and "".join(pieces.parts(t, 1_000)) == t
        assert c.digests(pa.array([t])) == ([len(ids)], [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()], [hashlib.sha256(t.encode()).hexdigest()])
    assert len(list(pieces.parts(text, 1_000))) > 20 and len(want) > 700


def test_bpe_under_another_pattern():
    """A pattern whose matches run across blanks and line feeds, and ranks with tokens of several words."""
    import tiktoken

    pattern = r"[^\s\p{L}]+[\r\n]*|\p{L}+ ?|\s+"
    ranks = {bytes([i]): i for i in range(256)} | {b"!\n": 256, b"a ": 257, b"ba ": 258, b"b ": 259, b"!\n\n": 260}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab !\n") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    own = bpe.Codec.__new__(bpe.Codec)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe, "load_ranks", lambda path: ranks)
        own.__init__("", pattern)
    assert own.ids(pa.array(texts)).to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_bpe_of_ranks_that_no_training_gives():
    """Tokens that never arise, and parts of higher ranks than the whole."""
    rng = random.Random(6)
    for _ in range(30):
        words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(25)}
        order = rng.sample(sorted(words), len(words))
        ranks = {bytes([i]): i for i in range(256)} | {w: 256 + k for k, w in enumerate(order)}
        b = bpe.BPE(ranks)
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(60)]
        for p in pieces:
            try:
                slow = [ranks[p]] if p in ranks else b.walk(b.last_tokens(p, []))
            except ValueError:
                slow = None  # no prefix token, which training rules out
            if slow is not None:
                ids, _ = b.encode_all(np.frombuffer(p, np.uint8), np.array([0, len(p)]))
                assert ids.tolist() == slow


def test_bpe_prefixes_under_edits():
    path, _ = _tiktoken()
    b = bpe.codec(path, public_tokenizers.PATTERN).bpe
    rng = random.Random(5)
    p = bpe.Prefixes(b, b"internationalisation" * 8)
    for _ in range(60):
        at = rng.randrange(len(p.data) - 4)
        steps = p.replace(at, at + rng.randrange(4), bytes(rng.choice(b"aeinrst") for _ in range(rng.randrange(4))))
        assert p.ids() == b.merge(p.data) and steps <= len(p.data)
    p.append(b"tail")
    assert p.ids() == b.merge(p.data)


# 5


def test_lines(spark, odd, none):
    rows = [(i, f"menu\nbody {i}\n\nmenu", "h") for i in range(20)] + [(50 + i, f"menu\nbody {i}", None) for i in range(4)] + [(90, "menu", "once"), (91, None, "h"), (92, "", "h")]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows)
    assert (got[3].text, got[3].n_lines, got[3].n_removed) == ("body 3\n", 4, 2) and got[51].text == "body 1"
    assert got[90].text == "menu" and tuple(got[91][c] for c in ("text", "n_lines", "n_removed")) == (None, 0, 0) and got[92].text == ""
    assert line_dedup.drop_boilerplate(odd).count() == odd.count() and line_dedup.drop_boilerplate(none).count() == 0


# 6


def _brute_near(rows, percent):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for i, w in words.items()}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * (n := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return sets, _union(pairs, ids)


def test_near_duplicates_match_brute_force(spark, docs, odd, none):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    chain = [(5_000 + i, " ".join([*base[i * 8 :], *(f"n{k}" for k in range(i * 8))])) for i in range(12)]  # linked in a chain only
    noisy = [(6_000 + i, " ".join(w if rng.random() > 0.015 else "z" for w in base)) for i in range(30)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + chain + noisy
    sets, want = _brute_near(rows, 85)
    for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and all(r.kept for r in got if r.doc_id is None) and minhash.near_duplicates(none).count() == 0
    assert minhash.keep_one(odd).columns == odd.columns


def test_sketch_fills_every_coordinate():
    for n in (1, 2, 7, 200, 5_000):
        u = np.unique(np.random.default_rng(n).integers(1, 1 << 62, n, dtype=np.int64).astype(np.uint64))
        assert len(minhash.sketch(u)) == minhash.T and (minhash.sketch(u) == minhash.sketch(u[::-1].copy())).all()


# 7


def test_store_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").select(F.col("doc_id") + 10_000, "text").distinct().toDF("doc_id", "text"))
    store = token_store.Store(spark, token_store.write_store(rows, path))
    sums, ids = {r.doc_id: r for r in store.checksums().collect()}, {r.doc_id: r.ids for r in store.documents().collect()}
    start = 0
    for r in sorted(rows.collect(), key=lambda r: r.doc_id):
        want = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert ids[r.doc_id] == want
        assert (sums[r.doc_id].start, sums[r.doc_id].n_tokens, sums[r.doc_id].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert store.chunks.count() == store.chunks.select("hash").distinct().count() and store.manifest.count() == 1
    assert token_store.Store(spark, token_store.write_store(odd, path)).checksums().count() == odd.count()


def test_store_that_is_damaged_is_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(token_store, "FAN", 4)
    whole = token_store.write_store(docs.limit(20), public_tokenizers.path("byte_bpe_50k.json"))
    store = token_store.Store(spark, whole)
    assert store.manifest.count() == 5 + 2 + 1 and store.checksums().count() == store.documents().count() == 20
    gone = F.col("hash") == store.recipes.where("rank = 3").first().hashes[0]
    other = store.recipes.where("rank = 5").first()
    third, changed = F.col("rank") == 3, lambda c, v, at: F.when(at, v).otherwise(F.col(c))
    cases = {
        "a chunk is missing": ("chunks", store.chunks.where(~gone)),
        "a chunk's ids are changed": ("chunks", store.chunks.withColumn("ids", changed("ids", F.lit(b"\1\0"), gone))),
        "a chunk is there twice": ("chunks", store.chunks.union(store.chunks.where(gone))),
        "a recipe's hashes are changed": ("recipes", store.recipes.withColumn("hashes", changed("hashes", F.reverse(F.concat("hashes", "hashes")), third))),
        "a recipe is another's": ("recipes", store.recipes.withColumns({"hashes": changed("hashes", F.array(*[F.lit(bytes(h)) for h in other.hashes]), third), "ns": changed("ns", F.array(*map(F.lit, other.ns)), third), "n_tokens": changed("n_tokens", F.lit(other.n_tokens), third), "root": changed("root", F.lit(bytes(other.root)), third)})),
        "a recipe's count is changed": ("recipes", store.recipes.withColumn("n_tokens", F.col("n_tokens") + third.cast("long"))),
        "a start is changed": ("recipes", store.recipes.withColumn("start", F.col("start") + third.cast("long"))),
        "the last recipe is missing": ("recipes", store.recipes.where("rank < 19")),
        "a node is changed": ("manifest", store.manifest.withColumn("root", changed("root", F.lit(b"x"), (F.col("level") == 1) & (F.col("node") == 1)))),
    }
    for case, (part, table) in cases.items():
        broken = token_store.Store(spark, whole)
        setattr(broken, part, table)
        for read in (broken.checksums, broken.documents):
            with pytest.raises(Exception, match="damaged|differ|start where"):
                read().collect()
                print("read without an error:", case)


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = random.Random(2)
    pieces = ["the", "naïve", "Straße", "don't", "x'", "a.b", "###", "...", "'s", "42", "v2.", "漢字", "🙂", "é", "×", "ª", "<|endoftext|>", "to<|endoftext|>", "a\u2028b", "can\u2019t", "_", "end_", "", " ", "\t", "\r", "\x1c"]
    texts = [rng.choice([" ", " ", "\n", ""]).join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(4_000)]
    texts += ["".join(rng.choice("abEé .,'\n1-") for _ in range(rng.randint(1, 60))) for _ in range(4_000)]
    for room in (1 << 26, 9_000):
        own = token_store.Encoder(path, room)
        for at in range(0, len(texts), 500):
            want = [[*e.ids, 0] for e in t.encode_batch(texts[at : at + 500], add_special_tokens=False)]
            ids, ends = own.encode(pa.array(texts[at : at + 500], pa.large_string()), 0)
            assert ids.tolist() == [i for w in want for i in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_chunks_follow_content():
    ids = np.random.default_rng(1).integers(0, 50_000, 20_000)
    whole = lambda x: token_store.cuts(x, np.array([len(x)]))
    a, b = whole(ids), whole(np.r_[ids[:5_000], [7, 8, 9], ids[5_000:]])
    assert a[-1] == 20_000 and max(np.diff([0, *a])) <= token_store.MOST
    assert len({x + 3 for x in a} & {*b}) > len(a) // 2


def test_chunks_of_a_batch_are_those_of_its_documents():
    rng = np.random.default_rng(3)
    sizes = [1, 5_000, 127, 128, 129, 1, 16, 4_096, 4_097, 8_192, *rng.integers(1, 3_000, 80), 20_000]
    ids = [np.zeros(n, np.int64) if k % 7 == 3 else rng.integers(0, 50_000, n) for k, n in enumerate(sizes)]
    ends = np.cumsum(sizes)
    want = [e - n + c for x, e, n in zip(ids, ends, sizes) for c in token_store.cuts(x, np.array([n]))]
    assert token_store.cuts(np.concatenate(ids), ends).tolist() == want and set(ends) <= set(want)


# 8


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.classify(docs).join(labels, "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert all(r.accepted for r in good) and sum(not r.accepted for r in bad) >= 0.8 * len(bad)
    by = {r.text: r for r in quality.classify(odd).collect()}
    assert not by[None].accepted and not by[" "].accepted and by["a b c"].accepted and quality.classify(none).count() == 0


# 9


def _split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute_windows(items, size=10):
    windows = {}
    for i, t in items:
        w = _split(t)
        for k in range(max(1, len(w) - size + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    return windows


def _brute_hits(text, windows):
    w, hit, items = _split(text), set(), set()
    for size in {len(x) for x in windows}:
        for k in range(len(w) - size + 1):
            if own := windows.get(tuple(w[k : k + size])):
                hit.update(range(k, k + size))
                items |= own
    return len(w), len(hit), sorted(items)


def test_decontamination_matches_brute_force(spark, docs, odd, none):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "a b c"), (901, None), (902, "?!"), (None, "x"), (900, "the of and"), (903, "é🙂")], "item_id long, text string"))
    windows = _brute_windows([tuple(r) for r in bench.collect()])
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in decontam.scan(rows, bench).collect():
        assert (r.n_words, r.n_hit, r["items"]) == _brute_hits(r.text, windows)
        assert sum(len(_split(r.text[s.start : s.end])) for s in r.spans) == r.n_hit
    kept = decontam.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontam.drop_contaminated(none, bench).count() == 0 and decontam.drop_contaminated(odd, bench.limit(0)).count() == odd.count()
    clash = decontam.scan(odd.withColumn("n_hit", F.lit("own")).withColumn("items", F.lit(1)), bench)
    assert sorted(clash.columns) == sorted([*odd.columns, "n_words", "n_hit", "items", "spans"]) and clash.where("n_hit > 0").count() == 3


@pytest.mark.parametrize("step", [3, 128])
def test_decontamination_of_few_words_that_recur(monkeypatch, step):
    """Windows that begin or end with others, and texts of a handful of words, in which they overlap."""
    monkeypatch.setattr(decontam, "STEP", step)
    rng = random.Random(8)
    for size in (1, 2, 4):
        for _ in range(40):
            say = lambda n: " ".join(rng.choice("ab") for _ in range(rng.randint(0, n)))
            items = sorted((str(k), say(7)) for k in range(4))
            texts = [say(40) for _ in range(12)] + [""]
            got = decontam.Automaton(items, size).scan(pa.array(texts, pa.large_string())).to_pylist()
            windows = _brute_windows(items, size)
            for t, r in zip(texts, got):
                assert (r["n_words"], r["n_hit"], r["items"]) == _brute_hits(t, windows)
                assert sum(len(_split(t[s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"]


def test_decontamination_by_a_large_benchmark_is_one_scan(spark):
    rng = np.random.default_rng(0)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 3_000)) for _ in range(400)]  # 8 MB
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(0, "x " + " ".join(items[7].split()[100:130]) + " y"), (1, " ".join(reversed(items[7].split()[:30])))], "doc_id long, text string")
    got = decontam.scan(docs, bench)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert [(r.n_words, r.n_hit, r["items"]) for r in got.orderBy("doc_id").collect()] == [(32, 30, ["7"]), (30, 0, [])]


# 10


def test_urls(spark):
    urls = {"http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://x.net": ("x.net", "", None, "allow"), "https://x.net/": ("x.net", "/", "net/", "block"),
            "s://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "s://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "s://a.org?x=://b.net/": ("a.org", "", None, "allow"),
            "s://org/fr/1": ("org", "/fr/1", "org/fr/", "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "s://bad.host.com/x": ("bad.host.com", "/x", None, "block")}
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, sure string")
    outcomes = spark.createDataFrame([("bad.host.com", True)] * 30 + [("good.host.com", False)] * 30 + [("a.org", None), (None, True)], "host string, bad boolean")
    for r in url_filter.judge(pages, outcomes).collect():
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.url]
    assert url_filter.judge(pages, outcomes.limit(0)).where("verdict = 'block'").count() == 2


def test_urls_of_hosts_without_outcomes(spark):
    outcomes = spark.createDataFrame([("old.bad.com", True)] * 30 + [("old.good.com", False)] * 90 + [("a.awful.xyz", True)] * 20 + [("b.awful.xyz", True)] * 20, "host string, bad boolean")
    want = {"new.bad.com": "block", "new.good.com": "allow", "new.com": "allow", "other.xyz": "block", "fresh.dev": "allow"}
    pages = spark.createDataFrame([(f"s://{h}/",) for h in want] + [("no scheme",), (None,)], "url string")
    got = {r.url: r for r in url_filter.judge(pages, outcomes).collect()}
    assert {h: got[f"s://{h}/"].verdict for h in want} == want and {got[u].verdict for u in ("no scheme", None)} == {"allow"}
    assert url_filter.judge(pages, outcomes.limit(0)).where("sure > 0 or verdict = 'block'").count() == 0


def _beta_above(a, b, x, steps=200_000):
    """By a fine sum over the density's logarithm, away from the operator's own grid."""
    t = (np.arange(steps) + 0.5) / steps
    log = (a - 1) * np.log(t) + (b - 1) * np.log1p(-t)
    w = np.exp(log - log.max())
    return w[t > x].sum() / w.sum()


def test_url_priors_match_brute_force(spark):
    for a, b in ((1.0, 1.0), (2.5, 4.0), (30.0, 60.0), (1.2, 9.0), (400.0, 900.0), (9_000.0, 20_900.0)):
        got = spark.range(1).select(url_filter.above(F.lit(a), F.lit(b), 0.3).alias("p")).first().p
        assert abs(got - _beta_above(a, b, 0.3)) < 0.02
    rng = random.Random(3)
    hosts = {f"h{k}.d{k % 5}.{'com' if k % 5 < 3 else 'org'}": (rng.randint(1, 30), rng.random()) for k in range(25)}
    rows = [(h, rng.random() < p) for h, (n, p) in hosts.items() for _ in range(n)]
    got = {r.host: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, bad boolean"), spark.createDataFrame([("new.d0.com",), ("x.net",)], "host string")).collect()}
    count = {h: [sum(x == h for x, _ in rows), sum(b for x, b in rows if x == h)] for h in {*hosts, "new.d0.com", "x.net"}}

    def strength(groups):
        seen = [(n, b, m) for n, b, m in groups if n]
        q, a, c = (sum(f(n, b, m) for n, b, m in seen) for f in (lambda n, b, m: n * (b / n - m) ** 2, lambda n, b, m: m * (1 - m), lambda n, b, m: (n - 1) * m * (1 - m)))
        return 1000.0 if (share := (q - a) / c) <= 0 else min(max(1 / share - 1, 1.0), 1000.0)

    def draw(level, above):
        groups = {}
        for h, (n, b) in count.items():
            g = groups.setdefault(level(h), [0, 0])
            g[0], g[1] = g[0] + n, g[1] + b
        s = strength([(n, b, above(g)[0]) for g, (n, b) in groups.items()])
        own = {g: max(1 / (1 / (s + 1) + 1 / (above(g)[1] + 1)) - 1, 0.01) for g in groups}
        return {g: ((b + own[g] * above(g)[0]) / (n + own[g]), n + own[g]) for g, (n, b) in groups.items()}

    base = (sum(b for _, b in count.values()) + 0.5) / (len(rows) + 1), len(rows) + 1
    top = draw(lambda h: h.split(".")[-1], lambda g: base)
    mid = draw(lambda h: h.split(".", 1)[1] if h.count(".") > 1 else h, lambda g: top[g.split(".")[-1]])
    low = draw(lambda h: h, lambda g: mid[g.split(".", 1)[1] if g.count(".") > 1 else g])
    assert set(got) == set(low) and all(abs(got[h].rate - low[h][0]) < 1e-9 for h in low)
    assert all(abs(got[h].sure - _beta_above(p * w, (1 - p) * w, 0.3)) < 0.03 for h, (p, w) in low.items() if 1 < p * w and 1 < (1 - p) * w)


def test_urls_of_odd_tables(spark):
    pages = spark.createDataFrame([(None, "s://a.net/x"), (1, "s://a.net/x"), (1, "s://a.net/x"), (2, None)], "page_id long, url string").withColumns({"sure": F.lit("own"), "rule": F.lit(7)})
    outcomes = spark.createDataFrame([], "host string, bad boolean")
    got = url_filter.judge(pages, outcomes)
    assert sorted(got.columns) == ["host", "page_id", "path", "rule", "sure", "url", "verdict"] and [r.rule for r in got.orderBy("page_id").collect()] == ["net/", "net/", "net/", None]
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0
    two = [("block", "a.net", "/"), ("allow", "net", "/x/y")]
    same = [("block", "b.io", "/c"), ("allow", "io", "/c/d"), ("allow", "b.io", "/c")]
    url = spark.createDataFrame([("s://a.net/x/y",), ("s://b.io/c/d",)], "url string")
    assert {r.url: r.rule for r in url_filter.judge(url, outcomes, rules=two).collect()}["s://a.net/x/y"] == "net/x/y"
    assert {r.url: r.rule for r in url_filter.judge(url, outcomes, rules=same).collect()}["s://b.io/c/d"] == "io/c/d"


def test_urls_under_suffixes_of_two_labels(spark):
    outcomes = spark.createDataFrame([("shop.bad.co.uk", True)] * 40 + [("a.good.co.uk", False)] * 40 + [("x.org", False)] * 80, "host string, bad boolean")
    want = {"new.bad.co.uk": "block", "new.good.co.uk": "allow", "elsewhere.co.uk": "allow", "co.uk": "allow"}
    pages = spark.createDataFrame([(f"s://{h}/",) for h in want], "url string")
    assert {r.host: r.verdict for r in url_filter.judge(pages, outcomes).collect()} == want
    hosts = ["a.b.com.au", "b.com.au", "com.au", "au", "a.b.example.net", "", "notco.uk", "x.notco.uk"]
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *url_filter.levels(F.col("host"))).collect()
    assert [tuple(r)[1:] for r in got] == [("b.com.au", "com.au"), ("b.com.au", "com.au"), ("com.au", "com.au"), ("au", "au"), ("example.net", "net"), ("", ""), ("notco.uk", "uk"), ("notco.uk", "uk")]


# the pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    _, library = _tiktoken()
    good = {r.doc_id for r in quality.classify(docs).where("accepted").select("doc_id").collect()}
    rows = docs.where(F.col("doc_id").isin(*good))
    lines = [(r.doc_id, r.text) for r in line_dedup.drop_boilerplate(rows).collect()]
    _, label = _brute_near(lines, 80)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    left = spark.createDataFrame([(i, t) for i, t in lines if label[i] == i], "doc_id long, text string")
    want = {r.doc_id: (r.text, len(library.encode_ordinary(r.text))) for r in decontam.drop_contaminated(left, bench).collect()}
    got = {r.doc_id: r for r in p.run(spark, DATA).collect()}
    assert set(got) == set(want)
    for i, (text, n) in want.items():
        assert got[i].n_tokens == n and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_sql(spark, duck):
    from plumbline.llm.queries import ORACLE_SQL, QUERIES
    from tests.conftest import canon

    for name, sql in ORACLE_SQL.items():
        assert canon(QUERIES[name](spark, DATA).toPandas()) == canon(duck.sql(sql).df()), name
