"""Personal data: base patterns, and terms that give protected entities away by how they occur with them. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialise, small_or_shuffled

KINDS = ("email", "ip", "card", "phone")
#: The entities whose disclosure is measured: the base kinds, and values that stand behind the name of a secret.
PROTECTED = (*KINDS, "secret")
#: The same matches as the plain patterns, but linear: a run is entered at its begin, or where the last match ended, and never given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]){2,}+",
    "secret": r"(?<![A-Za-z0-9])(?i:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|passwd)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?(?=[^\s\"']{0,80}[0-9])[^\s\"']{8,}+[\"']?",
}
#: What a text needs to have for a match at all; cheap.
_HINT = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.instr(t, "+") > 0,
    "secret": lambda t: ((F.instr(t, "=") > 0) | (F.instr(t, ":") > 0)) & t.rlike(r"(?i:key|secret|token|passw)[\w]{0,3}[\"']?[ \t]{0,3}[:=]"),
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPANS = "array<struct<s: int, e: int, t: string>>"
_INTS = "array<int>"
_TERM = r"\p{L}{3,}+"
#: Characters of the private-use area that stand for entities of a kind while lines are looked at; a text's own are blanked before.
_MARKS = {k: chr(0xE000 + i) for i, k in enumerate(PROTECTED)}
#: What a line has: entities of a kind of its own, and those of its own or of a line next to it.
_EVENTS = [f"{k}{reach}" for reach in ("", "_near") for k in PROTECTED]

#: A term discloses a kind if it stands in SUPPORT of the kind's lines, or of these and their neighbours, at least, and its pointwise mutual information with the
#: kind is at least DISCLOSURE of the kind's own information; from REMOVAL on it is removed, below it is generalised.
SUPPORT, DISCLOSURE, REMOVAL = 5, 0.5, 0.8
#: Array items that are worked through at a time, as appending to an array copies it; code points of a piece of a text, as finding a place in a string reads it from its begin.
_RUN, _PIECE = 128, 2048


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    digits = F.regexp_replace(t, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return t.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _indices(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast(_INTS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once a row; a plain reference within a lambda would be evaluated for each of its calls."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For an array<int> of n items, array<int> of n + 1: 0 merged with the items before each, and with all of them.

    Runs of _RUN items are totalled first, so that no more than a run's items and the runs' totals are appended one by one.
    """

    def steps(items: Column, start: Column) -> Column:
        return F.aggregate(items, F.array(start).cast(_INTS), lambda a, x: F.concat(a, F.array(merge(F.get(a, F.size(a) - 1), x))))

    def joined(runs: Column, starts: Column) -> Column:
        each = F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), lambda r, s: F.slice(steps(r, s), F.lit(1), F.size(r)))
        return F.concat(F.flatten(each), F.slice(starts, F.lit(-1), F.lit(1)))

    cut = lambda v: F.transform(_indices(F.ceil(F.size(v) / _RUN).cast("int")), lambda k: F.slice(v, k * _RUN + 1, F.lit(_RUN)))
    totals = lambda runs: F.transform(runs, lambda r: F.aggregate(r, F.lit(0), merge))
    return let(values, lambda v: let(cut(v), lambda runs: let(steps(totals(runs), F.lit(0)), lambda starts: joined(runs, starts))))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<s, e, t>>: the matches of a pattern in a text, offsets in code points."""

    def placed(found: Column, between: Column) -> Column:
        size = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        return let(running(size, lambda a, x: a + x), lambda ends: F.zip_with(found, F.slice(ends, F.lit(2), F.size(found)), lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("t"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda between: placed(found, between)))


def find(text: Column, kind: str) -> Column:
    """The valid matches of a kind, array<struct<s, e, t>>; offsets in code points, e exclusive. Empty for null."""
    valid = F.filter(_places(text, PATTERNS[kind]), lambda x: _valid(kind, x["t"]))
    return F.when(text.isNotNull() & _HINT[kind](text), valid).otherwise(F.array()).cast(_SPANS)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column of spans for each protected kind."""
    return docs.withColumns({f"__{k}": find(F.col(text), k) for k in PROTECTED})


def _ordered(*parts: tuple[str, Column]) -> Column:
    """array<struct<s, k, e, kind, t>> in order of start, then kind."""

    def named(n: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["t"].alias("t")))

    return F.array_sort(F.concat(*[named(n, k, c) for n, (k, c) in enumerate(parts)]))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    """The distinct lower-cased terms of a text."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))), lambda m: F.lower(m)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """text with the spans (in order of s; code points) put into marks. Spans that overlap go together, with the mark of the first.

    mark gets a struct of s, e and first, the span that comes first.
    """

    def cuts(x: Column, upto: Column) -> Column:
        heads = F.filter(_indices(F.size(x)), lambda i: F.get(x, i)["s"] >= F.get(upto, i))
        end = lambda heads, k: F.get(upto, F.coalesce(F.get(heads, k + 1), F.size(x)))
        return let(heads, lambda heads: F.transform(heads, lambda i, k: F.struct(F.get(x, i)["s"].alias("s"), end(heads, k).alias("e"), F.get(x, i).alias("first"))))

    def joined(c: Column, pieces: Column) -> Column:
        piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))

        def part(s: Column, e: Column) -> Column:
            one, two = F.floor(s / _PIECE).cast("int"), F.floor(e / _PIECE).cast("int")
            across = F.concat(F.substring(piece(one), s % _PIECE + 1, F.lit(_PIECE)), F.array_join(F.slice(pieces, one + 2, F.greatest(two - one - 1, F.lit(0))), ""), F.substring(piece(two), F.lit(1), e % _PIECE))
            return F.when(one == two, F.substring(piece(one), s % _PIECE + 1, e - s)).otherwise(across)

        before = lambda k: F.when(k > 0, F.get(c, k - 1)["e"]).otherwise(0)
        kept = F.array_join(F.transform(c, lambda x, k: F.concat(part(before(k), x["s"]), mark(x))), "")
        size = F.aggregate(pieces, F.lit(0), lambda a, x: a + F.length(x))
        return F.concat(kept, let(F.get(c, F.size(c) - 1)["e"], lambda last: part(last, size)))

    split = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    upto = lambda x: running(F.transform(x, lambda y: y["e"]), lambda a, y: F.greatest(a, y))
    done = let(spans, lambda x: let(upto(x), lambda u: let(cuts(x, u), lambda c: let(split, lambda pieces: joined(c, pieces)))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _near_lines(docs: DataFrame) -> DataFrame:
    """terms and flags of the lines of docs(text, base, an array of spans) that have an entity in them or in a line next to them.

    The flags of a kind k are k, for the line itself, and k_near. Entities are no terms.
    """
    blank = F.translate("text", "".join(_MARKS.values()), " " * len(_MARKS))
    sign = F.create_map(*[x for k in PROTECTED for x in (F.lit(k), F.lit(_MARKS[k]))])
    marked = replaced(blank, F.col("base"), lambda c: F.repeat(F.element_at(sign, c["first"]["kind"]), c["e"] - c["s"]))

    def flagged(lines: Column) -> Column:
        has = lambda i, k: F.coalesce(F.contains(F.get(lines, i), F.lit(_MARKS[k])), F.lit(False))
        own = lambda i: [has(i, k).alias(k) for k in PROTECTED]
        near = lambda i: [(F.when(i > 0, has(i - 1, k)).otherwise(False) | has(i, k) | has(i + 1, k)).alias(f"{k}_near") for k in PROTECTED]
        return F.transform(lines, lambda line, i: F.struct(line.alias("line"), *own(i), *near(i)))

    each = docs.select(F.explode(let(_lines(marked), flagged)).alias("x")).select("x.*").where(F.greatest(*[f"{k}_near" for k in PROTECTED]))
    return each.select(_terms(F.col("line")).alias("terms"), *_EVENTS)


def disclosing_terms(docs: DataFrame, near: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """term, kind, share: the terms whose presence in a line tells that the line, or one next to it, holds an entity of a kind.

    share = log2(P(term, kind) / (P(term) P(kind))) / log2(1 / P(kind)), with probabilities over all lines of docs, taken once
    with the entities of the line itself and once with those of its neighbours too (kind is k or k_near). Terms are first
    narrowed to those with enough joint lines; only these are then counted over the corpus.
    """
    joint = near.select(F.explode("terms").alias("term"), *_EVENTS).groupBy("term").agg(*[F.sum(F.col(k).cast("long")).alias(k) for k in _EVENTS])
    joint = materialise(joint.where(F.greatest(*_EVENTS) >= support), "joint")
    total = docs.agg(F.coalesce(F.sum(F.size(_lines(F.col("text")))), F.lit(0)).cast("double").alias("lines"))
    n_kind = near.agg(*[F.coalesce(F.sum(F.col(k).cast("long")), F.lit(0)).alias(f"n_{k}") for k in _EVENTS])
    terms = docs.select(F.explode(_lines(F.col("text"))).alias("line")).select(F.explode(_terms(F.col("line"))).alias("term"))
    few = joint.count()
    if few > BROADCAST_ROWS:
        terms = terms.groupBy("term").agg(F.count("*").alias("n_term")).join(joint, "term")
    else:
        terms = terms.join(F.broadcast(joint.select("term")), "term").groupBy("term").agg(F.count("*").alias("n_term")).join(joint, "term")
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("both"), F.col(f"n_{k}").alias("n_kind")) for k in _EVENTS])).alias("x")
    each = terms.join(F.broadcast(total)).join(F.broadcast(n_kind)).select("term", "n_term", "lines", stack).where((F.col("x.both") >= support) & (F.col("x.n_kind") < F.col("lines")))
    share = F.log2(F.col("x.both") * F.col("lines") / (F.col("n_term") * F.col("x.n_kind"))) / F.log2(F.col("lines") / F.col("x.n_kind"))
    return each.select("term", F.col("x.kind").alias("kind"), share.alias("share")).where(F.col("share") >= disclosure)


def _occurrences(text: Column, own: str) -> Column:
    """array<struct<s, e, t>>: where words of own, a map from disclosing terms to what they become, stand in a text; t is that."""
    at = F.transform(_places(text, _TERM), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.try_element_at(F.col(own), F.lower(x["t"])).alias("t")))
    return F.when(F.col(own).isNotNull(), F.filter(at, lambda x: x["t"].isNotNull())).otherwise(F.array()).cast(_SPANS)


RESULTS = (*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_secret", "n_private", "clean", "clean_sha256")


def sanitise(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """docs(doc_id, text) with n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_private, clean and clean_sha256.

    base_sha256 is of the base spans, spans has all: base kinds, secrets (a value behind a name such as token or password) and
    disclosing terms. n_private counts all but the terms. clean is the sanitised text: base spans and secrets become [EMAIL],
    [IP], [CARD], [PHONE], [SECRET]. A disclosing term is generalised to the class of what it discloses, as in [EMAIL TERM],
    wherever it stands outside of entities, in documents without any too; or nothing stays of it where it discloses too much.
    Spans that overlap go together, with the mark of the first.

    Null texts: no spans, clean null, digest of nothing. Rows that repeat id and text get the same result, null ids too; an
    empty table stays empty. Other columns stay, existing ones of these names are replaced. Texts with very many spans cost
    little more than their length.
    """
    key = F.xxhash64("text")
    base = _ordered(*[(k, F.col(f"__{k}")) for k in PROTECTED])
    flagged = base_spans(docs.select("text")).withColumn("base", base).where(F.size("base") > 0)
    near = materialise(_near_lines(flagged.select("text", "base")), "near")
    told = disclosing_terms(docs, near, support, disclosure).groupBy("term").agg(F.max("share").alias("share"), F.max_by(F.regexp_replace("kind", "_near$", ""), F.struct("share", "kind")).alias("kind"))
    told = told.select("term", F.when(F.col("share") >= removal, F.lit("")).otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit(" TERM]"))).alias("as"))
    told = materialise(told, "terms")
    found = _terms(F.col("text"))
    hits = docs.select(F.col("doc_id").alias("__id"), key.alias("h"), F.explode(found).alias("term")).join(small_or_shuffled(told, told.count()), "term")
    hits = hits.groupBy("__id", "h").agg(F.map_from_entries(F.collect_set(F.struct("term", "as"))).alias("__terms"))
    hits = materialise(hits, "hits")
    discard(told, near)
    n = hits.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("__terms")), F.lit(0)).alias("terms")).first()
    columns = [c for c in docs.columns if c not in RESULTS]
    small = n.rows <= BROADCAST_ROWS and n.rows * 64 + n.terms * 80 <= 64 << 20  # bytes
    out = base_spans(docs.select(*columns)).join(F.broadcast(hits) if small else hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (key == F.col("h")), "left")
    out = out.withColumn("__base", base)
    # Terms are looked for outside of entities, which are blanked.
    out = out.withColumn("__left", F.when(F.col("__terms").isNotNull(), F.col("__base")).otherwise(F.array().cast(out.schema["__base"].dataType)))
    blank = replaced(F.col("text"), F.col("__left"), lambda c: F.repeat(F.lit(" "), c["e"] - c["s"]))
    out = out.withColumn("__term", _occurrences(blank, "__terms"))
    every = F.when(F.size("__term") > 0, _ordered(*[(k, F.col(f"__{k}")) for k in PROTECTED], ("term", F.col("__term")))).otherwise(F.col("__base"))
    mark = lambda c: F.when(c["first"]["kind"] == "term", c["first"]["t"]).otherwise(F.concat(F.lit("["), F.upper(c["first"]["kind"]), F.lit("]")))
    out = out.withColumn("__every", every)
    out = out.withColumn("__clean", replaced(F.col("text"), F.col("__every"), mark))
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    only = F.filter("__base", lambda x: x["kind"] != "secret")
    return out.select(
        *columns, *counts, F.sha2(_told(only).cast("binary"), 256).alias("base_sha256"), _told(F.col("__every")).alias("spans"), F.size("__secret").cast("long").alias("n_secret"), F.size("__base").cast("long").alias("n_private"),
        F.col("__clean").alias("clean"), F.sha2(F.coalesce("__clean", F.lit("")).cast("binary"), 256).alias("clean_sha256"))
