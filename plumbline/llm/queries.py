"""The registered queries of this package: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, embed_dedup, lang_id, line_dedup, minhash, pii, quality, token_store, url_filter
from .common import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean")  # its digest stays


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = lang_id.fit(docs.where("not held_out and doc_id is not null"))
    return lang_id.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.Store(spark, path).checksums().select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs).drop("text")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, read(spark, sf_dir, "benchmark"))
    items = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = url_filter.outcomes_of(pages, read(spark, sf_dir, "labels"))
    return url_filter.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_embedding_near_dedup, op3_language_id, op4_byte_bpe, op5_line_dedup, op6_minhash_near_dedup, op7_token_store, op8_quality_classifier, op9_benchmark_decontamination, op10_url_filters)
}

_SUFFIXES = ", ".join(f"'{x}'" for x in url_filter.SUFFIXES)


def _moments(groups: str) -> str:
    """groups(n, bad, mean, weight, ...) with the weight of their prior."""
    least, most, else_ = url_filter.LEAST_STRENGTH, url_filter.MOST_STRENGTH, url_filter.STRENGTH
    strength = f"""select coalesce(case when share > 0 then least(greatest(1 / share - 1, {least}), {most}) when share is not null then {most} end, {else_})::double as strength
    from (select (sum(n * pow(bad / n - mean, 2)) - sum(mean * (1 - mean))) / nullif(sum((n - 1) * mean * (1 - mean)), 0) as share from {groups} where n > 0)"""
    return f"select {groups}.*, greatest(1 / (1 / (strength + 1) + 1 / (weight + 1)) - 1, {url_filter.LEAST_PRIOR}) as prior from {groups}, ({strength})"


ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": """
with l as (select doc_id, source, i, line from (select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from documents)),
pages as (select source, count(*) as pages from documents group by source),
n as (select source, line, count(distinct doc_id) as n from l where trim(line) <> '' group by source, line),
bad as (select n.source, n.line from n join pages using (source) where n.n >= 3 and n.n > 0.1 * pages.pages),
k as (select l.doc_id, count(*) as n_lines, count(bad.line) as n_removed, coalesce(string_agg(case when bad.line is null then l.line end, chr(10) order by l.i), '') as text
      from l left join bad on bad.source = l.source and bad.line = l.line group by l.doc_id)
select d.doc_id, d.source, k.text, k.n_lines, k.n_removed from documents d join k using (doc_id)
""",
    "op10_url_filters": f"""
with p as (select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
o as (select p.host, 1 as n, case when l.quality = 0 or l.toxic = 1 then 1 else 0 end as bad from p join labels l on l.doc_id = p.page_id where coalesce(l.quality = 0, l.toxic = 1) is not null
    union all select host, 0, 0 from p where host <> ''),
g as (select host, sum(n) as n, sum(bad) as bad, regexp_extract(host, '([^.]*\\.)?[^.]*$') as two, regexp_extract(host, '([^.]*\\.)?([^.]*\\.)?[^.]*$') as three, regexp_extract(host, '[^.]*$') as one from o group by host),
h as (select host, n, bad, case when two in ({_SUFFIXES}) then three else two end as domain, case when two in ({_SUFFIXES}) then two else one end as suffix from g),
w as (select coalesce((sum(bad) + 0.5) / (sum(n) + 1), 0.5) as mean, coalesce(sum(n) + 1, 1) as weight, sum(n) > 0 as some from h),
s0 as (select suffix, sum(n) as n, sum(bad) as bad, any_value(w.mean) as mean, any_value(w.weight) as weight from h, w group by suffix),
s1 as ({_moments("s0")}), s as (select suffix, (bad + prior * mean) / (n + prior) as mean, n + prior as weight from s1),
d0 as (select domain, sum(n) as n, sum(bad) as bad, any_value(s.mean) as mean, any_value(s.weight) as weight from h join s on s.suffix = h.suffix group by domain),
d1 as ({_moments("d0")}), d as (select domain, (bad + prior * mean) / (n + prior) as mean, n + prior as weight from d1),
e0 as (select host, n, bad, d.mean, d.weight from h join d on d.domain = h.domain),
e1 as ({_moments("e0")}), e as (select host, bad + prior * mean as a, n - bad + prior * (1 - mean) as b from e1),
i as (select host, a, b, ln(a / b) as m, {url_filter.REACH} * sqrt(1 / a + 1 / b) as reach from e),
j as (select *, m - reach as low, m + reach as high, greatest(m - reach, least(m + reach, ln({url_filter.THRESHOLD}::double / (1 - {url_filter.THRESHOLD}::double)))) as line from i),
v as (select host, a, b, m, up, case when up then line else low end as x, case when up then high - line else line - low end as size from j, (select unnest([true, false]) as up)),
u as (select *, x + size * ((k + 0.5::double) / {url_filter.STEPS}) as u from v, (select unnest(range({url_filter.STEPS})) as k)),
x as (select host, up, size * exp(-a * (ln(1 + exp(-abs(u))) + greatest(-u, 0)) - b * (ln(1 + exp(-abs(u))) + greatest(u, 0)) + a * (ln(1 + exp(-abs(m))) + greatest(-m, 0)) + b * (ln(1 + exp(-abs(m))) + greatest(m, 0))) as weight from u),
r as (select host, sum(weight) filter (up) / sum(weight) as sure from x group by host),
f as (select p.*, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from p)
select f.page_id, f.host, f.path, f.rule,
    case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when w.some and r.sure >= {url_filter.SURE} then 'block' else 'allow' end as verdict
from f cross join w left join r on r.host = f.host
""",
}
