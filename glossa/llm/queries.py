"""One thin query for each corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, langid, licenses, neardup, packing, search, sentences, sharding, suffix
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_every(table(spark, sf_dir, "documents"), step=100, top=10)


def op8_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.dedup_sentences(docs)


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_karmarkar_karp_packing, op2_html_extraction, op3_ppm_language, op4_license_scan, op5_suffix_dedup, op6_decontaminate, op7_bm25_search, op8_sentence_dedup, op9_minhash_neardup, op10_jump_sharding, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op5_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, i, md5(h[2 * i + 1 : 2 * i + 400]) k from d, unnest(range(0, greatest(0, length(h) // 2 - 199))) t(i)),
r as (select k from w group by k having count(*) > 1),
p as (select doc_id, i, lag(i) over (partition by doc_id order by i) before from w semi join r using (k)),
g as (select doc_id, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by doc_id order by i) run from p),
s as (select doc_id, run, min(i) a, max(i) + 200 b from g group by 1, 2),
c as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) last from s),
x as (select doc_id, string_agg(h[2 * last + 1 : 2 * a], '' order by a) pre, max(b) after, sum(b - a) removed, count(*) spans from c join d using (doc_id) group by doc_id)
select doc_id, length(h) // 2 n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(spans, 0) n_spans,
  sha256(unhex(coalesce(pre, '') || h[2 * coalesce(after, 0) + 1 :])) kept_sha256
from d left join x using (doc_id)
""",
    "op7_bm25_search": rf"""
with t as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D!-/:-@\[-`{{-~]+') w from documents where doc_id is not null),
l as (select doc_id, len(w) n from t),
f as (select doc_id, x, count(*) tf from (select doc_id, unnest(w) x from t) group by 1, 2),
g as (select x, count(*) df from f group by 1),
c as (select count(*) n, avg(n) mean from l),
s as (select q.doc_id query_id, f.doc_id, round(sum(ln(1 + (c.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.n / mean))), 6) score
  from (select doc_id, x from f where doc_id % 100 = 0) q join f on f.x = q.x and f.doc_id <> q.doc_id join g on g.x = f.x join l on l.doc_id = f.doc_id, c group by 1, 2)
select query_id, rank, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from s) where rank <= 10
""",
    "op8_sentence_dedup": r"""
with k as (select doc_id, text, regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*') lead, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') a from documents),
x as (select doc_id, tok, i, regexp_extract(tok, '^[^\x20\x09-\x0D]+') word from (select doc_id, unnest(a) tok, generate_subscripts(a, 1) - 1 i from k)),
b as (select *, case when i = 0 or lag(word[-1:], 1) over o in ('.', '!', '?') or contains(lag(tok, 1) over o, chr(10)) then i end st from x window o as (partition by doc_id order by i)),
c as (select *, max(st) over (partition by doc_id order by i rows unbounded preceding) ls from b),
u as (select doc_id, i from c where (i - ls) % 64 = 0 or i - ls >= 16 and hex(encode(word))[-1:] in ('0', '4', '8', 'C')),
l as (select doc_id, list(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') order by i) w from x group by 1),
e as (select doc_id, list_append(list(u.i order by u.i), any_value(len(l.w))::bigint) ed, any_value(w) w from u join l using (doc_id) group by doc_id),
r as (select doc_id, ed[p] s, list_filter(ed[p + 3 :], lambda z : z - ed[p] >= 24)[1] t, w from e, unnest(range(1, len(ed))) q(p)
  union select doc_id, list_filter(ed[: greatest(p - 3, 0)], lambda z : ed[p] - z >= 24)[-1], ed[p], w from e, unnest(range(2, len(ed) + 1)) q(p)),
h as (select doc_id, s, t, row_number() over (partition by array_to_string(w[s + 1 : t], ' ') order by doc_id, s) nth from r where s is not null and t is not null),
g as (select distinct doc_id, unnest(range(s, t)) i from h where nth > 1),
y as (select x.doc_id, string_agg(tok, '' order by x.i) filter (g.i is null) kept, count(g.i) n_words, count(u.i) filter (g.i is not null) n_units
  from x left join g using (doc_id, i) left join u on u.doc_id = x.doc_id and u.i = x.i group by 1)
select doc_id, case when text is not null then lead || coalesce(kept, '') end as text, coalesce(n_units, 0) n_sentences_removed, coalesce(n_words, 0) n_words_removed from k left join y using (doc_id)
""",
    "op9_minhash_neardup": rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from d),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
v as (select a, b from e union select b, a from e),
r(a, b) as (select doc_id, doc_id from d union select r.a, v.b from r join v on v.a = r.b),
m as (select a doc_id, min(b) component_id from r group by 1)
select doc_id, coalesce(n.n, 0) n_shingles, component_id, doc_id = component_id kept from m left join n using (doc_id)
""",
}
