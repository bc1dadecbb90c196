"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import render
from .functions.bytestrings import display
from .functions.config import DictConfig
from .operators import build as ops_build
from .operators import search as ops
from .plans.dictionary import Dictionary
from .plans.stage import shared_folder
from .sources import keysets
from .streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_BUILT: dict[tuple, Dictionary] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keysets.keyset(_table(spark, sf_dir, "pages"), "url")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+/", 0).alias("k")).where("k <> ''")
    return keysets.append(_urls(spark, sf_dir), keysets.keyset(site, "k"))


SOURCES: dict[str, Query] = {
    "tokens": lambda s, d: keysets.tokens(_table(s, d, "documents"), "text"),
    "urls": _urls,
    "sites": _sites,
    "parts": lambda s, d: keysets.keyset(_table(s, d, "part"), "p_name", "p_size"),
    "customers": lambda s, d: keysets.keyset(_table(s, d, "customer"), "c_name"),
}

# the same bags as SQL: k is the key's text, w its weight
BAGS = {
    "tokens": "select k, 1.0 w from (select unnest(string_split(text, ' ')) k from documents) where k <> ''",
    "urls": "select url k, 1.0 w from pages where url is not null",
    "sites": "select url k, 1.0 w from pages where url is not null union all select * from (select regexp_extract(url, '^[a-z]+://[^/]+/') k, 1.0 w from pages) where k <> ''",
    "parts": "select p_name k, p_size w from part where p_name is not null",
    "customers": "select c_name k, 1.0 w from customer where c_name is not null",
}


_TABLE_OF = {"tokens": "documents", "urls": "pages", "sites": "pages", "parts": "part", "customers": "customer"}


def _files(spark: SparkSession, sf_dir: str, name: str):
    """A table's path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _state(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    """Time of change and bytes of a table's files."""
    p, fs = _files(spark, sf_dir, name)
    return int(fs.getFileStatus(p).getModificationTime()), int(fs.getContentSummary(p).getLength())


def dictionary(spark: SparkSession, sf_dir: str, source: str, order: str = "weight") -> Dictionary:
    """A dictionary is built once in an application for a state of its table, and queried many times."""
    key = (spark.sparkContext.applicationId, sf_dir, source, order, _state(spark, sf_dir, _TABLE_OF[source]))
    if key not in _BUILT:
        _BUILT[key] = Dictionary.build(SOURCES[source](spark, sf_dir), DictConfig(order=order))
    return _BUILT[key]


def trie_sql(bag: str, order: str = "weight") -> str:
    """Common table expressions over hexadecimal keys: keyset, nodes, nw (weights), par (parents), sib, path, ids."""
    heavy = "w desc, " if order == "weight" else ""
    return f"""
with raw as (select hex(encode(k)) k, w::float::double w from ({bag})),
keyset as (select k, sum(w) w from raw group by k),
srt as (select k, lead(k) over (order by k) nk from keyset),
lcp as (select k, list_max(list_prepend(0, [i for i in range(1, least(length(k), length(nk)) // 2 + 1) if k[1:2*i] = nk[1:2*i]])) l from srt where nk is not null),
nodes as (select distinct p from (select k p from keyset union all select k[1:2*l] from lcp union all select '')),
pre as (select k, w, k[1:2*i] p from keyset, unnest(range(0, length(k) // 2 + 1)) t(i)),
nw as (select n.p, (sum(pre.w))::float w from nodes n join pre on pre.p = n.p group by n.p),
anc as (select n.p, a.p ap from nodes n, unnest(range(0, length(n.p) // 2)) t(i) join nodes a on a.p = n.p[1:2*i]),
par as (select p, max_by(ap, length(ap)) parent from anc group by p),
sib as (select par.p, row_number() over (partition by parent order by {heavy}par.p) - 1 r from par join nw using (p)),
path as (select n.p, coalesce(string_agg(printf('%02x', s.r), '' order by length(s.p)), '') rp from nodes n
  left join (select n2.p np, s.p, s.r from nodes n2, unnest(range(1, length(n2.p) // 2 + 1)) t(i) join sib s on s.p = n2.p[1:2*i]) s on s.np = n.p group by n.p),
ids as (select decode(unhex(p)) k, p hk, length(rp) // 2 depth, row_number() over (order by length(rp), rp) - 1 key_id, row_number() over (order by rp) - 1 dfs_rank
  from path semi join keyset on keyset.k = path.p)
"""


def _register(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---------------------------------------------------------------- key sets and construction


@_register(f"select count(distinct k) num_keys, count(*) n_pushed, sum(octet_length(encode(k)))::bigint total_length from ({BAGS['tokens']})")
def keyset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = SOURCES["tokens"](spark, sf_dir)
    return keys.agg(F.count_distinct("key").alias("num_keys"), F.count(F.lit(1)).alias("n_pushed"), F.sum(F.octet_length("key").cast("long")).alias("total_length"))


@_register(f"select k as \"key\", sum(w::float::double) weight from ({BAGS['parts']}) group by k")
def build_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops_build.distinct_keys(SOURCES["parts"](spark, sf_dir)).select(display("key").alias("key"), "weight")


@_register(
    "select * from ("
    + " union all ".join(f"(select '{s}' source, * from ({trie_sql(BAGS[s])} select (select count(*) from keyset) num_keys, (select count(*) from nodes) num_nodes))" for s in ("parts", "urls", "customers"))
    + ")"
)
def build_num_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [dictionary(spark, sf_dir, s).statistics().select(F.lit(s).alias("source"), "num_keys", "num_nodes") for s in ("parts", "urls", "customers")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ids(d: Dictionary) -> DataFrame:
    return d.keys.select(display("key").alias("key"), "key_id", "dfs_rank", F.col("depth").cast("long").alias("depth"))


_IDS = "select k as \"key\", key_id, dfs_rank, depth::bigint depth from ids"


@_register(trie_sql(BAGS["parts"]) + _IDS)
def build_ids_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(dictionary(spark, sf_dir, "parts"))


@_register(trie_sql(BAGS["parts"], "label") + _IDS)
def build_ids_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(dictionary(spark, sf_dir, "parts", "label"))


@_register(trie_sql(BAGS["customers"]) + _IDS)
def build_ids_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(dictionary(spark, sf_dir, "customers"))


@_register(
    trie_sql(BAGS["parts"])
    + "select p path, parent, length(rp) // 2 as depth, r sib_rank, nw.w::double subtree_weight, p in (select k from keyset) is_terminal from path join nw using (p) left join par using (p) left join sib using (p)"
)
def build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = dictionary(spark, sf_dir, "parts").nodes
    return n.select(F.hex("path").alias("path"), F.hex("parent").alias("parent"), F.col("depth").cast("long").alias("depth"), F.col("sib_rank").cast("long").alias("sib_rank"), F.col("subtree_weight").cast("double").alias("subtree_weight"), "is_terminal")


# ---------------------------------------------------------------- exact lookup


@_register(
    trie_sql(BAGS["customers"])
    + "select q query, coalesce(key_id, -1) key_id from (select c_name q from customer union all select n_name from nation union all select s_name from supplier) left join ids on k = q"
)
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("q")).unionAll(_table(spark, sf_dir, "nation").select("n_name")).unionAll(_table(spark, sf_dir, "supplier").select("s_name"))
    return dictionary(spark, sf_dir, "customers").lookup(ops.as_queries(names, "q")).select(F.col("query_id").alias("query"), "key_id")


_TALK = "(select distinct unnest(string_split(text, ' ')) k from conversations)"


@_register(f"select k as \"query\" from {_TALK} where k <> '' and k in (select k from ({BAGS['tokens']}))")
def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = keysets.tokens(_table(spark, sf_dir, "conversations"), "text").select("key").distinct()
    return dictionary(spark, sf_dir, "tokens").contains(ops.as_queries(q, "key")).select(display("query").alias("query"))


@_register("select k as \"query\" from (select distinct unnest(string_split(text, ' ')) k from benchmark) where k <> '' and k not in (select k from (" + BAGS["tokens"] + "))")
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = keysets.tokens(_table(spark, sf_dir, "benchmark"), "text").select("key").distinct()
    return dictionary(spark, sf_dir, "tokens").missing(ops.as_queries(q, "key")).select(display("query").alias("query"))


@_register(trie_sql(BAGS["customers"]) + "select c_custkey::bigint key_id, k as \"key\" from customer left join ids on key_id = c_custkey")
def reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key_id"))
    return dictionary(spark, sf_dir, "customers").reverse_lookup(ids).select("key_id", display("key").alias("key"))


# ---------------------------------------------------------------- prefixes of the query

_PAGES = "(select distinct url q from pages where url is not null)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.as_queries(_table(spark, sf_dir, "pages").select("url").where("url is not null").distinct(), "url")


@_register(trie_sql(BAGS["sites"]) + f"select q query, (row_number() over (partition by q order by length(k)) - 1)::int ordinal, key_id, k as \"key\", count(*) over (partition by q) n_found from {_PAGES} join ids on starts_with(q, k)")
def common_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionary(spark, sf_dir, "sites").common_prefix_search(_pages(spark, sf_dir))
    return found.select(F.col("query_id").alias("query"), "ordinal", "key_id", display("key").alias("key"), "n_found")


@_register(trie_sql(BAGS["sites"]) + f"select q query, max_by(k, length(k)) as \"key\" from {_PAGES} join ids on starts_with(q, k) group by q")
def common_prefix_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionary(spark, sf_dir, "sites").longest_prefix(_pages(spark, sf_dir))
    return found.select(F.col("query_id").alias("query"), display("key").alias("key"))


@_register(
    "with q as (select distinct k from (select unnest(string_split(text, ' ')) k from benchmark) where k <> ''), "
    f"d as (select distinct k from ({BAGS['tokens']})) "
    "select query, count(d.k) n_found from (select q.k query, unnest(range(1, length(q.k) + 1)) n from q) left join d on d.k = query[1:n] group by query"
)
def common_prefix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ops.as_queries(keysets.tokens(_table(spark, sf_dir, "benchmark"), "text").select("key").distinct(), "key")
    found = dictionary(spark, sf_dir, "tokens").common_prefix_search(q, limit=1, keep_missing=True)
    return found.select(display("query").alias("query"), "n_found")


# ---------------------------------------------------------------- keys that start with the query

_HOSTS = "(select distinct regexp_extract(url, '^[a-z]+://[^/]+') q from pages where url is not null)"


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _table(spark, sf_dir, "pages").where("url is not null").select(F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("q")).distinct()
    return ops.as_queries(h, "q")


@_register(trie_sql(BAGS["urls"]) + f"select q query, (row_number() over (partition by q order by dfs_rank) - 1)::int ordinal, key_id, k as \"key\", count(*) over (partition by q) n_found from {_HOSTS} join ids on starts_with(k, q)")
def predictive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionary(spark, sf_dir, "urls").predictive_search(_hosts(spark, sf_dir))
    return found.select(F.col("query_id").alias("query"), "ordinal", "key_id", display("key").alias("key"), "n_found")


_STEMS = "(select distinct p_name[1:2] q from part union select distinct n_name[1:2] from nation)"


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = _table(spark, sf_dir, "part").select(F.left("p_name", F.lit(2)).alias("q")).union(_table(spark, sf_dir, "nation").select(F.left("n_name", F.lit(2)))).distinct()
    return ops.as_queries(stems, "q")


@_register(
    trie_sql(BAGS["parts"])
    + f"select * from (select q query, case when k is not null then (row_number() over (partition by q order by dfs_rank) - 1)::int end ordinal, key_id, k as \"key\", count(k) over (partition by q) n_found from {_STEMS} left join ids on starts_with(k, q)) where ordinal < 3 or ordinal is null"
)
def predictive_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionary(spark, sf_dir, "parts").predictive_search(_stems(spark, sf_dir), limit=3, keep_missing=True)
    return found.select(F.col("query_id").alias("query"), "ordinal", "key_id", display("key").alias("key"), "n_found")


@_register(
    f"with d as (select distinct k from ({BAGS['tokens']})), p as (select k[1:n] q, count(*) n_found from (select k, unnest([1, 2, 3]) n from d) where length(k) >= n group by 1) "
    "select q query, n_found from (select distinct k[1:3] q from d) join p using (q)"
)
def predictive_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir, "tokens")
    stems = d.keys.select(F.left(F.col("key").cast("string"), F.lit(3)).alias("q")).distinct()
    return d.predictive_count(ops.as_queries(stems, "q")).select(F.col("query_id").alias("query"), "n_found")


@_register("select q query from (select distinct n_name q from nation union select distinct r_name from region) where not exists (select 1 from part where starts_with(p_name, q))")
def predictive_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("q")).union(_table(spark, sf_dir, "region").select("r_name")).distinct()
    found = dictionary(spark, sf_dir, "parts").predictive_count(ops.as_queries(names, "q"))
    return found.where("n_found = 0").select(F.col("query_id").alias("query"))


@_register("select distinct c_name as \"key\" from customer where starts_with(c_name, 'Customer#00000')")
def literal_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(spark, sf_dir, "customers").starts_with(b"Customer#00000").select(display("key").alias("key"))


# ---------------------------------------------------------------- enumeration and statistics


@_register(trie_sql(BAGS["urls"]) + "select dfs_rank, key_id, k as \"key\" from ids")
def dump_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(spark, sf_dir, "urls").dump().select("dfs_rank", "key_id", display("key").alias("key"))


@_register(trie_sql(BAGS["urls"], "label") + "select dfs_rank, key_id, k as \"key\" from ids")
def dump_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(spark, sf_dir, "urls", "label").dump().select("dfs_rank", "key_id", display("key").alias("key"))


@_register(trie_sql(BAGS["urls"]) + "select children, count(*) n_nodes from (select n.p, count(par.p) children from nodes n left join par on par.parent = n.p group by n.p) group by children")
def node_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(spark, sf_dir, "urls").fanout()


@_register(trie_sql(BAGS["urls"]) + "select (length(rp) // 2)::int as depth, count(*) n_nodes, count(keyset.k) n_keys from path left join keyset on keyset.k = path.p group by 1")
def node_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(spark, sf_dir, "urls").depths()


# ---------------------------------------------------------------- text forms and storage

_LINES = (
    "select concat(p_name, chr(9), p_size) line, p_name k, p_size::double w from part "
    "union all select concat(p_name, chr(9), p_type), concat(p_name, chr(9), p_type), 1.0 from part "
    "union all select concat(p_brand, chr(9), p_size, '.5e1', chr(13)), p_brand, concat(p_size, '.5e1')::float::double from part"
)


@_register(f"select k as \"key\", w::float::double weight from ({_LINES})")
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    lines = p.select(F.concat("p_name", F.lit("\t"), size).alias("value")).unionAll(p.select(F.concat("p_name", F.lit("\t"), "p_type"))).unionAll(p.select(F.concat("p_brand", F.lit("\t"), size, F.lit(".5e1\r"))))
    return keysets.parse_lines(lines).select(display("key").alias("key"), "weight")


@_register(trie_sql(BAGS["customers"]) + "select concat(coalesce(key_id, -1), chr(9), q) line from (select c_name q from customer union all select n_name from nation) left join ids on k = q")
def lookup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("q")).unionAll(_table(spark, sf_dir, "nation").select("n_name"))
    return render.lookup_lines(dictionary(spark, sf_dir, "customers").lookup(ops.as_queries(names, "q"))).select("line")


@_register(
    trie_sql(BAGS["parts"])
    + f", hits as (select q, k, key_id, row_number() over (partition by q order by dfs_rank) - 1 n, count(k) over (partition by q) c from {_STEMS} left join ids on starts_with(k, q)) "
    "select distinct q query_id, -1 part, case when c > 0 then concat(c, ' found') else 'not found' end line from hits union all select q, n::int, concat(key_id, chr(9), k, chr(9), q) from hits where c > 0 and n < 10"
)
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionary(spark, sf_dir, "parts").predictive_search(_stems(spark, sf_dir), limit=10, keep_missing=True)
    return render.search_lines(found)


@_register(trie_sql(BAGS["parts"]) + "select dfs_rank, key_id, k as \"key\" from ids")
def save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = dictionary(spark, sf_dir, "parts").save(f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}")
    return stored.dump().select("dfs_rank", "key_id", display("key").alias("key"))


# ---------------------------------------------------------------- repeated queries, nulls, statistics, memory, text files


@_register(
    trie_sql(BAGS["sites"])
    + ", q as (select row_number() over () n, * from (select 1 query_id, url q from pages union all select 1, url from pages union all select null, url from pages union all select 2, null from pages)) "
    "select query_id, q query, case when k is not null then (row_number() over (partition by n order by length(k)) - 1)::int end ordinal, key_id, k as \"key\", count(k) over (partition by n) n_found from q left join ids on starts_with(q, k)"
)
def common_prefix_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionary(spark, sf_dir, "sites").common_prefix_search(_repeated(_table(spark, sf_dir, "pages").select(F.col("url").alias("q"))), keep_missing=True)
    return found.select("query_id", display("query").alias("query"), "ordinal", "key_id", display("key").alias("key"), "n_found")


def _repeated(names: DataFrame) -> DataFrame:
    """Each query twice under one id and once without id, and null queries."""
    one, none = names.select(F.lit(1).alias("query_id"), "q"), names.select(F.lit(None).cast("int"), "q")
    return one.unionAll(one).unionAll(none).unionAll(names.select(F.lit(2), F.lit(None).cast("string"))).select("query_id", F.col("q").cast("binary").alias("query"))


@_register(
    trie_sql(BAGS["parts"])
    + f", s as (select * from {_STEMS}), q as (select row_number() over () n, * from (select 1 query_id, q from s union all select 1, q from s union all select null, q from s union all select 2, null from s)) "
    "select query_id, q query, case when k is not null then (row_number() over (partition by n order by dfs_rank) - 1)::int end ordinal, key_id, k as \"key\", count(k) over (partition by n) n_found from q left join ids on starts_with(k, q)"
)
def predictive_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = _stems(spark, sf_dir).select(F.col("query_id").alias("q"))
    found = dictionary(spark, sf_dir, "parts").predictive_search(_repeated(stems), keep_missing=True)
    return found.select("query_id", display("query").alias("query"), "ordinal", "key_id", display("key").alias("key"), "n_found")


@_register(trie_sql(BAGS["tokens"]) + _IDS)
def build_ids_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(dictionary(spark, sf_dir, "tokens"))


_CONFIG = "3 num_tries, 'text' tail_mode, 'weight' node_order, 'normal' cache_level, false is_empty"


@_register(trie_sql(BAGS["urls"]) + f"select (select count(*) from keyset) num_keys, (select count(*) from nodes) num_nodes, (select max(length(rp) // 2)::int from path) max_depth, {_CONFIG}")
def dictionary_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir, "urls")
    return d.statistics().withColumn("is_empty", F.lit(d.empty()))


@_register(trie_sql(BAGS["parts"]) + f"select (select count(*) from keyset) num_keys, (select count(*) from nodes) num_nodes, (select max(length(rp) // 2)::int from path) max_depth, {_CONFIG}, true has_bytes, true has_estimate")
def stored_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    dictionary(spark, sf_dir, "parts").save(path)
    d = Dictionary.mmap(spark, path)  # a header of another format raises
    return d.statistics().select("*", F.lit(d.empty()).alias("is_empty"), F.lit(d.io_size() > 0).alias("has_bytes"), F.lit(d.total_size() > 0).alias("has_estimate"))


_REGIONS = "select r_name k, r_regionkey::double w from region"


@_register(trie_sql(_REGIONS) + _IDS)
def build_from_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "region").select("r_name", "r_regionkey").collect()  # five regions
    return _ids(Dictionary.from_rows(spark, [(r[0], float(r[1])) for r in rows]))


@_register("select p_name as \"key\", p_size::float::double weight from part union all select p_brand, 1.0 from part")
def read_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, folder = _table(spark, sf_dir, "part"), f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    part.select(F.concat_ws("\t", "p_name", F.col("p_size").cast("string"))).unionAll(part.select(F.concat("p_brand", F.lit("\r")))).write.text(folder)
    return keysets.read_lines(spark, folder).select(display("key").alias("key"), "weight")


@_register(
    "select * from (values ('ab\r', 1.0::double), ('ab', 1.0), ('ab', 2.5), ('a' || chr(9) || 'b', 3.0), ('', 1.0)) t(\"key\", weight)".replace("\r", "' || chr(13) || '")
)
def parse_carriage_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([("ab\r\r",), ("ab\r",), ("ab\t2.5\r",), ("a\tb\t3",), ("\r",)], "value string")
    return keysets.parse_lines(lines).select(display("key").alias("key"), "weight")


@_register(trie_sql(BAGS["customers"]) + "select concat(key_id, chr(9), k) line from ids where key_id in (select c_custkey from customer)")
def reverse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key_id"))
    return render.reverse_lines(dictionary(spark, sf_dir, "customers").reverse_lookup(ids, "inner")).select("line")


@_register(f"select count(*) num_keys, sum(octet_length(encode(k)))::bigint total_length from ({BAGS['sites']})")
def bag_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keysets.statistics(SOURCES["sites"](spark, sf_dir))


@_register("select p_partkey::bigint as \"position\", p_name as \"key\" from part where p_partkey = 7")
def key_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("position"), F.col("p_name").cast("binary").alias("key"))
    return keysets.at(placed, "position", 7).select("position", display("key").alias("key"))


# ---------------------------------------------------------------- tools and streams


@_register(
    trie_sql(BAGS["parts"])
    + """, q as (select n_nationkey n, n_name q from nation)
select 'build' tool, 0 n, concat('#keys: ', (select count(*) from keyset)) line union all select 'build', 1, concat('#nodes: ', (select count(*) from nodes))
union all select 'dump', dfs_rank, k from ids
union all select 'lookup', dfs_rank, concat(key_id, chr(9), k) from ids
union all select 'lookup', (select count(*) from ids) + row_number() over (order by n) - 1, concat('-1', chr(9), q) from q
union all select 'reverse-lookup', dfs_rank, concat(key_id, chr(9), k) from ids
union all select 'common-prefix-search', row_number() over (order by dfs_rank) - 1, line from (
  select d.dfs_rank * 1000 dfs_rank, concat(count(*), ' found') line from ids d join ids i on starts_with(d.k, i.k) group by d.dfs_rank
  union all select d.dfs_rank * 1000 + length(i.k), concat(i.key_id, chr(9), i.k, chr(9), d.k) from ids d join ids i on starts_with(d.k, i.k))
union all select 'predictive-search', 0, concat((select count(*) from ids), ' found')
union all select 'predictive-search', dfs_rank + 1, concat(key_id, chr(9), k, chr(9)) from ids where dfs_rank < 10
"""
)
def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six command-line tools on the parts' names: their lines in order."""
    import io

    from .cli import run

    path, lines = f"{shared_folder(spark)}/tools-{uuid.uuid4().hex}", []

    def call(tool: str, argv: list[str], stdin: list[str] = ()) -> list[str]:
        out, err = io.StringIO(), io.StringIO()
        if run(spark, [tool, *argv], [x + "\n" for x in stdin], out, err):
            raise RuntimeError(err.getvalue())
        text = (err if tool == "build" else out).getvalue().splitlines()[: 2 if tool == "build" else None]
        lines.extend((tool, n, x) for n, x in enumerate(text))
        return text

    bag = SOURCES["parts"](spark, sf_dir).select(F.concat_ws("\t", display("key"), F.col("weight").cast("string")).alias("line"))
    bag.write.text(f"{path}-lines")
    nations = [r[0] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    call("build", ["-o", path, f"{path}-lines"])
    names = call("dump", [path])
    found = call("lookup", [path], names + nations)
    call("reverse-lookup", [path], [x.split("\t")[0] for x in found[: len(names)]])
    call("common-prefix-search", [path], names)
    call("predictive-search", [path], [""])
    return spark.createDataFrame(lines, "tool string, n long, line string")


def _streamed(spark: SparkSession, sf_dir: str, name: str, column: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table's column as a stream of queries, answered into Parquet files. A stream reads folders: the table's own, or
    the one that its single file lies in."""
    p, fs = _files(spark, sf_dir, name)
    reader = spark.readStream.schema(_table(spark, sf_dir, name).schema)
    stream = reader.parquet(f"{sf_dir}/{name}.parquet") if fs.getFileStatus(p).isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    answered = answer(stream.select(F.col(column).alias("value")))
    answered.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(answered.schema).parquet(out)


@_register(trie_sql(BAGS["customers"]) + "select c_name query, coalesce(key_id, -1) key_id from customer left join ids on k = c_name union all select n_name, -1 from nation")
def stream_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir, "customers")
    parts = [_streamed(spark, sf_dir, t, c, lambda s: streams.lookup_stream(s, d)) for t, c in (("customer", "c_name"), ("nation", "n_name"))]
    return parts[0].unionAll(parts[1]).select(display("query").alias("query"), "key_id")


@_register(trie_sql(BAGS["parts"]) + "select n_name query, count(k) n_found from nation left join ids on starts_with(k, n_name) group by n_name")
def stream_predictive_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir, "parts")
    return _streamed(spark, sf_dir, "nation", "n_name", lambda s: streams.predictive_count_stream(s, d)).select(display("query").alias("query"), "n_found")


@_register(trie_sql(BAGS["sites"]) + "select url query, length(k)::int key_length, key_id, k as \"key\" from pages join ids on starts_with(url, k)")
def stream_common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir, "sites")
    found = _streamed(spark, sf_dir, "pages", "url", lambda s: streams.common_prefix_stream(s, d))
    return found.select(display("query").alias("query"), "key_length", "key_id", display("key").alias("key"))
