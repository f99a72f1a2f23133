"""The queries of this subpackage: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covertree import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def url_list(pages: DataFrame) -> DataFrame:
    """Dated entries made by a rule from the hosts of the pages: of the hash h of a host or domain, h % 3 names the list, h % 4 says whether it was listed, removed and listed again."""
    from .urlfilter import HOST

    host = pages.select(F.lower(F.regexp_extract("url", HOST, 1)).alias("host")).where("host != ''").distinct()
    keys = host.select(F.col("host").alias("key")).union(host.select(F.regexp_extract("host", r"\.([^.]+\.[^.]+)$", 1).alias("key")).where("key != ''")).distinct()
    h = F.conv(F.substring(F.md5("key"), 1, 7), 16, 10).cast("long")
    keys = keys.withColumn("h", h).withColumn("list", F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("phishing")), (F.col("h") % 3 + 1).cast("int")))
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int"))
    add = F.struct(F.lit("add").alias("action"), day(F.col("h") % 200).alias("at"))
    off = F.when(F.col("h") % 4 >= 2, F.struct(F.lit("remove").alias("action"), day(F.col("h") % 200 + 30 + F.col("h") % 50).alias("at")))
    on = F.when(F.col("h") % 4 == 3, F.struct(F.lit("add").alias("action"), day(F.col("h") % 200 + 120 + F.col("h") % 70).alias("at")))
    return keys.where("h % 4 >= 1").select("key", "list", F.explode(F.array_compact(F.array(add, off, on))).alias("e")).select("key", "list", "e.*")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import filter_captures

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7 % 365).cast("int")))
    out = filter_captures(captures, url_list(pages))
    return out.select("page_id", "url", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), F.array_join("_lists", ",").alias("lists"), F.col("_blocked").alias("blocked"))


OP9_SQL = r"""
with hosts as (select distinct lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]*)', 1)) as host from pages),
keys0 as (select host as key from hosts where host != '' union select regexp_extract(host, '\.([^.]+\.[^.]+)$', 1) from hosts),
keys as (select key, ('0x' || substr(md5(key), 1, 7))::bigint as h from keys0 where key != ''),
own as (
  select key, h % 3 as l, date '2024-01-01' + (h % 200)::int as since, case when h % 4 >= 2 then date '2024-01-01' + (h % 200 + 30 + h % 50)::int end as until from keys where h % 4 >= 1
  union all select key, h % 3, date '2024-01-01' + (h % 200 + 120 + h % 70)::int, null from keys where h % 4 = 3),
caps as (select page_id, url, date '2024-01-01' + (page_id * 7 % 365)::int as fetched, lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]*)', 1)) as host from pages),
looked as (select page_id, list(distinct ['adult', 'malware', 'phishing'][l + 1]) as lists
  from caps join own on (key = host or key = regexp_extract(host, '\.([^.]+\.[^.]+)$', 1)) and key != '' and since <= fetched and (until is null or fetched < until) group by page_id)
select c.page_id, url, strftime(fetched, '%Y-%m-%d') as fetched, coalesce(array_to_string(list_sort(lists), ','), '') as lists, lists is not null as blocked from caps c left join looked using (page_id)
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


OP2_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id != c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

OP7_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w where len(w) >= 13),
g as (select doc_id, i, min(doc_id) over (partition by w[i:i + 12]) as least from p),
c as (select distinct doc_id, unnest(range(i, i + 13)) as j from g where least < doc_id),
r as (select doc_id, list(j) as gone, count(*) as n from c group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(case when n is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(gone, x[2])), lambda x: x[1]) end, ' '), '')) as kept_sha256
from w left join r using (doc_id)
"""

OP5_SQL = """
with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0 and label is not null),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id != b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
reach as (with recursive r(node, root) as (select vec_id, vec_id from embeddings union select l.b, r.root from r join l on l.a = r.node) select node, min(root) as root from r group by node),
n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, root as component_id, vec_id = root as kept from embeddings join reach on node = vec_id left join n on a = vec_id
"""


def _op6_sql() -> str:
    """Containment from the places where a template's shingles begin: a window holds those that begin in its first words."""
    from .licenses import CONTAINED, SHINGLE, TEMPLATES, shingles, words_of

    spec = {name: words_of(t) for name, t in TEMPLATES.items()}
    rows = ", ".join(f"('{name}', {len(w)}, {min(SHINGLE, len(w))}, {len(shingles(w))}, '{s}')" for name, w in spec.items() for s in shingles(w))
    return rf"""
with known(license, length, size, every, s) as (values {rows}),
w as (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x != '') as w from documents where text is not null),
sizes as (select distinct size from known),
g as (select doc_id, len(w) as n, size, unnest(range(1, len(w) - size + 2)) as i, w from w, sizes where len(w) >= size),
p as (select doc_id, n, license, length, size, every, s, i - 1 as spot from g join known using (size) where s = array_to_string(w[i:i + size - 1], ' ')),
q as (select doc_id, license, every, s, unnest(range(greatest(spot - length + size, 0), least(spot, greatest(n - length, 0)) + 1)) as spot from p),
c as (select doc_id, license, spot, count(distinct s) / any_value(every) as contained from q group by doc_id, license, spot)
select doc_id, license, max(contained)::double as contained, min(spot)::bigint as first_word, count(*) as n_windows from c where contained >= {CONTAINED} - 1e-9 group by doc_id, license
"""


OP10_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, unnest(list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from w),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from g a join g b on a.s = b.s and a.doc_id != b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
reach as (with recursive r(node, root) as (select doc_id, doc_id from documents union select l.b, r.root from r join l on l.a = r.node) select node, min(root) as root from r group by node)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, root as component_id from documents d join reach on node = d.doc_id left join n on n.doc_id = d.doc_id
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import best_phrases, collocations

    return best_phrases(collocations(_table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as t from documents),
w as (select lang, regexp_extract_all(t, '[^\x20\x09]+') as w from p),
g as (select lang, k, w, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3)) s(k) where len(w) >= k),
f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as a from g group by all),
c as (select lang, k, phrase, string_split(phrase, ' ') as w, a, unnest(range(1, k)) as spot from f where k > 1 and a >= 10),
s as (select c.lang, c.k, c.phrase, c.w, c.a, c.spot, x.a as l, y.a as r, ((1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a))::bigint as score
  from c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.spot], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.spot + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, spot) = 1),
o as (select lang, phrase, max(a) as most from (select lang, array_to_string(w[1:2], ' ') as phrase, a from b where k = 3 union all select lang, array_to_string(w[2:3], ' '), a from b where k = 3) group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang)
select b.lang, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase) as rank, b.phrase, b.a, l, r, n.n, score
from b join n on n.lang = b.lang left join o on o.lang = b.lang and o.phrase = b.phrase and b.k = 2 where most is null or 100 * most < 50 * b.a
qualify rank <= 2000
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import payloads_of, read_archives, write_archives

    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(_table(spark, sf_dir, "pages"), folder)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    r = payloads_of(read_archives(spark, folder))
    return r.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


OP12_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as n, sha1(b) as h from p),
m as (select *, max(page_id) over (partition by h, n) as last from d)
select page_id, n as payload_bytes, h as payload_digest, case when n >= 1000 and page_id != last then 'revisit' else 'response' end as record_type, case when n >= 1000 and page_id != last then last end as refers_to from m
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixes import prefix_trie, rebuilt

    t = prefix_trie(rebuilt(_table(spark, sf_dir, "conversations")))
    return t.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP13_SQL = """
with own as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos from conversations where conv_id is not null),
ids as (select distinct conv_id, conv_id::varchar as name, conv_id - conv_id % 100 as base from own),
h as (select conv_id, base, xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::ubigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint) % 6 as h from ids),
parts as (select h.conv_id, 0 as part, pos, role, text from h join own on own.conv_id = base and pos <= h
  union all select own.conv_id, 1, pos, role, text from own join h using (conv_id) where pos > h),
rows as (select conv_id, row_number() over (partition by conv_id order by part, pos) as d, {'role': role, 'text': text} as t from parts),
entire as (select h.conv_id, coalesce(list(t order by d) filter (d is not null), []) as turns from h left join rows using (conv_id) group by h.conv_id),
spots as (select conv_id, len(turns) as n, unnest(range(0, len(turns) + 1)) as depth, turns from entire),
node as (select depth, turns[1:depth] as k, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * coalesce(length(turns[depth].text), 0) as own,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) as ends_sha256 from spots group by depth, turns[1:depth], turns[depth]),
kids as (select node.conv_id, node.depth, p.conv_id as parent_conv_id from node left join node p on p.depth = node.depth - 1 and p.k = node.k[1:node.depth - 1]),
many as (select parent_conv_id, depth - 1 as depth, count(*) as n_children from kids where parent_conv_id is not null group by all),
leaf as (select a.conv_id, a.depth, count(*) filter (m.n_children is null) as n_leaves, sum(b.own)::bigint as saved_tokens
  from node a join node b on b.depth >= a.depth and b.k[1:a.depth] = a.k left join many m on m.parent_conv_id = b.conv_id and m.depth = b.depth group by a.conv_id, a.depth)
select node.conv_id, node.depth::bigint as depth, kids.parent_conv_id, n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves, saved_tokens, ends_sha256
from node join kids using (conv_id, depth) join leaf using (conv_id, depth) left join many on many.parent_conv_id = node.conv_id and many.depth = node.depth
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_exact_top_k, op3_toxicity, op4_html_text, op5_embedding_dedup, op6_license_scan, op7_substring_dedup, op8_best_fit_packing, op9_url_filter, op10_jaccard_join, op11_collocations, op12_warc, op13_prefix_trie, pipeline)}
ORACLE_SQL = {"op2_exact_top_k": OP2_SQL, "op5_embedding_dedup": OP5_SQL, "op6_license_scan": _op6_sql(), "op7_substring_dedup": OP7_SQL, "op9_url_filter": OP9_SQL, "op10_jaccard_join": OP10_SQL, "op11_collocations": OP11_SQL, "op12_warc": OP12_SQL, "op13_prefix_trie": OP13_SQL}
