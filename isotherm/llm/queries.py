"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import bpe_digest
from .common import WORD, table
from .embedding_dedup import near_vectors
from .fill_middle import fill_in_middle, restored
from .jaccard_join import jaccard_join
from .licenses import license_scan
from .licenses import oracle as license_oracle
from .mixing import mix
from .prefix_trie import prefix_trie
from .repetition import COVERED, LONGEST, quality_rules
from .sharding import shard
from .suffix_dedup import repeats
from .token_counts import token_counts
from .topk import top_k
from .toxicity import toxicity

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Tokens that a document may have in op6.
TOKEN_LIMIT = 1024


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


#: Shares of tokens by domain, in op2.
TARGETS = {"high": 0.5, "low": 0.5}


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled rows: of high or low quality."""
    domain = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, _ = mix(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")), TARGETS)
    p = {f"p_{k}": F.col("posterior")[i] for i, k in enumerate(sorted(TARGETS))}
    return weights.select("doc_id", "n_tokens", *(c.alias(k) for k, c in p.items()), "rate", "copies", "residual")


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), threshold=0.8)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counts.withColumn("over_limit", counts["n_tokens"] > TOKEN_LIMIT)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("spans", "longest_repeat")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


TOP_K_SQL = """
with v as (select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.n, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and c.n <> q.n),
r as (select *, row_number() over (partition by n order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
NEAR_SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where label is not null),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
roots as (select a, min(b) as component_id from reach group by a)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, component_id, e.vec_id = component_id as kept from embeddings e join roots on a = e.vec_id
"""


#: Runs of five words as sets; links by shared runs.
JACCARD_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
g as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as g from w where len(w) > 0),
n as (select doc_id, count(*) as n from g group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a),
roots as (select a, min(b) as class_id from reach group by a)
select d.doc_id, class_id, (select count(*) from links l where l.a = d.doc_id) as n_links, d.doc_id = class_id as kept from documents d join roots on a = d.doc_id
"""


FILL_SQL = """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
h as (select *, cast('0x' || x[1:8] as bigint) % (n + 1) as a, cast('0x' || x[9:16] as bigint) % (n + 1) as b, n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || x[17:24] as bigint) % 100 >= 90 as plain, cast('0x' || x[25:32] as bigint) % 100 < 20 as spm from d),
c as (select *, case when plain then 'plain' when spm then 'spm' else 'psm' end as form, least(a, b) as lo, greatest(a, b) as hi, substring(t, 1, least(a, b)) as p, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) as m, substring(t, greatest(a, b) + 1, n) as s from h)
select doc_id, n, form, case when not plain then lo end as prefix_chars, case when not plain then hi - lo end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(p || m || s) as restored_sha256 from c
"""
#: Repeated spans are the union of repeated runs of five words; a longer repeat is one of LONGEST + 1 words.
QUALITY_SQL = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select k, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
runs as (select k, unnest(list_transform(range(1, len(w) - 3), lambda i: {{'i': i, 'r': array_to_string(w[i:i + 4], ' ')}}), recursive := true) from d where len(w) > 4),
twice as (select k, i from (select k, i, count(*) over (partition by k, r) as c from runs) where c > 1),
inside as (select distinct k, unnest(range(i, i + 5)) as i from twice),
covered as (select k, count(*) as n, sum(length(word)) as chars from inside join words using (k, i) group by 1),
long_ as (select k, count(*) <> count(distinct r) as hit from (select k, unnest(list_transform(range(1, len(w) - {LONGEST} + 1), lambda i: array_to_string(w[i:i + {LONGEST}], ' '))) as r from d where len(w) > {LONGEST}) group by 1),
lines as (select k, count(*) - count(distinct line) as n from (select k, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
s as (select d.k, doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(lines.n, 0) as n_dup_lines,
  coalesce(covered.n, 0) as n_repeat_words, coalesce(covered.chars, 0) as covered_chars, coalesce(hit, false) as hit from d left join lines using (k) left join covered using (k) left join long_ using (k)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s)
select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words, cast(covered_chars as bigint) as covered_chars, base_failed, not base_failed and covered_chars <= {COVERED} * word_chars and not hit as kept from b
"""
#: Prefixes as lists of hashes of turns; CRC-32 bit by bit.
TRIE_SQL = """
with recursive t as (select conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id, length(coalesce(text, '')) as chars, turn from conversations where conv_id is not null),
o as (select conv_id, list(id order by turn nulls first, id) as ids, list(chars order by turn nulls first, id) as chars,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 6 as h from t group by 1),
f as (select c.conv_id, coalesce(b.ids[1:c.h], []) || c.ids[c.h + 1:] as ids, coalesce(b.chars[1:c.h], []) || c.chars[c.h + 1:] as chars from o c left join o b on b.conv_id = c.conv_id - c.conv_id % 100),
p as (select conv_id, unnest(range(0, len(ids) + 1)) as depth, ids, chars from f),
n as (select ids[1:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(case when depth > 0 then chars[depth] else 0 end) as chars, list(conv_id order by conv_id) filter (depth = len(ids)) as ends from p group by 1, 2),
c as (select path[1:depth - 1] as path, count(*) as n_children from n where depth > 0 group by 1),
w as (select n.*, coalesce(n_children, 0) as n_children from n left join c using (path)),
up as (select path[1:d] as path, sum(cast(n_children = 0 as integer)) as n_leaves, sum((n_convs - 1) * chars) as saved from (select *, unnest(range(0, depth + 1)) as d from w) group by 1)
select w.conv_id, w.depth, a.conv_id as parent_conv_id, w.n_convs, w.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(array_to_string(w.ends, ','), '')) as ends_sha256
from w join up on up.path = w.path left join n a on w.depth > 0 and a.path = w.path[1:w.depth - 1]
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_mixing": op2_mixing,
        "op3_bpe_automaton": op3_bpe_automaton,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_exact_topk": op5_exact_topk,
        "op6_token_counts": op6_token_counts,
        "op7_toxicity": op7_toxicity,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_sharding": op9_sharding,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_quality_rules": op12_quality_rules,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_oracle(), "op4_jaccard_join": JACCARD_SQL, "op5_exact_topk": TOP_K_SQL, "op8_embedding_dedup": NEAR_SQL, "op11_fill_in_middle": FILL_SQL, "op12_quality_rules": QUALITY_SQL, "op13_prefix_trie": TRIE_SQL}
