"""One registered query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import bpe, byte_bpe, fim, hnsw, langid, ngram_join, packing, pii, prefix_trie, quality, rules, tokenfile, warc

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys have none."""
    return F.crc32(F.col(key).cast("string")) % n


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=5, threshold=(3, 4))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket("doc_id", 5) == 0
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=~held_out)
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket("doc_id", 4) == 2
    found = langid.identify(table(spark, sf_dir, "documents"), learn=~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = tokenfile.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read_token_files(manifest)


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(warc.normalise(archives)).drop("url")


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, units_kept=1_200_000)


@query
def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", pii.spans_text(F.col("found"))).drop("found")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rules.measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = rules.apply_rules(docs, given=rules.MEASURES)
    return judged.select(
        "doc_id",
        *rules.MEASURES,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
    )


SQL["op10_quality_rules"] = r"""
with numbered as (
    select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), cut as (
    select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
    from numbered
), windows as (
    select r, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) as g
    from cut where len(w) >= 3
), repeated as (
    select r, i from (select r, i, count(*) over (partition by r, g) as n from windows) where n > 1
), covered as (
    select r, count(*) as n from (select distinct r, i + k as at from repeated, (select unnest([0, 1, 2]) as k)) group by r
), counted as (
    select doc_id, t, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
           cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
           cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
           len(l) as n_lines, length(t) - length(replace(t, '!', '')) as shouts
    from cut left join covered c using (r)
), based as (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > 3 * n_words or word_chars not between 2 * n_words and 20 * n_words
            or (n_lines >= 4 and 2 * n_dup_lines > n_lines) or 10 * shouts > 3 * n_words) as kept
from based
"""


@query
def op11_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents"), plain_percent=10, spm_percent=20)
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restored().cast("binary"), 256).alias("restored_sha256"),
    )


SQL["op12_fill_in_middle"] = """
with hashed as (
    select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n,
           sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
    from documents
), drawn as (
    select doc_id, t, n,
           cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as a, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as b,
           cast('0x' || substr(h, 17, 8) as bigint) % 100 as keep, cast('0x' || substr(h, 25, 8) as bigint) % 100 as swap
    from hashed
), formed as (
    select *, least(a, b) as lo, greatest(a, b) as hi,
           case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or keep >= 90 then 'plain'
                when swap < 20 then 'spm' else 'psm' end as form
    from drawn
), cut as (
    select *, substr(t, 1, lo) as p, substr(t, lo + 1, hi - lo) as m, substr(t, hi + 1) as s from formed
), made as (
    select *, case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end as output
    from cut
)
select doc_id, n, form,
       case when form <> 'plain' then lo end as prefix_chars,
       case when form <> 'plain' then hi - lo end as middle_chars,
       sha256(output) as output_sha256,
       sha256(case form
           when 'plain' then output
           when 'psm' then substr(output, 4, strpos(output, '<S>') - 4) || substr(output, strpos(output, '<M>') + 3)
               || substr(output, strpos(output, '<S>') + 3, strpos(output, '<M>') - strpos(output, '<S>') - 3)
           else substr(output, strpos(output, '<P>') + 3, strpos(output, '<M>') - strpos(output, '<P>') - 3)
               || substr(output, strpos(output, '<M>') + 3) || substr(output, 4, strpos(output, '<P>') - 4) end) as restored_sha256
from made
"""


@query
def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), lead=(100, 6))


# crc32 by its definition: DuckDB has no function of that name.
SQL["op13_conversation_prefix_trie"] = """
with recursive bytes_of as (
    select distinct conv_id, cast(conv_id as varchar) as d from conversations where conv_id is not null
), crc as (
    select conv_id, d, 0 as i, 4294967295::bigint as c from bytes_of
    union all
    select conv_id, d, i + 1, xor(c // 256, list_reduce(list_prepend(xor(c, ord(d[i + 1])) % 256, range(8)),
        lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end))
    from crc where i < length(d)
), heads as (
    select conv_id, cast(xor(c, 4294967295::bigint) % 6 as bigint) as h, conv_id - conv_id % 100 as donor from crc where i = length(d)
), original as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as nth
    from conversations where conv_id is not null
), joined as (
    select h.conv_id, 0 as part, o.nth, o.role, o.text from heads h join original o on o.conv_id = h.donor and o.nth <= h.h
    union all
    select h.conv_id, 1, o.nth, o.role, o.text from heads h join original o on o.conv_id = h.conv_id and o.nth > h.h
), whole as (
    select conv_id, list({'r': role, 't': text} order by part, nth) as turns from joined group by conv_id
), members as (
    select h.conv_id, coalesce(w.turns, []) as turns, coalesce(len(w.turns), 0) as n from heads h left join whole w on w.conv_id = h.conv_id
), prefixes as (
    select conv_id, n, unnest(range(0, n + 1)) as depth, turns from members
), keyed as (
    select conv_id, n, depth, md5(cast(to_json(turns[1:depth]) as varchar)) as node,
           case when depth > 0 then md5(cast(to_json(turns[1:depth - 1]) as varchar)) end as above,
           case when depth > 0 then length(turns[depth].t) else 0 end as chars
    from prefixes
), nodes as (
    select depth, node, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars,
           coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where n = depth), '') as ends
    from keyed group by depth, node
), children as (
    select depth - 1 as depth, above as node, count(*) as n_children from nodes where depth > 0 group by 1, 2
), below as (
    select distinct a.depth, a.node, b.depth as low_depth, b.node as low from keyed a join keyed b on a.conv_id = b.conv_id and b.depth >= a.depth
), subtrees as (
    select b.depth, b.node, count(*) filter (where c.node is null) as n_leaves, sum((n.n_convs - 1) * n.chars) as saved_tokens
    from below b join nodes n on n.depth = b.low_depth and n.node = b.low
         left join children c on c.depth = b.low_depth and c.node = b.low
    group by 1, 2
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, s.n_leaves,
       cast(s.saved_tokens as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n
    left join nodes p on p.depth = n.depth - 1 and p.node = n.above
    left join children c on c.depth = n.depth and c.node = n.node
    join subtrees s on s.depth = n.depth and s.node = n.node
"""
