"""The subpackage's registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, fingerprints, jaccard_join, language_id, mixing, pii, suffix_dedup, token_counts, url_filters
from .common import table

#: For the registered query only; whoever keeps pseudonyms has a key of their own.
DEMO_KEY = b"shardloom demonstration key"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.trained_on(docs)).withColumn("held_out", language_id.held_out())


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1,
    "op2_ngram_jaccard_join": op2,
    "op3_source_mixing": op3,
    "op4_suffix_array_dedup": op4,
    "op5_exact_dedup": op5,
    "op6_pii": op6,
    "op7_language_id": op7,
    "op8_bpe": op8,
    "op9_document_fingerprints": op9,
    "op10_token_counts": op10,
    "pipeline": pipeline,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""
        with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
        s as (
            select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [ws]
                else list_transform(range(1, len(ws) - 2), lambda i: ws[i : i + 3]) end) as sh from w),
        c as (select min(doc_id) as rep, sh from s where len(sh) > 0 group by sh),
        g as (select rep, unnest(sh) as x, len(sh) as n from c),
        p as (select a.rep as a, b.rep as b from g a join g b on a.x = b.x and a.rep < b.rep
            group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        e as (select a, b from p union all select b, a from p),
        r(node, root) as (select rep, rep from c union select e.b, r.root from r join e on e.a = r.node where r.root < e.b),
        m as (select node, min(root) as root from r group by node)
        select s.doc_id, len(s.sh)::bigint as n_shingles, coalesce(m.root, s.doc_id) as component_id
        from s left join c on s.sh = c.sh left join m on m.node = c.rep""",
    "op4_suffix_array_dedup": """
        with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
        w as (select doc_id, i, b[i : i + 49] as s from d, unnest(range(1, octet_length(b) - 48)) t(i)),
        f as (select s, min(doc_id) as least from w group by s),
        h as (select w.doc_id, w.i from w join f on w.s = f.s where f.least < w.doc_id),
        e as (select *, (i > coalesce(lag(i) over (partition by doc_id order by i), -100) + 50)::int as new from h),
        g as (select *, sum(new) over (partition by doc_id order by i) as g from e),
        r as (select doc_id, g, min(i) as a, max(i) + 49 as z from g group by doc_id, g),
        k as (select *, coalesce(lag(z) over (partition by doc_id order by g), 0) + 1 as from_ from r),
        p as (select k.doc_id, sum(z - a + 1)::bigint as gone, count(*) as spans, max(z) as last, string_agg(hex(d.b[from_ : a - 1]), '' order by g) as kept from k join d on d.doc_id = k.doc_id group by k.doc_id)
        select d.doc_id, octet_length(b)::bigint as n_bytes, coalesce(gone, 0) as n_removed, coalesce(spans, 0) as n_spans,
            sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1 :]))) as kept_sha256
        from d left join p on p.doc_id = d.doc_id""",
    "op5_exact_dedup": f"""
        with d as (select doc_id, {_LOWER} as t from documents),
        k as (select doc_id, t, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from k""",
}
