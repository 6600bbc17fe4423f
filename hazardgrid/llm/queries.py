"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_knn import quality

    return quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _tokenizer(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_codec import bpe_roundtrip

    return bpe_roundtrip(_docs(spark, sf_dir), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_docs(spark, sf_dir), _tokenizer("byte_bpe_50k.json").decode())


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_dedup

    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity_svm import toxicity

    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup_documents

    return dedup_documents(_docs(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_docs(spark, sf_dir), _tokenizer("word_bpe_49k.json").decode(), end_id=2)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup_rows

    return suffix_dedup_rows(_docs(spark, sf_dir))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import simhash_dedup

    return simhash_dedup(_docs(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle_rows

    return fill_in_middle_rows(_docs(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_docs(spark, sf_dir)).drop("cleaned_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_bpe_codec": op3_bpe_codec,
        "op4_token_counts": op4_token_counts,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_packing": op8_packing,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_simhash_dedup": op10_simhash_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_whitening": op12_whitening,
        "op13_quality_rules": op13_quality_rules,
    }


_SUBSTRING = r"""with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
    win as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)),
    least as (select k, min(doc_id) as m from win group by k),
    gone as (select distinct doc_id, i + unnest(range(13)) as p from (select doc_id, i from win join least using (k) where m < doc_id)),
    kept as (select doc_id, string_agg(x, ' ' order by p) as s, count(*) as n from (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from w) anti join gone using (doc_id, p) group by doc_id)
    select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256 from w left join kept using (doc_id)"""

_EMBEDDINGS = """with recursive e as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.93),
    reach as (select vec_id, vec_id as r from embeddings union select reach.vec_id, links.b from reach join links on links.a = reach.r)
    select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
    from (select vec_id, min(r) as component_id from reach group by vec_id) left join (select a as vec_id, count(*) as n from links group by a) using (vec_id)"""

_EXACT = """select doc_id, max(doc_id) over t as keep_id, count(*) over t as group_size, doc_id = max(doc_id) over t as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window t as (partition by coalesce(text, ''))"""

_SUFFIX = """with h as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
    win as (select doc_id, i, md5(substr(x, 2 * i + 1, 400)) as k from (select doc_id, x, unnest(range(n - 199)) as i from h)),
    again as (select k from win group by k having count(*) > 1),
    starts as (select doc_id, i from win semi join again using (k)),
    marks as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i) + 200, -1) as opens from starts),
    spans as (select doc_id, s, min(i) as a, max(i) + 200 as b from (select doc_id, i, sum(opens::int) over (partition by doc_id order by i) as s from marks) group by doc_id, s),
    cut as (select doc_id, list(struct_pack(a := a, b := b) order by a) as l, sum(b - a) as gone, count(*) as n_spans from spans group by doc_id)
    select doc_id, n as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
        sha256(unhex(case when l is null then x else array_to_string(list_transform(range(0, len(l) + 1), lambda k: substr(x, 2 * (case when k = 0 then 0 else l[k].b end) + 1, 2 * ((case when k = len(l) then n else l[k + 1].a end) - (case when k = 0 then 0 else l[k].b end)))), '') end)) as kept_sha256
    from h left join cut using (doc_id)"""


_MIDDLE = r"""with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
    k as (select *, len(u) as n, cast('0x' || substr(h, 1, 8) as bigint) % (len(u) + 1) as c1, cast('0x' || substr(h, 9, 8) as bigint) % (len(u) + 1) as c2,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || substr(h, 17, 8) as bigint) % 100 >= 100 then 'plain'
            when cast('0x' || substr(h, 25, 8) as bigint) % 100 < 50 then 'spm' else 'psm' end as form from d),
    p as (select *, array_to_string(u[1 : least(c1, c2)], '') as prefix, array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') as middle, array_to_string(u[greatest(c1, c2) + 1 :], '') as suffix from k)
    select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
        sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256 from p"""


def _rules() -> str:
    from . import quality_rules as q

    r = q.Rules()
    one = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    count = lambda pattern: f"len(regexp_extract_all(line, {one(pattern)}))"
    over = lambda pattern, share: f"100 * {count(pattern)} > {round(100 * share)} * n"
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    w as (select r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
    win as (select r, i, ws[i : i + 2] as k from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
    again as (select r, unnest([i, i + 1, i + 2]) as pos from (select r, i, count(*) over (partition by r, k) as c from win) where c > 1),
    rep as (select r, count(distinct pos) as n from again group by r),
    line0 as (select r, unnest(string_split(t, chr(10))) as line from d),
    line1 as (select r, line, {count(q.WORD)} as n from line0),
    lines as (select *, {over(q.SYMBOL, r.most_symbols)} or {over(q.HEAPED, r.most_heaped)} or ({count(q.SEPARATOR)} >= 2 and {over(q.SEPARATOR, r.most_separators)})
        or (not regexp_matches(right(rtrim(line, {space}), 4), {one(q.END)}) and {count(q.MARK)} * {r.words_a_mark} < n) or (n < {r.boilerplate_words} and regexp_matches(line, {one(q.BOILERPLATE)})) as fails from line1 where n > 0),
    tested as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines, count(*) filter (fails) as n_failed_lines, sum(n) filter (fails) as n_lost_words from lines group by r),
    counts as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(t) - length(regexp_replace(t, {one(q.SYMBOL)}, '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
        coalesce(n_lines, 0) as n_lines, coalesce(n_failed_lines, 0) as n_failed_lines, cast(coalesce(n_lost_words, 0) as bigint) as n_lost_words from d join w using (r) left join rep using (r) left join tested using (r))
    select *, n_words < {r.min_words} or 100 * n_repeat_words > {round(100 * r.most_repeated)} * n_words as base_failed, not (n_words < {r.min_words} or 100 * n_repeat_words > {round(100 * r.most_repeated)} * n_words) and 100 * n_lost_words <= {round(100 * r.most_lost)} * n_words as kept from counts"""


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; ids are taken as not null and different."""
    return {"op2_substring_dedup": _SUBSTRING, "op5_embedding_dedup": _EMBEDDINGS, "op7_exact_dedup": _EXACT, "op9_suffix_dedup": _SUFFIX, "op11_fill_in_middle": _MIDDLE, "op13_quality_rules": _rules()}
