"""The queries of this subpackage: thin, each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .context_mixing import lm_scores
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .licenses import NOTICES, PHRASES, edits_allowed, license_scan, pieces
from .mixing import mix_sources
from .neardup import near_duplicates
from .sharding import shard_documents
from .suffix_dedup import remove_repeats
from .toxicity import toxicity
from .warc import warc_round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_documents(spark, sf_dir))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir)).drop("spans")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), k=4, percent=80).drop("text_key")


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_shards, op2_toxicity, op3_exact_dedup, op4_decontaminate, op5_lm_scores, op6_mix_sources, op7_warc, op8_license_scan, op9_near_duplicates, op10_remove_repeats)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _values(rows: list[tuple], names: str) -> str:
    """Rows of strings and whole numbers as a table in SQL."""
    cells = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
    return f"(values {cells}) {names}"


_LICENSES = rf"""
    with s as (select doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_NO_WORD}', ' ', 'g')) as t from documents),
    w as (select doc_id, t, case when t = '' then []::varchar[] else string_split(t, ' ') end as words from s),
    places as (select doc_id, words, unnest(range(0, len(words))) as i from w),
    base as (
        select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_sort(list(distinct label)) as labels
        from places, {_values([(p, x, len(p.split())) for p, x in PHRASES.items()], "p(phrase, label, k)")} where words[i + 1 : i + k] = string_split(phrase, ' ') group by 1
    ),
    -- A stretch with at most e edits holds one of the e + 1 pieces of its notice.
    notice as (select * from {_values([(n, x, edits_allowed(n), q) for n, x in NOTICES.items() for _, q in pieces(n)], "n(notice, label, e, piece)")}),
    likely as (select distinct doc_id, regexp_replace(t, '[^\x00-\x7F]', '~', 'g') as t, words, notice, label, e from w, notice where contains(t, piece)),
    ends as (select doc_id, notice, unnest(range(0, len(words))) as i, unnest(list_transform(words, lambda x: length(x))) as n from likely),
    edge as (select doc_id, notice, sum(n + 1) over (partition by doc_id, notice order by i) - n - 1 as a, sum(n + 1) over (partition by doc_id, notice order by i) - 1 as b from ends),
    near as (
        select l.doc_id, label, y.b - x.a as n, levenshtein(l.notice, substr(l.t, x.a::bigint + 1, (y.b - x.a)::bigint)) as d, e
        from likely l join edge x on l.doc_id = x.doc_id and l.notice = x.notice join edge y on l.doc_id = y.doc_id and l.notice = y.notice and y.b - x.a between length(l.notice) - e and length(l.notice) + e
    ),
    fuzzy as (select doc_id, list(distinct label) as labels, max(1 - d::double / n::double) as score from near where d <= e group by 1)
    select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(array_to_string(base.labels, ','), '') as base_labels,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(fuzzy.labels, [])))), ',') as labels,
        case when n_base > 0 then 1e0 else coalesce(score, 0e0) end as score
    from w left join base using (doc_id) left join fuzzy using (doc_id)
"""

_CONTAMINATION = rf"""
    with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_NO_WORD}'), lambda x: x <> '') as w from documents),
    b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_NO_WORD}'), lambda x: x <> '') as w from benchmark),
    items as (select item_id, len(w) as m, least(len(w), 5) as q, w from b where len(w) > 0),
    of_items as (select item_id, m, q, unnest(list_transform(range(0, m - q + 1), lambda i: array_to_string(w[i + 1 : i + q], ' '))) as run from items),
    weights as (select item_id, m, q, run, count(*) as b from of_items group by all),
    of_docs as (select doc_id, len(w) as n, q, unnest(range(0, len(w) - q + 1)) as pos, unnest(list_transform(range(0, len(w) - q + 1), lambda i: array_to_string(w[i + 1 : i + q], ' '))) as run from d, (select distinct q from items)),
    hits as (select *, greatest(0, least(pos, n - m)) as top, greatest(0, pos + q - m) as low from of_docs join weights using (q, run)),
    shared as (select doc_id, item_id, m, n, b, run, unnest(range(least(low, top), top + 1)) as start from hits),
    counted as (select doc_id, item_id, m, n, start, run, least(count(*), any_value(b)) as met from shared group by all),
    pairs as (select doc_id, item_id, greatest(1, least(m, n) - 4) as own, greatest(1, m - 4) as whole, start, sum(met) as met from counted group by doc_id, item_id, m, n, start),
    best as (select doc_id, item_id, max(met::double / (own + whole - met)::double) as similarity from pairs group by 1, 2 having max(met::double / (own + whole - met)::double) >= 0.8),
    docs as (select doc_id, count(*) as n_items, max(similarity) as similarity, arg_min(item_id, (-similarity, item_id)) as item_id from best group by 1)
    select doc_id, n_items is not null as contaminated, coalesce(n_items, 0) as n_items, item_id, similarity from documents left join docs using (doc_id)
"""

_NEAR_DUPLICATES = rf"""
    with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ 	-
]+'), lambda x: x <> '') as words from documents),
    shingles as (
        select distinct doc_id, unnest(case when len(words) between 1 and 3 then [array_to_string(words, ' ')] else list_transform(range(0, len(words) - 3), lambda i: array_to_string(words[i + 1 : i + 4], ' ')) end) as shingle from w
    ),
    sizes as (select doc_id, count(*) as n from shingles group by 1),
    common as (select a.doc_id as u, b.doc_id as v, count(*) as c from shingles a join shingles b using (shingle) where a.doc_id <> b.doc_id group by 1, 2),
    links as materialized (select u, v from common join sizes x on u = x.doc_id join sizes y on v = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
    reach as (select doc_id as u, doc_id as v from documents union select reach.u, links.v from reach join links on reach.v = links.u),
    least as (select u as doc_id, min(v) as component_id from reach group by 1)
    select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from least left join sizes using (doc_id)
"""

_REPEATS = """
    with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
    p as (select doc_id, b, unnest(range(0, n - 99)) as p from d),
    w as (select doc_id, p, row_number() over (partition by b[p + 1 : p + 100] order by doc_id, p) as k from p),
    r as (select doc_id, p, coalesce(p - lag(p) over (partition by doc_id order by p) > 100, true) as fresh from w where k > 1),
    i as (select doc_id, p, sum(fresh::int) over (partition by doc_id order by p) as run from r),
    x as (select doc_id, run, min(p) as a, max(p) + 100 as z from i group by 1, 2),
    y as (select *, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from x),
    g as (select doc_id, sum(z - a)::bigint as n_removed, count(*) as n_spans, max(z) as last, string_agg(hex(b[before + 1 : a]), '' order by a) as kept from y join d using (doc_id) group by 1)
    select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1 : n]))) as kept_sha256
    from d left join g using (doc_id)
"""

ORACLE_SQL = {
    "op3_exact_dedup": r"""
        with t as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
        g as (select text_sha256, count(*) as group_size, arg_min(doc_id, (-n, doc_id)) as keep_id from t group by 1)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
    """,
    "op4_decontaminate": _CONTAMINATION,
    "op8_license_scan": _LICENSES,
    "op9_near_duplicates": _NEAR_DUPLICATES,
    "op10_remove_repeats": _REPEATS,
    "op7_warc": """
        with t as (select page_id, encode(coalesce(html, '')) as body from pages),
        d as (select page_id, octet_length(body) as payload_bytes, sha1(body) as payload_digest from t),
        k as (select payload_digest, max(page_id) as keeper from d where payload_bytes >= 1000 group by 1)
        select page_id, payload_bytes, payload_digest,
            case when keeper is not null and keeper <> page_id then 'revisit' else 'response' end as record_type,
            case when keeper <> page_id then keeper end as refers_to
        from d left join k using (payload_digest)
    """,
}
