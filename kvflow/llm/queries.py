"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest_neighbours
from .automaton import substring_dedup
from .covertree import embedding_components
from .mixing import mix_to_weights
from .packing import pack_documents
from .quality import score_quality
from .secrets import scan_secrets
from .simhash import simhash_components
from .suffix_array import suffix_array_dedup
from .toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_weights(_table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents")).drop("findings")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_suffix_array_dedup, op2_substring_dedup, op3_mixing, op4_nearest_neighbours, op5_quality, op6_packing, op7_toxicity, op8_secrets, op9_simhash_dedup, op10_embedding_dedup]
    return {f.__name__: f for f in found}


REPEATS_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
firsts as (select s, min(doc_id) as m from windows group by s),
gone as (select distinct doc_id, i + k as p from (select doc_id, i from windows join firsts using (s) where m < doc_id), (select unnest(range(50)) as k)),
kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d) anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""

MIXING_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, 2.0::double * source_size as top, 1.5::double * sum(source_size) over () as total from s),
l as (select *, (total - coalesce(sum(top) over (order by top / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by top / w, source nulls last rows between current row and unbounded following) as level from w),
t as (select source, source_size, least(top, coalesce(max(case when level <= top / w then level end) over () * w, top)) as target from l),
p as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from t),
n as (select *, floor(target)::bigint - passes * source_size as need from p),
g as (select source, h, sum(size) as words from d group by source, h),
r as (select *, sum(words) over (partition by source order by h) as upto from g),
e as (select d.doc_id, d.size, n.source_size, n.target, n.passes, n.need, r.words, r.upto from d join n on d.source is not distinct from n.source join r on d.source is not distinct from r.source and d.h = r.h)
select doc_id, size, source_size, target, (passes * size + case when upto <= need then size when upto - words < need then floor(size * (need - upto + words) / words) else 0 end)::bigint as taken from e"""

LINKS_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings), l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, c) as (select vec_id, vec_id from v union select l.b, reach.c from reach join l on l.a = reach.id),
comp as (select id, min(c) as component_id from reach group by id), n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from v join comp on id = vec_id left join n on a = vec_id"""




def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _secrets_sql() -> str:
    names = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
    assign = f"""({names})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
    kinds = [("assign", assign, 2, 12), ("access", "AKIA[A-Z0-9]{14,}", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16), ("live", "[A-Za-z0-9+/_-]{20,}", 0, 20)]
    found = " union all ".join(
        f"""select "row", {k} as kind, list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::bigint as a, length(m[i]) as n, v[i] as v
        from (select "row", g, m, v, unnest(range(1, len(m) + 1)) as i from (select "row", regexp_split_to_array(t, '{p}') as g, regexp_extract_all(t, '{p}', 0) as m, regexp_extract_all(t, '{p}', {group}) as v from d)) where length(v[i]) >= {least}"""
        for k, (_, p, group, least) in enumerate(kinds)
    )
    listed = lambda where: f"string_agg(case kind when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'live' end || ':' || a || ':' || b, ',' order by a, kind) filter (where {where})"
    return f"""
with d as (select row_number() over () as "row", doc_id, coalesce(text, '') as t, source from documents),
f as (select "row", kind, a, a + n as b, v from ({found})),
spans as (select * from f where kind < 3 or (regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') and not exists (select 1 from f as o where o."row" = f."row" and o.kind < 3 and o.a < f.b and f.a < o.b))),
owners as (select v, count(*) as owners from (select distinct v, source from spans join d using ("row")) group by v),
texts as (select v, count(*) as documents from (select distinct v, t from spans join d using ("row")) group by v),
told as (select s.*, not (owners > 2 or (owners > 1 and documents > 20)) as live from spans as s join owners using (v) join texts using (v)),
per as (select "row", count(*) filter (where kind = 0) as n0, count(*) filter (where kind = 1) as n1, count(*) filter (where kind = 2) as n2, {listed("kind < 3")} as base, {listed("kind < 3 or live")} as spans,
    count(*) filter (where live) as n_live, count(*) filter (where kind < 3 and not live) as n_example from told group by "row")
select doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access, coalesce(n2, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
    coalesce(n_live, 0)::bigint as n_live, coalesce(n_example, 0)::bigint as n_example from d left join per using ("row")"""


def oracle_sql() -> dict[str, str]:
    return {"op8_secrets": _secrets_sql(), "op1_suffix_array_dedup": REPEATS_SQL, "op2_substring_dedup": REPEATS_SQL, "op3_mixing": MIXING_SQL, "op10_embedding_dedup": LINKS_SQL}
