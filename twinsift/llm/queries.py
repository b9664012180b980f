"""The queries that apply each operator to its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, langid, licenses, merkle, mixing, panes, pii, quality, sharding, simhash, topk, toxicity
from .common import read_table

#: The rank file by which documents are encoded.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


#: Full sort in place of histograms: in each source the documents in order of their hashes.
MIXING_SQL = """
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(concat_ws(':', doc_id::varchar, md5(text))), 1, 15))::bigint as h
  from documents
), sizes as (
  select source, sum(size)::bigint as source_size,
    row_number() over (order by source nulls last) as place
  from docs group by source
), ranked as (
  select *, 3.0::double * source_size as bound,
    (case (place - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double as weight
  from sizes
), filled as (
  select *, bound / weight as reach,
    (sum(source_size::double) over () - (sum(bound) over w - bound))
      / (sum(weight) over () - sum(weight) over w + weight) as level
  from ranked
  window w as (order by bound / weight, place rows unbounded preceding)
), leveled as (
  select source, source_size, least(bound, weight * (
    select arg_min(level, (reach, place)) from filled where level <= reach)) as target
  from filled
), planned as (
  select *, case when source_size > 0 then least(3, floor(target / source_size)) else 0 end as times
  from leveled
), ordered as (
  select d.*, p.source_size, p.target, p.times,
    case when p.times < 3 then p.target - p.times * p.source_size else 0 end as budget,
    sum(d.size) over (partition by d.source order by d.h) as through,
    sum(d.size) over (partition by d.source, d.h) as tied,
    row_number() over (partition by d.source, d.h) as number
  from docs d join planned p on d.source is not distinct from p.source
)
select doc_id, size, source_size::bigint as source_size, target,
  (size * (times + case when through <= budget then 1
    when through - tied <= budget and 2 * (budget - (through - tied) - (number - 1) * size) >= size then 1
    else 0 end))::bigint as taken
from ordered
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), RANKS)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


#: The chain's categories, in order, over the table ``labels``.
CATEGORIES = {"poor": "1 - quality", "toxic": "toxic"}


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.classify(read_table(spark, sf_dir, "documents"), labels, CATEGORIES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


TOPK_SQL = """
with rows as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)) as x
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.n, q.vec_id as query_id, r.vec_id, list_inner_product(q.x, r.x)::bigint as score
  from rows q join rows r on q.n <> r.n where q.vec_id % 100 = 0
), ranked as (
  select query_id, row_number() over (partition by n order by score desc, vec_id nulls last) as rank,
    vec_id, score
  from scored
)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 10
"""


def op11_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


EMBED_SQL = """
with recursive vectors as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings
), sound as (
  select * from vectors
  where len(x) > 0 and len(list_filter(x, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(x, lambda v: v <> 0)) > 0
), near as (
  select a.n as a, b.n as b from sound a join sound b on len(a.x) = len(b.x) and a.n <> b.n
  where list_cosine_similarity(a.x, b.x) >= 0.9
), reached as (
  select n as a, n as b from vectors
  union
  select r.a, near.b from reached r join near on r.b = near.a
), named as (
  select r.a as n, min(v.vec_id) as component_id from reached r join vectors v on r.b = v.n group by r.a
), degrees as (select a as n, count(*) as n_links from near group by a)
select v.vec_id, coalesce(d.n_links, 0)::bigint as n_links, c.component_id,
  v.vec_id is not distinct from c.component_id as kept
from vectors v join named c using (n) left join degrees d using (n)
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


#: crc32 of a number's decimal text, as a list of bytes run through the table of the reflected polynomial.
CRC_SQL = """
crc as (
  select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when c & 1 = 1
    then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t
)
"""


def _crc(column: str) -> str:
    """SQL for the checksum of a column's decimal text; ``t`` is the table of ``CRC_SQL``."""
    steps = f"list_transform(string_split({column}::varchar, ''), lambda x: ascii(x)::bigint)"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)"


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen(({value})::varchar) || ':' || ({value})::varchar end"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


MERKLE_SQL = f"""
with recursive {CRC_SQL}, docs as (
  select row_number() over () as r, doc_id, lang, {_leaf('n_chars')} as leaf,
    case when {_crc('doc_id')} % 7 = 0 then {_leaf('n_chars + 1')} end as tampered
  from documents, crc
), leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by lang) as n
  from docs
), tree as (
  select lang, 0 as lvl, pos, n, leaf as node from leaves
  union all
  select lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' order by pos)) from tree where n > 1
  group by lang, lvl, pos // 2, n
), subroots as (
  select lang, lvl as height, node as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n
  from tree where n = 1
), outer_tree as (
  select 0 as lvl, pos, n, subroot as node from subroots
  union all
  select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' order by pos)) from outer_tree where n > 1
  group by lvl, pos // 2, n
), steps as (
  select l.r, k.lvl, (l.pos >> k.lvl) & 1 as side, t.node
  from leaves l join subroots s on l.lang is not distinct from s.lang join (select unnest(range(64)) as lvl) k on k.lvl < s.height
  left join tree t on t.lang is not distinct from l.lang and t.lvl = k.lvl and t.pos = xor(l.pos >> k.lvl, 1)
  union all
  select l.r, s.height + k.lvl, (s.pos >> k.lvl) & 1, t.node
  from leaves l join subroots s on l.lang is not distinct from s.lang
  join (select max(lvl) as top from outer_tree) o on true join (select unnest(range(64)) as lvl) k on k.lvl < o.top
  left join outer_tree t on t.lvl = k.lvl and t.pos = xor(s.pos >> k.lvl, 1)
), proofs as (
  select r, sha256(coalesce(string_agg(coalesce(node, ''), '' order by lvl), '')) as proof_sha256, count(lvl) as height
  from leaves left join steps using (r) group by r
), folded as (
  select r, 0 as lvl, coalesce(tampered, leaf) as node from leaves
  union all
  select f.r, f.lvl + 1, sha256(case when s.node is null then f.node when s.side = 1 then s.node || f.node else f.node || s.node end)
  from folded f join steps s on s.r = f.r and s.lvl = f.lvl
)
select l.doc_id, l.leaf, s.subroot, t.node as root, p.proof_sha256, f.node as folded_root, f.node = t.node as verified
from leaves l join subroots s on l.lang is not distinct from s.lang join proofs p using (r) join folded f on f.r = l.r and f.lvl = p.height
join outer_tree t on t.n = 1
"""


def op13_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.revisions(read_table(spark, sf_dir, "clicks"))


PANES_SQL = f"""
with {CRC_SQL}, once as (
  select distinct on (click_id) click_id, ts, coalesce(kind, 'none') as kind,
    coalesce(floor(100 * case when isfinite(value) then value end + 0.5), 0)::bigint as cents,
    date_diff('day', date '1970-01-01', coalesce(arrived_at, ts)::date) as d
  from clicks where ts is not null order by click_id, arrived_at nulls last, ts, kind nulls first, value nulls first
), timed as (
  select *, epoch_us(ts) - (d - d % 12) * 86400000000 as event,
    least(11, d % 12 + greatest(0, coalesce({_crc('click_id')} % 30 - 23, 0))) as batch
  from once, crc
), placed as (
  select *, (event - ((event % 3600000000) + 3600000000) % 3600000000) // 3600000000 as hour from timed
), marks as (
  select b, max(event) as w from (select unnest(range(12)) as b) left join placed on batch < b group by b
), told as (
  select p.*, coalesce(w >= (hour + 1) * 3600000000 + 3 * 86400000000, false) as late from placed p join marks on b = batch
), fresh as (
  select kind, hour, batch, count(*) as n, sum(cents) as c from told where not late group by all
), running as (
  select *, sum(n) over w as n_through, sum(c) over w as c_through, min(batch) over (partition by kind, hour) as opened
  from fresh window w as (partition by kind, hour order by batch)
), emitted as (
  select kind, hour, coalesce(min(b), 11) as shown, min(b) is null as never
  from (select distinct kind, hour, opened from running)
  left join marks on b >= opened and w >= (hour + 1) * 3600000000 + 7200000000
  group by kind, hour
), records as (
  select shown as batch, hour, -1 as click_id, sum(n) as n_rows, sum(c) as cents, if(never, 'final', 'emit') as record, kind
  from emitted join fresh using (kind, hour) where batch <= shown group by kind, hour, shown, never
  union all
  select r.batch, hour, -1, n_through - n, c_through - c, 'retract', kind from running r join emitted using (kind, hour) where r.batch > shown
  union all
  select r.batch, hour, -1, n_through, c_through, 'replace', kind from running r join emitted using (kind, hour) where r.batch > shown
  union all
  select batch, hour, click_id, 1, cents, 'late', kind from told where late
)
select batch::bigint as batch, hour::bigint as hour, click_id::bigint as click_id, n_rows::bigint as n_rows, cents::bigint as cents, record, kind
from records
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_bpe": op2_bpe, "op3_langid": op3_langid, "op4_toxicity": op4_toxicity, "op5_quality": op5_quality, "op6_licenses": op6_licenses, "op7_sharding": op7_sharding, "op8_simhash": op8_simhash, "op9_topk": op9_topk, "op10_pii": op10_pii, "op11_embed_dedup": op11_embed_dedup, "op12_merkle": op12_merkle, "op13_panes": op13_panes}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIXING_SQL, "op9_topk": TOPK_SQL, "op11_embed_dedup": EMBED_SQL, "op12_merkle": MERKLE_SQL, "op13_panes": PANES_SQL}
