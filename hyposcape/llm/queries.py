"""Registered queries of the corpus operators: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, embedding_dedup, html_text, line_dedup, mixing, packing, quality, simhash, sketches, url_filter, vector_codes, whitening
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


LINES_SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
common as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (
  select keyed.*, common.k is not null and doc_id <> keeper as dropped from keyed left join common on keyed.k = common.k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (dropped)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from marked group by doc_id"""


@query("op6_line_dedup", LINES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(read(spark, sf_dir, "documents"))


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components_of(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


MIX_SQL = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
src as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from sized group by source),
capped as (
  select *, source_size * 3 as cap, sum(source_size) over () as total, sum(w) over () as w_all from src),
levels as (
  select *, (total - coalesce(sum(cap) over o, 0))::double / (w_all - coalesce(sum(w) over o, 0)) as level, cap / w as ratio
  from capped window o as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
target as (
  select source, source_size, least((select level from levels where level <= ratio order by ratio, source nulls last limit 1) * w, cap::double) as target from levels),
rated as (
  select *, case when source_size > 0 then least(floor(target / source_size * 268435456 + 0.5), 805306368)::bigint else 0 end as rate,
    ('0x' || substr(md5(coalesce(source, chr(0) || 'null') || '|mix-offset'), 1, 8))::bigint & 268435455 as off from target),
ordered as (
  select sized.source, sized.doc_id, sized.size, r.source_size, r.target, r.rate, r.off, row_number() over (
    partition by sized.source order by floor(8 * ln(sized.size + 1) / ln(2.0) + 1e-9),
    ('0x' || substr(md5(coalesce(sized.doc_id::varchar, 'null') || '|mix'), 1, 8))::bigint, sized.doc_id, sized.size) as k
  from sized join rated r on sized.source is not distinct from r.source),
tried as (
  select source, j, abs(sum(size * (((k * rate + o) >> 28) - (((k - 1) * rate + o) >> 28)))::bigint - any_value(target)) as d, any_value(o) as o
  from (select *, (off + j * 16777216) & 268435455 as o from ordered, (select unnest(range(16)) as j)) group by source, j),
chosen as (select source, o from tried qualify row_number() over (partition by source order by d, j) = 1)
select doc_id, size, source_size, target, (size * (((k * rate + o) >> 28) - (((k - 1) * rate + o) >> 28)))::bigint as taken
from ordered join chosen on ordered.source is not distinct from chosen.source"""


@query("op8_source_mixing", MIX_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(read(spark, sf_dir, "documents"))


URL_SQL = """
with rules(domain, prefix, what) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests as (
  select row_number() over () as r, page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
urls as (
  select r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests),
ruled as (
  select u.*, x.domain || x.prefix as rule, x.what, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
    lambda s: case when length(s) >= 16 and regexp_matches(s, '[0-9]') then '*' else regexp_replace(s, '[0-9]+', '#', 'g') end) as seg
  from urls u left join rules x on (u.host = x.domain or suffix(u.host, '.' || x.domain)) and starts_with(u.path, x.prefix)
  qualify row_number() over (partition by r order by length(x.domain || x.prefix) desc) = 1),
shapes as (
  select host, seg, count(*) as n, count(what) as lab, count(*) filter (what = 'block') as blk from ruled group by host, seg),
cells as (select host, len(seg) as l, n, unnest(range(1, len(seg) + 1)) as pos, unnest(seg) as v from shapes),
vals as (select host, l, pos, v, sum(n) as n from cells group by host, l, pos, v),
own_segments as (select host, l, pos from vals group by host, l, pos having count(*) >= 20 and 2 * count(*) >= sum(n)),
variable as (select host, l, list(pos) as places from own_segments group by host, l),
shaped as (
  select s.host, seg, list_transform(seg, lambda x, i: case when list_contains(coalesce(places, []), i) then '*' else x end) as t, n, lab, blk
  from shapes s left join variable v on s.host = v.host and len(seg) = v.l),
templates as (select host, t, sum(n) as n, sum(lab) as lab, sum(blk) as blk from shaped group by host, t),
walked as (
  select *, array_to_string(t[1:depth], '/') as node, case when depth > 0 then array_to_string(t[1:depth - 1], '/') end as parent,
    array_to_string(list_transform(t[depth + 1:], lambda s: case when s = '*' then '*' when contains(s, '#') then '#' else 'a' end), '/') as cell
  from (select *, unnest(range(0, len(t) + 1)) as depth from templates)),
nodes as (select host, depth, node, parent, sum(n) as n, sum(lab) as lab, sum(blk) as blk from walked group by host, depth, node, parent),
pairs as (
  select a.*, b.lab as plab, (b.blk + 1)::double / (b.lab + 2) as p
  from nodes a left join nodes b on a.host = b.host and a.depth = b.depth + 1 and a.parent = b.node),
anchors as (
  select host, depth, node from pairs where plab is null or (lab = 0 and plab > 0)
    or (lab > 0 and abs(blk::double / lab - p) > 1.96e0 * sqrt(p * (1 - p) / lab))),
placed as (
  select w.host, t, max(depth) as depth, arg_max(node, depth) as branch, any_value(lab) as lab, any_value(blk) as blk
  from walked w join anchors using (host, depth, node) group by w.host, t),
kin as (select *, case when lab > 0 then (blk + 1)::double / (lab + 2) >= 0.8e0 end as bad from nodes where depth > 0),
branch_cells as (
  select host, depth, parent, node, cell, sum(w.n) as a, any_value(k.n) as in_branch, any_value(k.bad) as bad
  from walked w join kin k using (host, depth, parent, node) group by host, depth, parent, node, cell),
pool_cells as (select host, depth, parent, bad, cell, sum(a) as b from branch_cells where bad is not null group by host, depth, parent, bad, cell),
pool_sizes as (select host, depth, parent, bad, sum(b) as m, count(*) as kb from pool_cells group by host, depth, parent, bad),
pool_labels as (select host, depth, parent, bad, sum(lab) as lab, sum(blk) as blk from kin where bad is not null group by host, depth, parent, bad),
open_cells as (select host, depth, parent, node, cell, a, in_branch from branch_cells where bad is null and in_branch >= 5),
paired as (
  select o.*, p.bad, p.m, p.kb, coalesce(c.b, 0) as b from open_cells o join pool_sizes p using (host, depth, parent)
  left join pool_cells c on o.host = c.host and o.depth = c.depth and o.parent = c.parent and o.cell = c.cell and p.bad = c.bad),
tested as (
  select host, depth, parent, node, bad, round((sum((m * a - in_branch * b)::double ^ 2 / (a + b)) + any_value(in_branch)::double ^ 2 * (any_value(m) - sum(b)))
    / (any_value(in_branch)::double * any_value(m)), 9) as far, count(*) + any_value(kb) - count(*) filter (b > 0) - 1 as free
  from paired group by host, depth, parent, node, bad),
adopted as (
  select host, depth, node as branch, lab, blk from tested join pool_labels using (host, depth, parent, bad)
  where case when free > 0 then far <= free * (1 - 2e0 / (9 * free) + 1.645e0 * sqrt(2e0 / (9 * free))) ^ 3 else far = 0 end
  qualify row_number() over (partition by host, depth, node order by far, bad) = 1),
pooled as (select host, branch, depth, sum(lab) as lab, sum(blk) as blk from placed group by host, branch, depth),
bad as (
  select host, branch, depth from pooled p left join adopted a using (host, branch, depth)
  where (coalesce(a.blk, p.blk) + 1)::double / (coalesce(a.lab, p.lab) + 2) >= 0.8e0),
rejected as (
  select s.host, s.seg from shaped s join placed p on s.host = p.host and s.t = p.t join bad b on p.host = b.host and p.branch = b.branch and p.depth = b.depth)
select page_id, u.host, path, rule, coalesce(what, case when x.host is not null then 'block' else 'allow' end) as verdict
from ruled u left join rejected x on u.host = x.host and u.seg = x.seg"""


@query("op9_url_filter", URL_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read(spark, sf_dir, "pages"))


LINK_SQL = """
with recursive v as (
  select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings),
fine as (
  select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.r as a, b.r as b from fine a join fine b on a.label = b.label and a.r <> b.r
  where case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) >= 0.93e0 else false end),
reach(r, root) as (
  select r, vec_id from v union select links.b, reach.root from reach join links on links.a = reach.r),
least_ids as (select r, min(root) as component_id from reach group by r),
counts as (select a as r, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id is not distinct from component_id as kept
from v join least_ids using (r) left join counts using (r)"""


@query("op2_embedding_near_dedup", LINK_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(read(spark, sf_dir, "embeddings"))


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality.scored(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0)
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op4_document_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.with_neighbours(read(spark, sf_dir, "documents"))


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(read(spark, sf_dir, "pages"))


PREFERENCE_SQL = """
with t as (
  select conv_id, conv_id // 2 as pair_id, conv_id % 2 as side, row_number() over (partition by conv_id order by turn, role, text) as i,
    replace(replace(coalesce(role, ''), '<|im_start|>', ''), '<|im_end|>', '') as role,
    replace(replace(coalesce(text, ''), '<|im_start|>', ''), '<|im_end|>', '') as text
  from conversations where conv_id is not null),
ids as (
  select pair_id, max(conv_id) filter (side = 0) as chosen_id, max(conv_id) filter (side = 1) as rejected_id,
    least(count(*) filter (side = 0), count(*) filter (side = 1)) as shorter from t group by pair_id),
differ as (
  select a.pair_id, min(a.i) as at from t a join t b on a.pair_id = b.pair_id and a.i = b.i and a.side = 0 and b.side = 1
  where a.role <> b.role or a.text <> b.text group by a.pair_id),
pre as (
  select ids.*, least(coalesce(differ.at - 1, shorter), shorter) as n_common from ids left join differ using (pair_id)),
said as (
  select t.pair_id, side, i, n_common, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as part,
    length(role) + 13 as head, length(text) + 10 as body from t join pre on t.pair_id = pre.pair_id),
rest as (
  select *, coalesce(sum(head + body + 1) over (partition by pair_id, side order by i rows between unbounded preceding and 1 preceding), 0) as start_at
  from said where i > n_common)
select pre.pair_id, pre.chosen_id, pre.rejected_id, pre.n_common::int as n_common,
  coalesce((select string_agg(part, '' order by i) from said where said.pair_id = pre.pair_id and side = 0 and i <= said.n_common), '') as prompt,
  coalesce((select string_agg(part, '' order by i) from rest where rest.pair_id = pre.pair_id and side = 0), '') as chosen,
  coalesce((select string_agg(part, '' order by i) from rest where rest.pair_id = pre.pair_id and side = 1), '') as rejected,
  coalesce((select string_agg((start_at + head)::bigint || '+' || body, ',' order by i) from rest where rest.pair_id = pre.pair_id and side = 0 and role = 'assistant'), '') as chosen_spans,
  coalesce((select string_agg((start_at + head)::bigint || '+' || body, ',' order by i) from rest where rest.pair_id = pre.pair_id and side = 1 and role = 'assistant'), '') as rejected_spans
from pre"""


@query("op3_chat_preferences", PREFERENCE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    found = chat_format.preferences(turns, chat_format.neighbour_pairs(turns))
    return found.withColumns({c: chat_format.spans_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def codes_sql(entries: int = 256, rounds: int = 4, parts: int = 4) -> str:
    """Every round is two tables: the assignment of the parts, and the codebook moved to their floored means."""
    near = """select x.r, x.part, x.v, arg_min(b.entry, (x.vv + b.vv - 2 * list_dot_product(x.v, b.v), b.entry)) as entry,
  min(x.vv + b.vv - 2 * list_dot_product(x.v, b.v)) as d from x join book{k} b on x.part = b.part group by x.r, x.part, x.v"""
    moved = """select part, entry, v, list_dot_product(v, v) as vv from (
  select b.part, b.entry, coalesce(m.v, b.v) as v from book{k} b left join (
    select part, entry, list(q order by pos) as v from (
      select part, entry, pos, ((sum(c)::hugeint - ((sum(c)::hugeint % count(*)) + count(*)) % count(*)) // count(*))::double as q
      from (select part, entry, unnest(v)::bigint as c, unnest(range(len(v))) as pos from near{k}) group by part, entry, pos)
    group by part, entry) m on b.part = m.part and b.entry = m.entry)"""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"near{k} as materialized ({near.format(k=k)})")
        if k < rounds:
            steps.append(f"book{k + 1} as materialized ({moved.format(k=k)})")
    rest = ",\n".join(steps)
    return f"""
with usable as (
  select vec_id, label, embedding, len(embedding) as d from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
kept as materialized (
  select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda e: floor(1024 * e::double)) as v
  from usable where d = (select d from usable group by d order by count(*) desc, d desc limit 1)),
x as materialized (
  select r, part, v, list_dot_product(v, v) as vv from (
    select r, part, v[(part * len(v)) // {parts} + 1:((part + 1) * len(v)) // {parts}] as v from kept, (select unnest(range({parts})) as part))),
book0 as (select part, r - 1 as entry, v, vv from x where r <= {entries}),
{rest},
coded as (
  select r, string_agg(lower(format('{{:02x}}', entry)), '' order by part) as code, sum(d)::bigint as error from near{rounds} group by r),
books as (select sha256(string_agg(list_aggregate(v::bigint[], 'string_agg', ','), ',' order by part, entry)) as h from book{rounds}),
named as (select kept.vec_id, kept.label, code, error from kept join coded using (r))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select h from books) as codebooks_sha256 from named"""


@query("op12_vector_codes", codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(read(spark, sf_dir, "embeddings"))


@query("op13_bpe_round_trip")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decoded(bpe.encoded(read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
