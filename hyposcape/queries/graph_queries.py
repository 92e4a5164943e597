"""Graph operators over the part graph (neighbouring order lines) and enrichment of part sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import local_fdr
from ..operators import density, enrichment, graph, graph_fit, sampling, testing
from ..operators.solver import GLOBAL_PRESETS, make_config
from ..plans.graph_bench import GraphBench
from ..session import cut_lineage
from ..sources.config import log_grid
from ..sources.fixtures import hyp_parts, part_edges, part_pairs
from ..sources.tables import table
from .registry import hash_sql, ppf_sql, query, rnd, sf_sql, uniform_sql

EDGES = """raw AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*)::double AS w FROM lineitem a JOIN lineitem b
 ON a.l_orderkey=b.l_orderkey AND b.l_linenumber=a.l_linenumber+1 WHERE a.l_partkey<>b.l_partkey GROUP BY 1,2),
ed AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w/2e0 AS w FROM raw UNION ALL SELECT dst, src, w/2e0 FROM raw) GROUP BY 1,2),
dg AS (SELECT src AS id, sum(w) AS degree, count(*) AS n_edges FROM ed GROUP BY 1),
nrm AS (SELECT ed.src, ed.dst, w/sqrt(a.degree*b.degree) AS a FROM ed JOIN dg a ON a.id=src JOIN dg b ON b.id=dst)"""

PARTS = f"""hp AS (SELECT p_partkey AS id, p_brand, (CASE WHEN p_size<=5 THEN 0 ELSE 1 END)::int AS label,
 CASE WHEN p_size<=5 THEN pow(u,10e0) ELSE u END AS p FROM (SELECT *, {uniform_sql('p_partkey', 'gene|7')} AS u FROM part))"""


def edges(spark, sf):
    return graph.symmetrize(part_pairs(spark, sf).withColumn("w", F.lit(1.0)))  # halves of counts are exact: one sum


@query("graph_degrees", f"WITH {EDGES} SELECT id, round(degree,6) AS degree, n_edges FROM dg")
def graph_degrees(spark, sf):
    return graph.degrees(edges(spark, sf)).select("id", rnd("degree").alias("degree"), "n_edges")


@query(
    "graph_laplacian",
    f"""WITH {EDGES}, {PARTS} SELECT src, dst, round(l,9) AS l FROM (SELECT src, dst, -a AS l FROM nrm UNION ALL SELECT id, id, 1e0 FROM hp)""",
)
def graph_laplacian(spark, sf):
    return graph.laplacian(cut_lineage(edges(spark, sf)), hyp_parts(spark, sf)).select("src", "dst", rnd("l", 9).alias("l"))


@query(
    "graph_laplacian_plain",
    f"""WITH {EDGES}, {PARTS} SELECT src AS id, round(sum(l*l),6) AS row_norm FROM (SELECT src, -w AS l FROM ed UNION ALL
 SELECT hp.id, coalesce(degree,0) FROM hp LEFT JOIN dg USING (id)) GROUP BY 1""",
)
def graph_laplacian_plain(spark, sf):
    lap = graph.laplacian(edges(spark, sf), hyp_parts(spark, sf), normalised=False)
    return lap.groupBy(F.col("src").alias("id")).agg(rnd(F.sum(F.col("l") * F.col("l"))).alias("row_norm"))


def taylor_sql(terms: int, beta: float) -> str:
    steps, coef, acc = ["y0 AS (SELECT id, (CASE WHEN label=0 THEN 1e0 ELSE 0e0 END) AS y FROM hp)"], 1.0, ["SELECT id, y FROM y0"]
    for k in range(1, terms + 1):
        coef *= beta / k
        steps.append(f"y{k} AS MATERIALIZED (SELECT dst AS id, sum(a*y) AS y FROM nrm JOIN y{k - 1} ON src=id GROUP BY 1)")
        acc.append(f"SELECT id, y*{coef:.20e} FROM y{k}")
    return f"{', '.join(steps)} SELECT id, round(sum(y)*exp(-{beta}e0),8) AS heat FROM ({' UNION ALL '.join(acc)}) GROUP BY 1"


@query("graph_diffusion", f"WITH {EDGES.replace('nrm AS (', 'nrm AS MATERIALIZED (')}, {PARTS}, {taylor_sql(16, 1.0)}")
def graph_diffusion(spark, sf):
    """Heat that spreads from the signal nodes: exp(-L) applied to their indicator, over the whole graph."""
    nodes = hyp_parts(spark, sf)
    start = nodes.select("id", F.when(F.col("label") == 0, 1.0).otherwise(0.0).alias("y"))
    return graph_fit.whole_diffusion(start, cut_lineage(edges(spark, sf))).select("id", rnd("y", 8).alias("heat"))


@query(
    "graph_alignment",
    f"""WITH {EDGES}, {PARTS}, z0 AS (SELECT id, {ppf_sql('1e0-least(1e0-1e-10,greatest(1e-10,p))')} AS z FROM hp),
z AS (SELECT id, z-(SELECT avg(z) FROM z0) AS z FROM z0), pl AS (SELECT id, row_number() OVER (ORDER BY {hash_sql('id', 'place')}, id) AS k FROM z),
dr AS (SELECT pm, z, row_number() OVER (PARTITION BY pm ORDER BY {hash_sql("id::varchar||'|'||pm::varchar", 'perm')}, id::varchar||'|'||pm::varchar) AS k
 FROM z, (SELECT i AS pm FROM range(1,101) t(i))),
zp AS (SELECT 0 AS pm, id, z FROM z UNION ALL SELECT pm, id, z FROM dr JOIN pl USING (k)),
sc AS (SELECT a.pm, sum(w*a.z*b.z) AS s FROM ed JOIN zp a ON a.id=src JOIN zp b ON b.id=dst AND b.pm=a.pm GROUP BY 1),
st AS (SELECT max(s) FILTER (WHERE pm=0) AS observed, avg(s) FILTER (WHERE pm>0) AS mean_perm, stddev_pop(s) FILTER (WHERE pm>0)+1e-10 AS std_perm FROM sc)
SELECT round(observed,5) AS observed, round(mean_perm,5) AS mean_perm, round(std_perm,5) AS std_perm,
 round((observed-mean_perm)/std_perm,6) AS z_spatial, (SELECT round(avg(CASE WHEN s>=observed THEN 1e0 ELSE 0e0 END),6) FROM sc WHERE pm>0) AS p_spatial,
 (observed-mean_perm)/std_perm>2e0 AS aligned FROM st""",
)
def graph_alignment(spark, sf):
    raw = part_pairs(spark, sf).withColumn("w", F.lit(1.0))  # a pair's weight is the same before and after both directions share it
    out = graph.signal_alignment(raw, hyp_parts(spark, sf))
    return out.select(
        *[rnd(c, 5).alias(c) for c in ("observed", "mean_perm", "std_perm")],
        rnd("z_spatial").alias("z_spatial"), rnd("p_spatial").alias("p_spatial"), "aligned",
    )


@query(
    "graph_gene_alignment",
    f"""WITH {EDGES}, {PARTS}, k AS (SELECT id FROM hp WHERE p<0.5e0 AND id IN (SELECT src FROM ed UNION SELECT dst FROM ed))
SELECT (SELECT count(*) FROM k) AS n_nodes, count(*) AS n_edges, round(sum(w),6) AS weight FROM ed WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""",
)
def graph_gene_alignment(spark, sf):
    nodes, sub = graph.align(hyp_parts(spark, sf).where("p < 0.5"), edges(spark, sf))
    s = sub.agg(F.count(F.lit(1)).alias("n_edges"), rnd(F.sum("w")).alias("weight"))
    return s.withColumn("n_nodes", nodes.agg(F.count(F.lit(1)).alias("n")).scalar())


SETS = """mem AS (SELECT DISTINCT 'supplier '||l_suppkey AS pathway, l_partkey AS gene FROM lineitem UNION SELECT 'brand '||p_brand, p_partkey FROM part
 UNION SELECT 'type '||p_type, p_partkey FROM part)"""


def set_members(spark, sf):
    """Pathway-like sets of parts: what a supplier ships, brands and types."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    a = li.select(F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("pathway"), F.col("l_partkey").alias("gene"))
    b = p.select(F.concat(F.lit("brand "), "p_brand").alias("pathway"), F.col("p_partkey").alias("gene"))
    c = p.select(F.concat(F.lit("type "), "p_type").alias("pathway"), F.col("p_partkey").alias("gene"))
    return a.unionByName(b).unionByName(c).distinct()


ENRICH = f"""{PARTS}, {SETS}, rk AS (SELECT p, row_number() OVER (ORDER BY p,id) AS k, count(*) OVER () AS n FROM hp),
sel AS (SELECT id FROM hp WHERE p<=(SELECT coalesce(max(p) FILTER (WHERE p<=k::double/n*0.1e0),0e0) FROM rk)),
ct AS (SELECT pathway, count(*) AS n, count(*) FILTER (WHERE gene IN (SELECT id FROM sel)) AS k, (SELECT count(*) FROM hp) AS m,
 (SELECT count(*) FROM sel) AS nn FROM mem WHERE gene IN (SELECT id FROM hp) GROUP BY 1),
tl AS (SELECT pathway, sum(exp(lgamma(n+1)-lgamma(x+1)-lgamma(n-x+1)+lgamma(m-n+1)-lgamma(nn-x+1)-lgamma(m-n-nn+x+1)
 -lgamma(m+1)+lgamma(nn+1)+lgamma(m-nn+1))) AS pv FROM (SELECT *, unnest(range(greatest(k,n+nn-m),least(n,nn)+1)) AS x FROM ct) GROUP BY 1),
en AS (SELECT pathway, CASE WHEN n<3 OR k=0 THEN 1e0 ELSE least(1e0,pv) END AS pval, (CASE WHEN n<3 THEN 0 ELSE k END)::bigint AS overlap, n AS size
 FROM ct JOIN tl USING (pathway))"""


def enriched(spark, sf):
    genes = hyp_parts(spark, sf)
    chosen = testing.benjamini_hochberg(genes).where("rejected")
    ids = genes.select(F.col("id").alias("gene"))
    return enrichment.enrichment(set_members(spark, sf), chosen.select(F.col("id").alias("gene")), ids)


@query("enrichment", f"WITH {ENRICH} SELECT pathway, round(pval,8) AS pval, overlap, size FROM en")
def enrichment_rows(spark, sf):
    return enriched(spark, sf).select("pathway", rnd("pval", 8).alias("pval"), "overlap", "size")


@query(
    "enrichment_auc",
    f"""WITH {ENRICH}, s AS (SELECT round(-log10(pval+1e-100),8) AS x, pathway LIKE 'brand%' AS pos FROM en),
r AS (SELECT pos, rank() OVER (ORDER BY x)+(count(*) OVER (PARTITION BY x)-1)/2e0 AS r FROM s),
a AS (SELECT sum(r) FILTER (WHERE pos) AS sr, count(*) FILTER (WHERE pos) AS np, count(*) AS n FROM r)
SELECT round((sr-np*(np+1)/2e0)/np/(n-np),8) AS auc, np AS n_pos, n, 'ok' AS reason FROM a""",
)
def enrichment_auc(spark, sf):
    res = enriched(spark, sf)
    res = cut_lineage(res.withColumn("x", rnd(-F.log10(F.col("pval") + F.lit(1e-100)), 8)))
    out = testing.auc(res.withColumn("pos", F.col("pathway").startswith("brand")), "x", "pos")
    return out.select(rnd("auc", 8).alias("auc"), "n_pos", "n", "reason")


def whole_graph(spark, sf):
    """All genes of the part graph with densities, and its edges."""
    nodes, sub = graph.align(hyp_parts(spark, sf), cut_lineage(edges(spark, sf)))
    nodes = cut_lineage(density.with_gaussian_shift(nodes, by=[]))
    return nodes.withColumn("dataset", F.lit("parts")), cut_lineage(sub).withColumn("dataset", F.lit("parts"))


@query(
    "graph_structure",
    f"""WITH {EDGES}, deg AS (SELECT id FROM dg) SELECT 'parts' AS dataset, count(*) AS n, 1::bigint AS n_ones, true AS settled FROM deg""",
)
def graph_structure(spark, sf):
    """Spectral validator over every node: the part graph is one component, its second eigenvalue settles."""
    nodes, e = whole_graph(spark, sf)
    out = graph_fit.whole_structure(nodes, e)
    return out.select("dataset", "n", "n_ones", (F.col("residual") <= 1e-4).alias("settled"))


@query("graph_spectrum")
def graph_spectrum(spark, sf):
    nodes, e = whole_graph(spark, sf)
    return graph_fit.whole_structure(nodes, e)


TWO_PARTS = f"""hq AS (SELECT 'strong' AS dataset, p_partkey AS id, CASE WHEN p_size<=5 THEN pow(u,20e0) ELSE u END AS p FROM (SELECT *, {uniform_sql('p_partkey', 'gene|7')} AS u FROM part)
 UNION ALL SELECT 'weak', p_partkey, CASE WHEN p_size<=5 THEN pow(u,1e0/0.3e0) ELSE u END FROM (SELECT *, {uniform_sql('p_partkey', 'gene|7')} AS u FROM part))"""


@query(
    "graph_alignment_moments",
    f"""WITH {EDGES}, {TWO_PARTS}, z0 AS (SELECT dataset, id, {ppf_sql('1e0-least(1e0-1e-10,greatest(1e-10,p))')} AS z FROM hq),
z AS (SELECT dataset, id, z-avg(z) OVER (PARTITION BY dataset) AS z FROM z0),
ob AS (SELECT a.dataset, sum(w*a.z*b.z) AS observed, sum(w) AS s0, 2*sum(w*w) AS s1 FROM ed JOIN z a ON a.id=src JOIN z b ON b.id=dst AND b.dataset=a.dataset GROUP BY 1),
mo AS (SELECT dataset, count(*)::double AS n, avg(z*z) AS m2, avg(z*z*z*z) AS m4, (SELECT 4*sum(degree*degree) FROM dg) AS s2 FROM z GROUP BY 1),
ev AS (SELECT dataset, n, observed, -s0*m2/(n-1) AS e, (n*((n*n-3*n+3)*s1-n*s2+3*s0*s0)*m2*m2-m4*((n*n-n)*s1-2*n*s2+6*s0*s0))/((n-1)*(n-2)*(n-3)) AS q FROM mo JOIN ob USING (dataset)),
st AS (SELECT *, sqrt(greatest(q-e*e,0e0))+1e-10 AS sd FROM ev)
SELECT dataset, n::bigint AS n, round(observed,5) AS observed, round(e,5) AS mean_perm, round(sd,5) AS std_perm, round((observed-e)/sd,6) AS z_spatial,
 round({sf_sql('(observed-e)/sd')},6) AS p_spatial, (observed-e)/sd>2e0 AS aligned FROM st""",
)
def graph_alignment_moments(spark, sf):
    """Exact permutation moments of the alignment score of two datasets on the part graph."""
    tag = lambda df, d: df.withColumn("dataset", F.lit(d))
    nodes = tag(hyp_parts(spark, sf, a=0.05), "strong").unionByName(tag(hyp_parts(spark, sf, a=0.3), "weak"))
    e = cut_lineage(edges(spark, sf))
    out = graph.alignment_moments(tag(e, "strong").unionByName(tag(e, "weak")), nodes, ["dataset"])
    return out.select("dataset", "n", *[rnd(c, 5).alias(c) for c in ("observed", "mean_perm", "std_perm")], rnd("z_spatial").alias("z_spatial"), rnd("p_spatial").alias("p_spatial"), "aligned")


@query("graph_lambda_tuning")
def graph_lambda_tuning(spark, sf):
    """Held-out scores of every penalty on the whole graph."""
    nodes, e = whole_graph(spark, sf)
    nodes = cut_lineage(sampling.k_folds(nodes, 3))
    out = graph_fit.whole_tuning(nodes, e, make_config("graph_gsea"), lambdas=log_grid())
    return out.groupBy("dataset", "beta", "lam").agg(F.avg("nll").alias("mean_nll"))


@query("graph_smooth_fdr")
def graph_smooth_fdr(spark, sf):
    """Every node of the graph: diffusion kernel -> Stage 1 -> local FDR -> running-mean step-up."""
    nodes, e = whole_graph(spark, sf)
    a = graph_fit.whole_alpha(nodes, e, make_config("graph_gsea"))
    a = cut_lineage(a.withColumn("lfdr", local_fdr("alpha", "f0", "f1", floor=None)))
    return testing.lfdr_step_up(a, by=["dataset"]).select("dataset", "id", "alpha", "lfdr", "rejected")


@query("graph_allspace")
def graph_allspace(spark, sf):
    nodes, e = whole_graph(spark, sf)
    nodes = cut_lineage(sampling.train_test_split(nodes.drop("f0", "f1")))
    # densities of the training part only
    fit = density.gaussian_shift(nodes.where("split = 'train'"), by=["dataset"])
    nodes = cut_lineage(density.with_gaussian_shift(nodes, by=["dataset"], fit=fit))
    out = graph_fit.whole_allspace(nodes, e, make_config("graph_allspace"), GLOBAL_PRESETS["graph_allspace"])
    return out.where("split = 'test'").select("dataset", "id", "alpha_null")


@query("graph_bench_run")
def graph_bench_run(spark, sf):
    """Tuning, both decisions, enrichment and AUC for two datasets on the part graph, all graphs in one job."""
    tag = lambda df, d: df.withColumn("benchmark", F.lit("parts")).withColumn("dataset", F.lit(d))
    both = lambda df: tag(df, "strong").unionByName(tag(df, "weak"))
    members = set_members(spark, sf)
    bundle = {
        "edges": both(cut_lineage(part_edges(spark, sf))),
        "genes": tag(hyp_parts(spark, sf, a=0.05), "strong").unionByName(tag(hyp_parts(spark, sf, a=0.3), "weak")),
        "pathways": both(members),
        "positives": both(members.where(F.col("pathway").startswith("brand")).select("pathway").distinct()),
    }
    bench = GraphBench(make_config("graph_gsea"), lambdas=log_grid())
    return bench.run(bundle)
