"""Graph benchmark: many (benchmark, dataset) graphs in one job, baseline against the smooth method, scored by enrichment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import local_fdr
from ..operators import density, enrichment, graph, graph_fit, sampling, testing, tuning
from ..operators.solver import SolverConfig, make_config
from ..session import cut_lineage

BY = ["benchmark", "dataset"]
MOST_STEPS = 2000  # a guard: a fit that has not settled raises


@dataclass(frozen=True)
class GraphBench:
    """Settings of a run; both methods decide at the same level, on every gene of the graph."""

    config: SolverConfig = make_config("graph_gsea")
    lambdas: Sequence[float] = (1e-3, 1.0, 10.0, 1e3)
    beta: float = 2.0
    folds: int = 3
    level: float = 0.1

    def tune(self, nodes: DataFrame, edges: DataFrame) -> dict[tuple, float]:
        """Best regularisation of each whole graph by its key."""
        split = cut_lineage(sampling.k_folds(nodes, self.folds, by=BY))
        scores = graph_fit.whole_tuning(split, edges, self.config, self.lambdas, [self.beta], BY)
        mean = scores.groupBy(*BY, "lam").agg(F.avg("nll").alias("mean_nll"))
        best = tuning.best_by_nll(mean, BY, order="lam")
        return {tuple(r[b] for b in BY): r["lam"] for r in best.collect()}  # a number a graph

    def decide(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Both decisions on all nodes: (by, id, method, rejected); graphs that fail the spectral check keep the
        baseline only, so no penalty is tuned for them."""
        sound = graph_fit.whole_structure(nodes, edges, BY, self.beta).where(F.col("verdict").isin("clustered", "moderate"))
        sound = F.broadcast(cut_lineage(sound.select(*BY)))  # a row a graph
        base = testing.benjamini_hochberg(nodes, by=BY, level=self.level)
        pick = lambda df, m: df.select(*BY, "id", F.lit(m).alias("method"), "rejected")
        some, kept = (cut_lineage(df.join(sound, BY, "left_semi")) for df in (nodes, edges))
        if some.isEmpty():
            return cut_lineage(pick(base, "baseline"))
        # a repeated id is one node; its rows share the node's value
        one = cut_lineage(some.groupBy(*BY, "id").agg(F.max(F.struct("f1", "f0")).alias("s")).select(*BY, "id", "s.f0", "s.f1"))
        alpha = graph_fit.whole_alpha(one, kept, self.config, BY, self.beta, self.tune(some, kept), most=MOST_STEPS).select(*BY, "id", "alpha")
        scored = cut_lineage(some.join(alpha, [*BY, "id"], "left").withColumn("lfdr", local_fdr("alpha", "f0", "f1", floor=None)))
        smooth = testing.lfdr_step_up(scored, by=BY, level=self.level)
        return cut_lineage(pick(base, "baseline").unionByName(pick(smooth, "smooth")))

    def run(self, bundle: dict[str, DataFrame]) -> DataFrame:
        """One row per (benchmark, dataset, method): genes, discoveries, enrichment AUC against the positive pathways."""
        edges = bundle["edges"].where(F.col("src") != F.col("dst"))
        nodes = cut_lineage(bundle["genes"].join(graph.touched(edges, BY), [*BY, "id"], "left_semi"))
        nodes = cut_lineage(density.with_gaussian_shift(nodes, by=BY))
        decisions = self.decide(nodes, cut_lineage(graph.drawn_graph(edges, nodes, BY)))
        by = [*BY, "method"]
        universe = decisions.select(*by, F.col("id").alias("gene"))
        chosen = decisions.where("rejected").select(*by, F.col("id").alias("gene"))
        methods = decisions.select(*by).distinct()
        members = bundle["pathways"].join(F.broadcast(methods), BY)
        result = cut_lineage(enrichment.enrichment(members, chosen, universe, by))
        positives = bundle["positives"].join(F.broadcast(methods), BY)
        score = enrichment.enrichment_auc(result, positives, by).select(*by, "auc", "reason")
        counts = decisions.groupBy(*by).agg(F.count(F.lit(1)).alias("n_genes"), F.count_if("rejected").alias("n_discoveries"))
        return counts.join(score, by, "left")
