"""Cluster structure of points and the designs built on it: spectral embedding, Ward selection, anomaly scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hash_uniform
from ..session import cut_lineage
from .kernels import BlockKernel, Kernel, Points, affinity_degrees, cross_apply, group_similarity, neighbours
from .ordered import attach, hash_take, quantile_row, row_prefix
from .sampling import corrupt_labels
from .summaries import ward_selection
from .testing import rank_p_values


def kmeans(df: DataFrame, k: int, features: str = "v", seed: int = 42, out: str = "cluster") -> DataFrame:
    """K-means labels; the centres are the only state on the driver."""
    data = df.withColumn("_vec", array_to_vector(features))
    model = KMeans(k=k, seed=seed, featuresCol="_vec", predictionCol=out, initSteps=5).fit(data)
    return model.transform(data).drop("_vec")


def spectral_embedding(
    df: DataFrame, kernel: Kernel, k: int = 10, iterations: int = 60, oversample: int = 6, seed: int = 42, tol: float = 1e-6
) -> tuple[DataFrame, DataFrame]:
    """Leading eigenpairs of the normalised affinity by a locally optimal block method.

    The distributed kernel multiplies a thin bundle of vectors, one product a round.  The next pairs are the best ones in
    the span of the present vectors, their residuals and the last directions; only small inner-product matrices (squares
    of three bundle widths) reach the driver.  Rounds end when every wanted pair has a residual ||A u - value u|| of at most
    ``tol``, at the latest after ``iterations``; the residual reached is returned.
    Returns (``id, u array``), (``rank, value, residual``).
    """
    deg = affinity_degrees(Points.pack(df.select("id", "v")), kernel)
    scaled = cut_lineage(df.select("id", "v").join(deg, "id").withColumn("s", F.lit(1.0) / F.sqrt("degree")))
    bk = BlockKernel.build(Points.pack(scaled.select("id", "v", "s"), extra=["s"]), kernel, scale="s")
    width = k + oversample
    none = F.array().cast("array<double>")
    # b = vectors and directions, ab = their products, y = what the kernel multiplies next
    state = scaled.select("id", none.alias("b"), none.alias("ab"), F.array(*[hash_uniform("id", f"sub{j}|{seed}") - 0.5 for j in range(width)]).alias("y"))

    def grams(rows: DataFrame, n: int) -> np.ndarray:
        """b'b, b'Ab and (Ab)'(Ab), summed per partition first."""

        def part(batches):
            total = np.zeros((3, n, n))
            for pdf in batches:
                if len(pdf):
                    u, au = np.stack(pdf["b"].to_numpy()), np.stack(pdf["ab"].to_numpy())
                    total += np.stack([u.T @ u, u.T @ au, au.T @ au])
            yield pd.DataFrame({"g": [total.ravel()]})

        sums = rows.select("b", "ab").mapInPandas(part, "g array<double>").select(F.posexplode("g").alias("at", "x"))
        cells = sums.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()  # 3 n^2 numbers
        return np.array([r["x"] for r in cells]).reshape(3, n, n)

    n_old, wide = 0, width
    for step in range(iterations):
        product = bk.matvec(state.select("id", "y"), wide).withColumnRenamed("y", "ay")
        rows = cut_lineage(state.join(product, "id").select("id", F.concat("b", "y").alias("b"), F.concat("ab", "ay").alias("ab")))
        bb, ba, aa = grams(rows, n_old + wide)
        unit = 1 / np.sqrt(np.maximum(np.diag(bb), 1e-300))
        size, q = np.linalg.eigh((bb + bb.T) / 2 * unit[:, None] * unit)
        white = unit[:, None] * q[:, size > 1e-10 * size[-1]] / np.sqrt(size[size > 1e-10 * size[-1]])
        vals, vecs = np.linalg.eigh(white.T @ (ba + ba.T) @ white / 2)
        pairs, vals = white @ vecs[:, ::-1][:, :width], vals[::-1][:width]
        residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", pairs, aa, pairs) - vals**2, 0.0))
        if residual[:k].max() <= tol or step == iterations - 1:
            break
        along = pairs.copy()
        along[: min(n_old, len(vals))] = 0.0  # the last step's vectors left out: the direction moved in
        mix = np.hstack([pairs, along]) if n_old else pairs

        def turn(batches, mix=mix, w=len(vals), vals=vals, residual=residual):
            for pdf in batches:
                if len(pdf):
                    u, au = np.stack(pdf["b"].to_numpy()) @ mix, np.stack(pdf["ab"].to_numpy()) @ mix
                    rest = (au[:, :w] - u[:, :w] * vals) / np.maximum(residual, 1e-12)
                    yield pd.DataFrame({"id": pdf["id"], "b": list(u), "ab": list(au), "y": list(rest)})

        state = cut_lineage(rows.mapInPandas(turn, "id bigint, b array<double>, ab array<double>, y array<double>"))
        n_old, wide = mix.shape[1], len(vals)
    first = [F.array(*[F.lit(float(x)) for x in pairs[:, j]]) for j in range(min(k, len(vals)))]
    dot = lambda c: F.aggregate(F.zip_with("b", c, lambda u, v: u * v), F.lit(0.0), lambda s, x: s + x)
    emb = cut_lineage(rows.select("id", F.array(*[dot(c) for c in first]).alias("u")))
    bk.release()
    found = [(i + 1, float(v), float(r)) for i, (v, r) in enumerate(zip(vals[:k], residual[:k], strict=True))]
    return emb, df.sparkSession.createDataFrame(found, "rank int, value double, residual double")


def eigengap(eig: DataFrame, by: Sequence[str] = (), ignore_first: bool = False) -> DataFrame:
    """Cluster number at the largest drop between neighbouring eigenvalues: ``k``, ``gap``."""
    w = W.partitionBy(*by).orderBy("rank") if by else W.partitionBy(F.lit(0)).orderBy("rank")
    g = eig.withColumn("gap", F.col("value") - F.lead("value").over(w)).where("gap is not null")
    g = g.where("rank > 1") if ignore_first else g
    return g.groupBy(*by).agg(F.max_by("rank", F.struct("gap", -F.col("rank"))).alias("k"), F.max("gap").alias("gap"))


def structure_report(gaps: DataFrame, blocks: DataFrame, by: Sequence[str] = ("dataset",), min_gap: float = 0.02, min_block: int = 50) -> DataFrame:
    """Scan report: OK or the reason of rejection.  blocks: (by, cluster, n)."""
    valid = blocks.groupBy(*by).agg(F.sum("n").alias("n"), F.count_if(F.col("n") >= min_block).alias("valid_blocks"))
    status = (
        F.when(F.col("gap").isNull(), "REJECT flat")
        .when(F.col("gap") < min_gap, "REJECT gap too small")
        .when(F.col("valid_blocks") < 2, "REJECT one valid block")
        .otherwise("OK")
    )
    return valid.join(gaps, list(by), "left").withColumn("status", status)


def spectral_clusters(df: DataFrame, kernel: Kernel, k: int = 3, seed: int = 42) -> DataFrame:
    """K-means on the leading eigenvectors: ``id, cluster``."""
    emb, _ = spectral_embedding(df, kernel, k=k)
    return kmeans(emb, k, "u", seed).select("id", "cluster")


def medoids(df: DataFrame, kernel: Kernel, group: str = "cluster") -> DataFrame:
    """Member with the largest similarity to its own group."""
    pts = Points.pack(df.select("id", "v", group), extra=[group])
    own = group_similarity(pts, kernel, group).join(df.select("id", group), "id").where(F.col("other") == F.col(group))
    return own.groupBy(group).agg(F.max_by("id", F.struct("sim_sum", -F.col("id"))).alias("medoid"))


def similarity_to(df: DataFrame, seeds: DataFrame, kernel: Kernel) -> DataFrame:
    """Add ``sim`` = summed kernel to a few seed points."""
    one = seeds.select("id", "v", F.lit(1.0).alias("one"))
    return cross_apply(df, one, kernel, ["one"]).withColumnRenamed("k_one", "sim")


def seed_and_grow(df: DataFrame, seeds: DataFrame, kernel: Kernel, fraction: float = 0.2) -> DataFrame:
    """The int(n * fraction) rows most similar to the seeds become signals (label 0)."""
    ranked = row_prefix(similarity_to(df, seeds, kernel), "sim", "id")
    top = F.col("rk") > F.col("rk_n") - F.floor(F.col("rk_n") * F.lit(fraction))
    return ranked.withColumn("label", F.when(top, 0).otherwise(1).cast("int")).drop("rk", "rk_n")


def mixed_cluster_sample(df: DataFrame, n_total: int = 500, background: float = 0.5, corruption: float = 0.2, key: str = "id") -> DataFrame:
    """Largest cluster = signals, second = noise, the rest = background, each with its quota; a fixed fraction of the two
    cluster samples gets the other label.  When the background is short, surplus rows of the signal cluster fill it."""
    n_bg = int(n_total * background)
    per = (n_total - n_bg) // 2
    sizes = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    order = sizes.withColumn("size_rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "cluster")))
    roles = order.select("cluster", F.when(F.col("size_rank") == 1, 0).when(F.col("size_rank") == 2, 1).otherwise(2).alias("role"))
    rows = attach(df, roles, ["cluster"])
    sig = hash_take(rows.where("role = 0"), key, "mix", per).withColumn("group_id", F.lit(0))
    noise = hash_take(rows.where("role = 1"), key, "mix", per).withColumn("group_id", F.lit(1))
    spare = rows.where("role = 2").withColumn("_p", F.lit(0)).unionByName(
        rows.where("role = 0").join(sig.select(key), key, "left_anti").withColumn("_p", F.lit(1))
    )
    first = hash_take(spare.where("_p = 0"), key, "mix", n_bg)
    have = first.agg(F.count(F.lit(1)).alias("n"))
    more = hash_take(spare.where("_p = 1").withColumn("_g1", F.lit(1)), key, "mix", F.lit(n_bg) - have.scalar())
    bg = first.unionByName(more.select(first.columns)).drop("_p").withColumn("group_id", F.lit(2))
    base = sig.withColumn("label", F.lit(0)).unionByName(noise.withColumn("label", F.lit(1)))
    out = corrupt_labels(base, "group_id", corruption, key).unionByName(bg.withColumn("label", F.lit(1)))
    return out.drop("role")


def four_group_sample(
    df: DataFrame, kernel: Kernel, signal: int, quotas: Sequence[int] = (50, 150, 30, 270), compact: int | None = None
) -> DataFrame:
    """Signals from one cluster; nulls split into a compact cluster, close (similarity to the signal medoid at or above its
    80th percentile) and far (at or below the median).  Each group is drawn from what the groups before left; short pools hand
    their shortage to the far quota."""
    med = medoids(df.where(F.col("cluster") == signal), kernel).select(F.col("medoid").alias("id"))
    rest = similarity_to(df.where(F.col("cluster") != signal), df.join(med, "id", "left_semi"), kernel)
    rest = cut_lineage(rest)
    q = quantile_row(rest, "sim", {"far": 0.5, "close": 0.8})
    rest = cut_lineage(attach(rest, q, []))
    pool = rest.where((F.col("cluster") == compact) if compact is not None else ((F.col("sim") > F.col("far")) & (F.col("sim") < F.col("close"))))
    h1, n_compact, n_close, n_far = quotas
    first = hash_take(df.where(F.col("cluster") == signal).select("id"), "id", "g0", h1).withColumn("group_id", F.lit(0))
    nulls, lack = None, 0
    for g, (part, want) in enumerate([(pool, n_compact), (rest.where("sim >= close"), n_close), (rest.where("sim <= far"), n_far)], 1):
        left = part.select("id") if nulls is None else part.select("id").join(nulls, "id", "left_anti")
        want = want + lack if g == 3 else want
        drawn = cut_lineage(hash_take(left, "id", f"g{g}", want).withColumn("group_id", F.lit(g)))
        lack += want - drawn.count()
        nulls = drawn if nulls is None else nulls.unionByName(drawn)
    return first.unionByName(nulls).withColumn("label", F.when(F.col("group_id") == 0, 0).otherwise(1).cast("int"))


# --- designs on Ward clusters of all rows ---


def hierarchical_design(
    pool: DataFrame, targets: Sequence[int] = (50, 200, 200), min_size: int = 30, corruption: float = 0.2, sigma_factor: float = 1.0,
    by: Sequence[str] = ("dataset",), refill: bool = False,
) -> DataFrame:
    """Signal cluster, noise cluster and random background with their quotas: ``group_id`` 0, 1, 2 and ``label``
    (1 = null).  ``refill`` tops up short clusters from the other picked clusters."""
    sel = cut_lineage(ward_selection(pool, len(targets) - 1, min_size, sigma_factor, by))
    n_bg = targets[-1]
    parts = []
    for g, want in enumerate(targets[:-1]):
        parts.append(hash_take(sel.where(F.col("selected") == g), "id", "ward", want, by).withColumn("group_id", F.lit(g)))
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    if refill:
        total = sum(targets[:-1])
        have = chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("_have"))
        extra = attach(sel.where("selected >= 0").join(chosen.select(*by, "id"), [*by, "id"], "left_anti"), have, by)
        extra = hash_take(extra.withColumn("_want", F.lit(total) - F.col("_have")), "id", "refill", total, by)
        rank = F.row_number().over(W.partitionBy(*by).orderBy(hash_uniform("id", "refill"), "id"))
        extra = extra.withColumn("_r", rank).where("_r <= _want")
        chosen = chosen.unionByName(extra.withColumn("group_id", F.col("selected")).select(chosen.columns))
    chosen = cut_lineage(chosen)
    rest = sel.join(chosen.select(*by, "id"), [*by, "id"], "left_anti")
    bg = hash_take(rest, "id", "background", n_bg, by).withColumn("group_id", F.lit(len(targets) - 1))
    base = chosen.withColumn("label", F.when(F.col("group_id") == 0, 0).otherwise(1).cast("int"))
    flipped = base.withColumn("_cell", F.concat_ws("|", *[F.col(b).cast("string") for b in by], F.col("group_id").cast("string")))
    flipped = corrupt_labels(flipped, "_cell", corruption).drop("_cell")
    return flipped.unionByName(bg.withColumn("label", F.lit(1))).drop("selected")


# --- anomaly scores ---


def local_outlier_scores(pts: Points, k: int = 20) -> DataFrame:
    """Local outlier factor from the exact neighbour lists: ``lof`` and the thresholded ``score`` (+1 outlier, -1 inlier)."""
    nn = cut_lineage(neighbours(pts, k))
    kdist = nn.groupBy("id").agg(F.max("d").alias("kd"))
    reach = nn.join(kdist.withColumnRenamed("id", "nid"), "nid").withColumn("r", F.greatest("d", "kd"))
    lrd = cut_lineage(reach.groupBy("id").agg((F.lit(1.0) / (F.avg("r") + 1e-10)).alias("lrd")))
    near = nn.join(lrd.withColumnsRenamed({"id": "nid", "lrd": "nl"}), "nid").groupBy("id").agg(F.avg("nl").alias("nl"))
    out = near.join(lrd, "id").select("id", (F.col("nl") / F.col("lrd")).alias("lof"))
    return out.withColumn("score", F.when(F.col("lof") > 1.5, 1.0).otherwise(-1.0))


def anomaly_p_values(df: DataFrame, method: str = "knn", k: int | None = None, digits: int = 9, **kw) -> DataFrame:
    """Features (id, v) -> (id, score, p): 'knn' mean distance, 'lof' or 'isolation' score, then the rank p-value.  Scores are
    rounded to ``digits`` so that equal rows tie."""
    if method == "isolation":
        score = isolation_scores(df, **kw)
    elif method == "lof":
        score = local_outlier_scores(Points.pack(df.select("id", "v")), k or 20).select("id", F.col("lof").alias("score"))
    elif method == "knn":
        score = neighbours(Points.pack(df.select("id", "v")), k or 10, include_self=True).groupBy("id").agg(F.avg("d").alias("score"))
    else:
        raise ValueError(f"no anomaly score named {method}")
    return rank_p_values(cut_lineage(score.withColumn("score", F.round("score", digits))), "score")


def isolation_scores(df: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation forest: every tree grows in its own task from its own small hash sample; the forest (at most
    trees * 2 * sample nodes) travels to the rows, which are scored in one pass.  Higher means more anomalous."""
    n = df.count()
    # one rule for every size: a row enters a tree if its (key, tree) hash is below a bar that lets about twice the sample
    # through (with six deviations to spare); the tree then keeps the ``sample`` smallest of them
    bar = min(1.0, (2 * sample + 60) / max(1, n))
    spread = df.select("id", "v").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    spread = spread.withColumn("tk", F.concat_ws("|", F.col("id").cast("string"), F.col("tree").cast("string")))
    spread = spread.where(hash_uniform("tk", f"tree|{seed}") < bar)
    drawn = cut_lineage(hash_take(spread, "tk", f"tree|{seed}", sample, ["tree"]).select("tree", "id", "v"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, dtype=float) for v in pdf.sort_values("id")["v"]])
        tree = int(pdf.tree.iloc[0])
        rng = np.random.default_rng([seed, tree])
        cap, rows, todo = math.ceil(math.log2(max(2, len(x)))), [], [(0, np.arange(len(x)), 0)]
        while todo:
            node, idx, depth = todo.pop()
            spread_dims = np.flatnonzero(np.ptp(x[idx], axis=0) > 0) if len(idx) > 1 and depth < cap else []
            if not len(spread_dims):
                rows.append((tree, node, -1, 0.0, depth + path_length(len(idx))))
                continue
            dim = int(rng.choice(spread_dims))
            at = float(rng.uniform(x[idx, dim].min(), x[idx, dim].max()))
            rows.append((tree, node, dim, at, 0.0))
            left = x[idx, dim] <= at
            todo += [(2 * node + 1, idx[left], depth + 1), (2 * node + 2, idx[~left], depth + 1)]
        return pd.DataFrame(rows, columns=["tree", "node", "dim", "at", "depth"])

    forest = drawn.groupBy("tree").applyInPandas(grow, "tree int, node bigint, dim int, at double, depth double").toPandas()
    books = [g.set_index("node")[["dim", "at", "depth"]] for _, g in forest.groupby("tree")]
    tables = [(b.index.to_numpy(), b["dim"].to_numpy(), b["at"].to_numpy(), b["depth"].to_numpy()) for b in (b.sort_index() for b in books)]
    norm = max(path_length(min(sample, n)), 1e-12)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in pdf["v"]])
            total = np.zeros(len(x))
            for nodes, dim, at, depth in tables:
                pos = np.zeros(len(x), dtype="int64")
                while True:
                    i = np.searchsorted(nodes, pos)
                    inner = dim[i] >= 0
                    if not inner.any():
                        break
                    right = x[np.arange(len(x)), np.maximum(dim[i], 0)] > at[i]
                    pos = np.where(inner, 2 * pos + 1 + right, pos)
                total += depth[np.searchsorted(nodes, pos)]
            yield pd.DataFrame({"id": pdf["id"], "score": 2.0 ** (-total / len(tables) / norm)})

    return df.select("id", "v").mapInPandas(run, "id bigint, score double")


def path_length(n: int) -> float:
    """Expected depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n
