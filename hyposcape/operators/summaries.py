"""Cluster designs over all rows: clustering features, Ward merges of them, and greedy similarity selection.

Every dataset gets at most ``most`` summaries (a parameter).  Their centres are drawn by key hash, every row joins the nearest,
and a summary holds count, sum and square sum of its rows, so parts merge by addition.  What is quadratic (merging, the
median distance) runs on the summaries; every row is visited in passes over packed blocks.  With no more distinct rows than
``most`` each row is its own summary and the results are those of the dense method.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .kernels import STRIP_CELLS, Kernel, distances, unpack
from .ordered import attach, hash_take

BLOCK_ROWS = 4096
MAX_CHOSEN = 20_000


def pack_groups(df: DataFrame, by: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (by, id, v) as blocks of about ``rows`` rows by key hash: (by, blk, ids, x).  A large dataset has many blocks."""
    parts = max(1, math.ceil(df.count() / rows))
    cells = df.select(*by, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("blk"), F.struct("id", "v").alias("s"))
    g = cells.groupBy(*by, "blk").agg(F.sort_array(F.collect_list("s")).alias("g"))
    return cut_lineage(g.select(*by, "blk", F.col("g.id").alias("ids"), F.flatten("g.v").alias("x")))


def key_types(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)


def in_strips(x: np.ndarray, centres: np.ndarray, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``fn`` makes of the distances of rows to centres, a number a row; few rows at once, so memory does not follow the block."""
    step = max(1, STRIP_CELLS // len(centres))
    return np.concatenate([fn(distances(x[at : at + step], centres, False)) for at in range(0, len(x), step)])


def assign(blocks: DataFrame, by: Sequence[str], features: DataFrame) -> DataFrame:
    """Blocks against the packed centres of their dataset: (by, id, s)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x = unpack(row["x"], len(row["ids"]))
                s = in_strips(x, unpack(row["c"], row["m"]), lambda d: d.argmin(1))
                yield pd.DataFrame({**{b: [row[b]] * len(x) for b in by}, "id": row["ids"], "s": s.astype("int32")})

    return attach(blocks, features, by).mapInPandas(run, key_types(blocks, by) + "id bigint, s int")


def summarise(df: DataFrame, by: Sequence[str], most: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packed blocks, the summary number of every row (by, id, s), and the features (by, s, n, mean, var): ``var`` is the
    mean squared distance of a summary's rows from its mean."""
    rows = cut_lineage(df.select(*by, "id", F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL"))
    drawn = hash_take(rows, "id", "summary", most, by).groupBy(*by, "v").agg(F.min("id").alias("id"))
    centres = drawn.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("g"))
    centres = cut_lineage(centres.select(*by, F.size("g").alias("m"), F.flatten("g.v").alias("c")))
    blocks = pack_groups(rows, by)
    placed = cut_lineage(assign(blocks, by, centres))
    total = Summarizer.sum(array_to_vector("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)
    feats = rows.join(placed, [*by, "id"]).withColumn("_q", square).groupBy(*by, "s").agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(total).alias("sum"), F.sum("_q").alias("_q")
    )
    mean = F.transform("sum", lambda y: y / F.col("n"))
    feats = feats.select(*by, "s", "n", mean.alias("mean"), "_q")
    var = F.greatest(F.lit(0.0), F.col("_q") / F.col("n") - F.aggregate("mean", F.lit(0.0), lambda a, y: a + y * y))
    return blocks, placed, cut_lineage(feats.select(*by, "s", "n", "mean", var.alias("var")))


def weighted_median(values: np.ndarray, weight: np.ndarray) -> float:
    """Median of values that stand ``weight`` (whole) times each."""
    order = np.argsort(values, kind="stable")
    cum = weight[order]
    np.cumsum(cum, out=cum)
    at = [math.floor((cum[-1] - 1) / 2), math.ceil((cum[-1] - 1) / 2)]
    return float(np.mean([values[order[np.searchsorted(cum, p, side="right")]] for p in at]))


def median_distance(mean: np.ndarray, n: np.ndarray, var: np.ndarray) -> float:
    """Median of all row pair distances, rows of one summary standing at its mean; pairs inside one at their root mean square."""
    n, m = n.astype(float), len(n)
    inside = np.flatnonzero(n > 1)
    values, at = np.empty(m * (m - 1) // 2 + len(inside)), 0
    weight, step = np.empty(len(values)), max(1, STRIP_CELLS // max(1, m))
    for lo in range(0, m, step):
        for i, d in enumerate(distances(mean[lo : lo + step], mean, True, lo), lo):
            to = at + m - i - 1
            values[at:to], weight[at:to], at = d[i + 1 :], n[i] * n[i + 1 :], to
    values[at:], weight[at:] = np.sqrt(2 * var[inside] * n[inside] / (n[inside] - 1)), n[inside] * (n[inside] - 1) / 2
    return weighted_median(values, weight) if len(values) else 0.0


def scale_of(g: pd.DataFrame, factor: float) -> tuple[np.ndarray, Kernel]:
    mean = np.stack([np.asarray(v, dtype=float) for v in g["mean"]])
    width = median_distance(mean, g.n.to_numpy(), g["var"].to_numpy()) * factor
    return mean, Kernel("rbf", width if width > 0 else 1.0)


# --- Ward on weighted summaries ---


def ward_merges(d: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Ward linkage of a distance matrix by the nearest-neighbour chain: rows (a, b, height) in order of height.  ``weight``:
    how many rows stand at each point."""
    n = len(d)
    size = np.ones(n) if weight is None else weight.astype(float)
    d2 = d.astype(float) ** 2 * (2 * np.outer(size, size) / np.add.outer(size, size))
    np.fill_diagonal(d2, np.inf)
    alive, chain, merges = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            a = chain[-1]
            row = np.where(alive, d2[a], np.inf)
            b = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        lo, hi = min(a, b), max(a, b)
        merges.append((lo, hi, math.sqrt(d2[a, b])))
        na, nb, gap = size[lo], size[hi], d2[lo, hi]
        new = ((na + size) * d2[lo] + (nb + size) * d2[hi] - size * gap) / (na + nb + size)
        new[[lo, hi]] = np.inf
        d2[lo], d2[:, lo] = new, new
        d2[hi], d2[:, hi] = np.inf, np.inf
        size[lo], alive[hi] = na + nb, False
    return np.array(sorted(merges, key=lambda m: m[2])).reshape(-1, 3)


def cut_tree(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels after the first n - k merges."""
    parent = np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, _ in merges[: n - k]:
        parent[root(int(b))] = root(int(a))
    roots = np.array([root(i) for i in range(n)])
    return np.unique(roots, return_inverse=True)[1]


def large_clusters(merges: np.ndarray, weight: np.ndarray, min_size: int) -> np.ndarray:
    """For every cut k the number of clusters of at least ``min_size`` rows (index k; one walk up the tree)."""
    size, n = weight.astype(float), len(weight)
    out = np.zeros(n + 1, dtype=int)
    out[n] = int((size >= min_size).sum())
    for i, (a, b, _) in enumerate(merges):
        a, b = int(a), int(b)
        before = int(size[a] >= min_size) + int(size[b] >= min_size)
        size[a] += size[b]
        out[n - i - 1] = out[n - i] - before + int(size[a] >= min_size)
    return out


def pick_clusters(k: np.ndarray, weight: np.ndarray, n_pick: int, min_size: int) -> tuple[np.ndarray, float, int]:
    """The Ward cut with most large clusters and the greedily most distant of these: a label per summary (-1 = not picked),
    cut height, cut size."""
    merges, n = ward_merges(np.clip(1 - k, 0, None), weight), len(k)
    large = large_clusters(merges, weight, min_size)
    cuts = np.arange(2, min(n, int(weight.sum()) // min_size) + 1)
    if not len(cuts) or large[cuts].max() < n_pick:
        raise ValueError(f"no cut has {n_pick} clusters of at least {min_size} rows")
    cut = int(cuts[large[cuts].argmax()])
    labels = cut_tree(merges, n, cut)
    counts = np.bincount(labels, weight)
    valid = np.flatnonzero(counts >= min_size)
    centre = {c: np.average(k[labels == c], axis=0, weights=weight[labels == c]) * np.sqrt(weight) for c in valid}
    picked = [max(valid, key=lambda c: counts[c])]
    while len(picked) < n_pick:
        left = [c for c in valid if c not in picked]
        picked.append(max(left, key=lambda c: min(np.linalg.norm(centre[c] - centre[s]) for s in picked)))
    out = np.full(n, -1)
    for i, c in enumerate(picked):
        out[labels == c] = i
    return out, float(merges[n - cut - 1][2]) if cut < n else 0.0, cut


def ward_selection(
    df: DataFrame, n_pick: int = 2, min_size: int = 30, sigma_factor: float = 1.0, by: Sequence[str] = ("dataset",), most: int = 2000
) -> DataFrame:
    """Every row of every dataset: ``selected`` cluster number or -1, ``cut_height``, ``n_cut``, and ``spread``, the root mean
    square distance of its summary's rows from their mean (0 where the summary is the row).  Rows without a vector do not
    take part."""
    _, placed, feats = summarise(df, by, most)

    def fn(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("s")
        mean, kernel = scale_of(g, sigma_factor)
        sel, height, cut = pick_clusters(kernel.of_distance(distances(mean, mean, True)), g.n.to_numpy(), n_pick, min_size)
        return g[[*by, "s"]].assign(selected=sel, cut_height=height, n_cut=cut, spread=np.sqrt(g["var"].to_numpy()))

    schema = key_types(df, by) + "s int, selected int, cut_height double, n_cut int, spread double"
    return attach(placed, cut_lineage(feats.groupBy(*by).applyInPandas(fn, schema)), [*by, "s"]).drop("s")


# --- similarity selection over all rows ---


def best_rows(blocks: DataFrame, by: Sequence[str], score: Callable[[tuple, np.ndarray], np.ndarray], chosen: dict, take: int) -> dict:
    """One pass over all rows: per dataset and score column the ``take`` best rows not chosen yet, as (score, id, v, column),
    best first, ties by id.  A task keeps no more than that of what it has seen."""
    out_schema = key_types(blocks, by) + "c int, score double, id bigint, v array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for pdf in batches:
            for row in pdf.to_dict("records"):
                key, x = tuple(row[b] for b in by), unpack(row["x"], len(row["ids"]))
                ids = np.asarray(row["ids"])
                g = score(key, x)
                g[np.isin(ids, list(chosen.get(key, ())))] = -np.inf
                for c in range(g.shape[1]):
                    top = np.lexsort((ids, -g[:, c]))[:take]
                    more = [(-g[i, c], int(ids[i]), x[i]) for i in top if np.isfinite(g[i, c])]
                    kept[key, c] = sorted(kept.get((key, c), []) + more, key=lambda t: t[:2])[:take]
        for (key, c), rows in kept.items():
            if rows:
                yield pd.DataFrame({**dict(zip(by, key)), "c": c, "score": [-r[0] for r in rows], "id": [r[1] for r in rows], "v": [r[2] for r in rows]})

    rank = F.row_number().over(W.partitionBy(*by, "c").orderBy(F.desc("score"), "id"))
    found: dict = {}
    for r in blocks.mapInPandas(run, out_schema).withColumn("_r", rank).where(F.col("_r") <= take).orderBy("c", "_r").collect():
        found.setdefault(tuple(r[b] for b in by), []).append((r["score"], r["id"], np.array(r["v"]), r["c"]))
    return found


class Selection:
    """The chosen rows of one dataset (at most n) and their groups, held by the driver."""

    def __init__(self, kernel: Kernel, n_clusters: int):
        self.kernel, self.n_clusters, self.rows = kernel, n_clusters, {}

    def sums(self, x: np.ndarray, without: int | None = None) -> np.ndarray:
        """Similarity of rows to the members of each group."""
        s = np.zeros((len(x), self.n_clusters))
        held = [(v, c) for i, (v, c) in self.rows.items() if i != without]
        if held:
            k = self.kernel.of_distance(distances(x, np.stack([v for v, _ in held]), False))
            for c in range(self.n_clusters):
                s[:, c] = k[:, np.array([h[1] for h in held]) == c].sum(1)
        return s

    def gains(self, x: np.ndarray, without: int | None = None) -> np.ndarray:
        s = self.sums(x, without)
        return 1.5 * s - 0.5 * s.sum(1, keepdims=True)

    def best_of(self, pool: dict) -> tuple[float, int, int]:
        """Best (gain, id, group) of the pool's rows that are not chosen."""
        ids = sorted(i for i in pool if i not in self.rows)
        if not ids:
            return -np.inf, -1, -1
        g = self.gains(np.stack([pool[i] for i in ids]))
        i, c = np.unravel_index(int(g.argmax()), g.shape)
        return float(g[i, c]), ids[i], int(c)

    def weakest(self) -> tuple[int, float] | None:
        """The member with the least own part in the objective; the last member of a group stays."""
        count = np.bincount([c for _, c in self.rows.values()], minlength=self.n_clusters)
        own = [(float(self.gains(v[None], i)[0, c]), i) for i, (v, c) in self.rows.items() if count[c] > 1]
        return (min(own)[1], min(own)[0]) if own else None

    def objective(self) -> float:
        x, c = np.stack([v for v, _ in self.rows.values()]), np.array([c for _, c in self.rows.values()])
        k = self.kernel.of_distance(distances(x, x, True))
        np.fill_diagonal(k, 0.0)
        same = c[:, None] == c[None]
        return float(k[same].sum() / 2 - 0.25 * k[~same].sum())


def similarity_selection(
    df: DataFrame, n: int, n_clusters: int, sigma_factor: float = 1.0, by: Sequence[str] = ("dataset",), most: int = 2000, guard: int = 500
) -> DataFrame:
    """Approximate quadratic selection over all rows: n rows in n_clusters groups that maximise within-group similarity minus
    half the between-group similarity: (by, id, cluster, objective).

    Farthest-point seeds, then groups grow from the best candidates of a pass over all rows, then the weakest member is
    exchanged while a pass finds a row that gains more.  It ends when a pass over every row finds none, so the result does
    not depend on which rows were candidates before; no integer-programming solver exists here to prove it largest.
    ``guard`` passes raise.  The driver holds the chosen rows and ``n`` candidates a group.
    """
    blocks, _, feats = summarise(df, by, most)

    def fn(g: pd.DataFrame) -> pd.DataFrame:
        return g[[*by]].head(1).assign(width=scale_of(g, sigma_factor)[1].length_scale)

    # one row a dataset and ``most`` means; both checked before they travel
    widths = feats.groupBy(*by).applyInPandas(fn, key_types(df, by) + "width double").limit(MAX_CHOSEN // n + 1).collect()
    if len(widths) > MAX_CHOSEN // n:
        raise ValueError(f"{n} rows of so many datasets exceed {MAX_CHOSEN}; select in parts")
    states = {tuple(r[b] for b in by): Selection(Kernel("rbf", r["width"]), n_clusters) for r in widths}

    def search(score, take, keys=None):
        part = blocks if keys is None else blocks.where(in_keys(keys))
        return best_rows(part, by, score, {k: set(st.rows) for k, st in states.items()}, take)

    def in_keys(keys):
        hit = F.lit(False)
        for key in keys:
            same = F.lit(True)
            for b, v in zip(by, key):
                same = same & F.col(b).eqNullSafe(F.lit(v))
            hit = hit | same
        return hit

    for key, (_, i, v, _) in ((k, r[0]) for k, r in first_seeds(blocks, feats, by, states).items()):
        states[key].rows[i] = (v, 0)
    for c in range(1, n_clusters):
        for key, rows in search(lambda key, x: -states[key].sums(x).max(1, keepdims=True), 1).items():
            states[key].rows[rows[0][1]] = (rows[0][2], c)
    for key, rows in search(lambda key, x: states[key].gains(x), n).items():
        st, pool = states[key], {i: v for _, i, v, _ in rows}
        while len(st.rows) < n and len(pool) > sum(i in st.rows for i in pool):
            _, i, c = st.best_of(pool)
            st.rows[i] = (pool[i], c)
    open_keys = {k for k, st in states.items() if st.weakest()}
    for _ in range(guard):
        if not open_keys:
            break
        out = {k: states[k].weakest() for k in open_keys}
        found = search(lambda key, x: states[key].gains(x, out[key][0]), n, open_keys)
        for key in sorted(open_keys, key=str):
            st, pool, moved = states[key], {i: v for _, i, v, _ in found.get(key, [])}, False
            while (weak := st.weakest()) is not None:
                was = st.rows.pop(weak[0])
                gain, i, c = st.best_of(pool)
                if gain <= weak[1] + 1e-12:
                    st.rows[weak[0]] = was
                    break
                st.rows[i], pool[weak[0]], moved = (pool[i], c), was[0], True
            if not moved:
                open_keys = open_keys - {key}
    if open_keys:
        raise RuntimeError(f"exchanges did not end within {guard} passes")
    rows = [(*key, i, c, st.objective()) for key, st in states.items() for i, (_, c) in st.rows.items()]
    return df.sparkSession.createDataFrame(rows, key_types(df, by) + "id bigint, cluster int, objective double")


def first_seeds(blocks: DataFrame, feats: DataFrame, by: Sequence[str], states: dict) -> dict:
    """Per dataset the row most similar to all rows, these standing at their summaries' means."""
    packed = feats.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("s", "n", "mean"))).alias("g"))
    packed = packed.select(*by, F.col("g.n").alias("w"), F.flatten("g.mean").alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x, w = unpack(row["x"], len(row["ids"])), np.asarray(row["w"], dtype=float)
                kernel = states[tuple(row[b] for b in by)].kernel
                g = in_strips(x, unpack(row["c"], len(w)), lambda d, kernel=kernel, w=w: kernel.of_distance(d) @ w)
                i = np.lexsort((np.asarray(row["ids"]), -g))[0]
                yield pd.DataFrame({**{b: [row[b]] for b in by}, "score": g[i], "id": row["ids"][i], "v": [x[i]]})

    best = attach(blocks, cut_lineage(packed), by).mapInPandas(run, key_types(blocks, by) + "score double, id bigint, v array<double>")
    top = best.groupBy(*by).agg(F.max_by(F.struct("score", "id", "v"), F.struct("score", -F.col("id"))).alias("t"))
    return {tuple(r[b] for b in by): [(r["t"]["score"], r["t"]["id"], np.array(r["t"]["v"]), 0)] for r in top.collect()}
