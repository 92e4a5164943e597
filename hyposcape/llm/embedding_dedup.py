"""Embedding near-duplicates: exact cosine links found by int8 tile products with per-vector error bounds.

Vectors are compared within their label only. Equal vectors are one node with a weight. The nodes of a label are dealt to tiles of
about ``TILE`` by hash, and every pair of tiles is a task of bounded size, so a label with a third of all rows is many tasks.

A unit vector x is stored as s * q with int8 q, and e = ||x - s q|| is its measured error. For unit vectors
|x.y - s_x s_y q_x.q_y| <= e_x + e_y + e_x e_y, so only pairs whose product plus bound reaches the threshold can be links; those
are computed again in double precision. A task returns, per node, the weight of its links and one spanning link, never the pairs.
Comparing all pairs of a label is the contract; the work is the square of a label's distinct vectors over the tile size.

Defined cases: a null label, a null or empty vector, null or non-finite components and zero vectors link with nothing and are
their own component. Vectors of different lengths do not link. Repeated rows and ids are vectors of their own. A null vec_id
takes part; it is the component id only if no other id is reachable. An empty table gives an empty result. Other columns are unread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import forest

TILE = 1024
SLACK = 1e-9  # covers the rounding of the double-precision bound itself
PAIRS = 1 << 16  # pairs recomputed at once


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component is divided out first, so squares stay in range."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, error norm) of unit vectors."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    rest = x - scale[:, None] * codes
    return codes, scale, np.sqrt((rest * rest).sum(1))


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: sums of 1024 products stay below 2**24, exact in single precision."""
    total = np.zeros((len(a), len(b)))
    for s in range(0, a.shape[1], 1024):
        total += a[:, s : s + 1024].astype(np.float32) @ b[:, s : s + 1024].astype(np.float32).T
    return total


def tile_links(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of unit vectors with x.y >= least."""
    (qx, sx, ex), (qy, sy, ey) = quantise(x), quantise(y)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for r in range(0, len(x), 256):
        near = code_products(qx[r : r + 256], qy) * (sx[r : r + 256, None] * sy)
        bound = ex[r : r + 256, None] + ey + ex[r : r + 256, None] * ey
        i, j = np.nonzero(near + bound + SLACK >= least)
        for s in range(0, len(i), PAIRS):
            a, b = i[s : s + PAIRS] + r, j[s : s + PAIRS]
            ok = np.einsum("nd,nd->n", x[a], y[b]) >= least
            found.append((a[ok], b[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def linked(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, label, embedding, ...) -> (vec_id, n_links, component_id, kept) for every row."""
    rows = common.add_id_check(vectors, ["vec_id", "label", "embedding"])
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(fine)
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    nodes = common.scratch(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")  # ids are fixed once written
    group = [F.col("label"), F.size("embedding").alias("dim")]
    tiles = nodes.groupBy(*group).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    met = nodes.withColumn("dim", F.size("embedding")).join(tiles, ["label", "dim"])
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    spread = met.withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    units = spread.select("label", "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "weight", "embedding")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable").reset_index(drop=True)
        x = unit(np.stack(part["embedding"].to_numpy()))
        i, j = part["i"].iat[0], part["j"].iat[0]
        if i == j:
            a, b = tile_links(x, x, least)
            a, b = a[a < b], b[a < b]
        else:
            left, right = (np.flatnonzero(part["tile"].to_numpy() == t) for t in (i, j))
            if not len(left) or not len(right):
                return pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")
            a, b = tile_links(x[left], x[right], least)
            a, b = left[a], right[b]
        weight, n = part["weight"].to_numpy(), len(part)
        links = (np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)).astype(np.int64)
        root = forest(n, a, b)
        ids, some = part["node"].to_numpy(), links > 0
        return pd.DataFrame({"node": ids[some], "links": links[some], "root": ids[root[some]]})

    found = units.groupBy("label", "dim", "i", "j").applyInPandas(compare, "node long, links long, root long")
    found = common.scratch(found, "vector-links")
    member = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(counts, "node", "left").join(member.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    named = named.select("label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), "n_links", "component_id")
    joined = good.join(named, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
