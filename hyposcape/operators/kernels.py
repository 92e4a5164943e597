"""Kernels between points, computed block against block.

Points are hashed into blocks of bounded size, whatever their labels or copies.  Two blocks meet in one task,
which forms their small dense kernel with one matrix product and emits only reduced rows (sums, counts, top
lists), never the pairs themselves.  Where one side is a bounded set of centres, the other side streams past
the broadcast centres in linear time (``cross_apply``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_BYTES = 64 << 20
STRIP_CELLS = 1_000_000
MAX_CENTRES = 20000


@dataclass(frozen=True)
class Kernel:
    """Kernel family and scale; ``nu`` is used by the Matern family only (infinity gives RBF)."""

    kind: str = "matern"
    length_scale: float = 1.0
    nu: float = 1.5

    def __post_init__(self):
        if self.kind not in ("matern", "rbf", "identity"):
            raise ValueError(f"unknown kernel type {self.kind!r}")

    def of_distance(self, d: np.ndarray) -> np.ndarray:
        """Kernel values of a distance array (one task's block)."""
        if self.kind == "identity":
            return (d == 0).astype(float)
        r = d / self.length_scale
        if self.kind == "rbf" or math.isinf(self.nu):
            k = -0.5 * r
            k *= r
            return np.exp(k, out=k)
        if self.nu in (0.5, 1.5, 2.5):
            r *= math.sqrt(2.0 * self.nu)
            k = np.exp(-r)
            if self.nu > 0.5:
                rise = 1.0 + r
                if self.nu > 1.5:
                    r *= r
                    r /= 3.0
                    rise += r
                k *= rise
            return k
        t = math.sqrt(2.0 * self.nu) * np.where(r == 0, 1e-8, r)
        value = np.exp(log_bessel_power(self.nu, t) + ((1.0 - self.nu) * math.log(2.0) - math.lgamma(self.nu)))
        return np.where(d == 0, 1.0, value)

    def column(self, d: Column) -> Column:
        """Same closed forms as a Column expression of a distance."""
        r = d / F.lit(self.length_scale)
        if self.kind == "rbf" or math.isinf(self.nu):
            return F.exp(r * r * F.lit(-0.5))
        t = r * F.lit(math.sqrt(2.0 * self.nu))
        forms = {0.5: F.lit(1.0), 1.5: F.lit(1.0) + t, 2.5: F.lit(1.0) + t + t * t / F.lit(3.0)}
        if self.nu not in forms:
            raise ValueError("general nu has no closed form; use the block operators")
        return forms[self.nu] * F.exp(-t)


def log_bessel_k(nu: float, x: np.ndarray) -> np.ndarray:
    """Log of exp(x) times the modified Bessel function of the second kind: trapezoid rule on the integral of exp(x - x cosh t)
    cosh(nu t), with its largest factor taken out.  For x of at least 1e-16."""
    t = np.linspace(0.0, 45.0, 901)
    step = t[1] - t[0]
    peak = np.arcsinh(nu / x)
    top = nu * peak - x * (np.cosh(peak) - 1.0)
    out = np.full(x.shape, 0.0)
    for i, ti in enumerate(t):
        w = step * (0.5 if i == 0 else 1.0)
        out += w * np.exp(nu * ti - x * (math.cosh(ti) - 1.0) - top) * 0.5 * (1.0 + math.exp(-2.0 * nu * ti))
    return top + np.log(out)


BESSEL_LOW, BESSEL_HIGH, BESSEL_STEP = math.log(1e-16), math.log(800.0), 2e-3


@lru_cache(maxsize=8)
def bessel_table(nu: float) -> np.ndarray:
    """Cubics of log(x^nu exp(x) K_nu(x)) over even steps of log x, four coefficients a step, from values and exact slopes at its
    ends; their error is below 1e-12."""
    u = BESSEL_LOW + BESSEL_STEP * np.arange(math.ceil((BESSEL_HIGH - BESSEL_LOW) / BESSEL_STEP) + 1)
    x = np.exp(u)
    k = log_bessel_k(nu, x)
    f = nu * u + k
    s = BESSEL_STEP * x * (1.0 - np.exp(log_bessel_k(abs(nu - 1.0), x) - k))  # d/du by K' = -K_(nu-1) - nu K_nu / x
    rise = f[1:] - f[:-1]
    return np.stack([f[:-1], s[:-1], 3.0 * rise - 2.0 * s[:-1] - s[1:], s[:-1] + s[1:] - 2.0 * rise], axis=1)


def log_bessel_power(nu: float, x: np.ndarray) -> np.ndarray:
    """log(x^nu K_nu(x)) by one look-up a cell; beyond the table's end, where exp(-x) is zero in double precision, its last entry."""
    table = bessel_table(nu)
    at = (np.log(np.maximum(x, 1e-16)) - BESSEL_LOW) / BESSEL_STEP
    i = np.clip(at, 0, len(table) - 1).astype(np.intp)
    at = np.clip(at - i, 0.0, 1.0)
    out = table[i, 3]
    for j in (2, 1, 0):
        out *= at
        out += table[i, j]
    return out - x


def distances(a: np.ndarray, b: np.ndarray, same: bool, offset: int = 0) -> np.ndarray:
    """Euclidean distances by the Gram identity around the centre of b, so a common offset costs no digits.  ``same``: row i
    of a is row i + offset of b, so that cell is zero."""
    mid = b.mean(axis=0) if len(b) else 0.0
    a, b = a - mid, b - mid
    d = np.add.outer((a * a).sum(1), (b * b).sum(1))
    cross = a @ b.T
    cross *= 2.0
    d -= cross
    np.sqrt(np.maximum(d, 0.0, out=d), out=d)
    if same:
        i = np.arange(len(a))
        d[i, i + offset] = 0.0
    return d


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Distance of two array columns as an expression."""
    diff = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x))


def block_count(df: DataFrame, features: str = "v", block_rows: int | None = None) -> int:
    """How many blocks to cut the points into.

    Every block travels to every other, so the traffic is points * blocks: as few blocks as give the cluster
    some four block pairs per core, but none above 64 MiB of features.
    """
    size = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("d")).first()
    n, d = size["n"], size["d"] or 1
    if block_rows:
        return max(1, math.ceil(n / block_rows))
    for_cores = math.ceil(math.sqrt(8 * df.sparkSession.sparkContext.defaultParallelism))
    return max(1, math.ceil(n * d * 8 / BLOCK_BYTES), min(for_cores, math.ceil(n / 256)))


def to_blocks(df: DataFrame, n_blocks: int, features: str = "v", key: str = "id", extra: Sequence[str] = ()) -> DataFrame:
    """Pack points into blocks by key hash: ``blk, ids, x`` (row-major features) and one array per extra column."""
    blk = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
    packed = df.select(blk.alias("blk"), F.struct(F.col(key).alias("k"), F.col(features).alias("f"), *extra).alias("s"))
    g = packed.groupBy("blk").agg(F.sort_array(F.collect_list("s")).alias("g"))
    return g.select(
        "blk", F.col("g.k").alias("ids"), F.flatten(F.col("g.f")).alias("x"), *[F.col(f"g.{c}").alias(c) for c in extra]
    )


@dataclass
class Block:
    """One side of a block pair inside a task.  The left side comes in strips of rows; ``offset`` is the strip's first
    row within its block."""

    blk: int
    ids: np.ndarray
    x: np.ndarray
    extra: dict[str, np.ndarray]
    offset: int = 0

    def strip(self, at: int, rows: int) -> Block:
        to = slice(at, at + rows)
        return Block(self.blk, self.ids[to], self.x[to], {c: v[to] for c, v in self.extra.items()}, at)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Cells of a strip against its whole block that pair a point with itself."""
        i = np.arange(len(self.ids))
        return i, i + self.offset


def pair_reduce(
    left: DataFrame,
    right: DataFrame | None,
    n_left: int,
    n_right: int,
    reduce: Callable[[Block, Block, Iterator[tuple[Block, np.ndarray]]], Iterator[pd.DataFrame]],
    schema: str,
    triangle: bool = True,
) -> DataFrame:
    """Let every block of ``left`` meet every block of ``right`` and emit what ``reduce`` returns.

    ``right=None`` pairs ``left`` with itself; with ``triangle`` each unordered pair of blocks is visited once.
    ``reduce`` gets both blocks and the strips of the left one with their distances, so the dense part stays small and what it
    emits need not grow with the strips.
    """
    alone = right is None
    met, _ = paired(left, right, n_left, n_right, triangle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                li, rj = sides(row)
                yield from reduce(li, rj, strips(li, rj, alone and li.blk == rj.blk))

    return met.mapInPandas(run, schema)


def each_strip(fn: Callable[[Block, Block, np.ndarray], Iterator[pd.DataFrame]]):
    """A reducer that treats every strip by itself."""

    def reduce(a: Block, b: Block, parts: Iterator[tuple[Block, np.ndarray]]) -> Iterator[pd.DataFrame]:
        for part, d in parts:
            yield from fn(part, b, d)

    return reduce


def paired(left: DataFrame, right: DataFrame | None, n_left: int, n_right: int, triangle: bool = True) -> tuple[DataFrame, int]:
    """Rows ``bi, bj, l_..., r_...``, one for every pair of blocks that meet, dealt by (bi, bj) to the number of partitions returned."""
    half = right is None and triangle
    right = left if right is None else right
    tasks = min(20000, n_left * (n_left + 1) // 2 if half else n_left * n_right)
    lo = F.col("blk") if half else F.lit(0)
    a = left.withColumn("bj", F.explode(F.sequence(lo, F.lit(n_right - 1))))
    a = a.select(F.col("blk").alias("bi"), "bj", *[F.col(c).alias(f"l_{c}") for c in left.columns if c != "blk"])
    hi = F.col("blk") if half else F.lit(n_left - 1)
    b = right.withColumn("bi", F.explode(F.sequence(F.lit(0), hi)))
    b = b.select("bi", F.col("blk").alias("bj"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "blk"])
    return a.repartition(tasks, "bi", "bj").join(b.repartition(tasks, "bi", "bj"), ["bi", "bj"]), tasks


def sides(row: dict) -> tuple[Block, Block]:
    """Both blocks of a row of ``paired``."""

    def side(blk: int, mark: str) -> Block:
        extra = {c[2:]: v for c, v in row.items() if c.startswith(mark) and c not in (f"{mark}ids", f"{mark}x")}
        return Block(blk, row[f"{mark}ids"], unpack(row[f"{mark}x"], len(row[f"{mark}ids"])), extra)

    return side(row["bi"], "l_"), side(row["bj"], "r_")


def strips(a: Block, b: Block, same: bool) -> Iterator[tuple[Block, np.ndarray]]:
    """Strips of the left block with their distances to the whole right block."""
    step = max(1, STRIP_CELLS // len(b.ids))
    for at in range(0, len(a.ids), step):
        part = a.strip(at, step)
        yield part, distances(part.x, b.x, same, at)


def unpack(flat: np.ndarray, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(n, -1)


@dataclass
class Points:
    """A relation of points packed once into blocks."""

    blocks: DataFrame
    n_blocks: int

    @classmethod
    def pack(cls, df: DataFrame, extra: Sequence[str] = (), block_rows: int | None = None, materialise: bool = True) -> Points:
        nb = block_count(df, "v", block_rows)
        b = to_blocks(df, nb, extra=extra)
        return cls(cut_lineage(b) if materialise else b, nb)

    def reduce(self, fn, schema: str, other: Points | None = None, triangle: bool = True) -> DataFrame:
        right = None if other is None else other.blocks
        return pair_reduce(self.blocks, right, self.n_blocks, (other or self).n_blocks, fn, schema, triangle)


def row_sums(pts: Points, kernels: dict[str, Kernel], jitter: float = 0.0) -> DataFrame:
    """Sum over the whole relation of each kernel's row, one column per name."""
    names = list(kernels)

    def fn(a: Block, b: Block, parts):
        same, back = a.blk == b.blk, {n: np.zeros(len(b.ids)) for n in names}
        for part, d in parts:
            out = {}
            for n in names:
                k = kernels[n].of_distance(d)
                out[n] = k.sum(1)
                if not same:
                    back[n] += k.sum(0)
            yield pd.DataFrame({"id": part.ids, **out})
        if not same:
            yield pd.DataFrame({"id": b.ids, **back})

    out = pts.reduce(fn, "id bigint, " + ", ".join(f"{n} double" for n in names))
    return out.groupBy("id").agg(*[(F.sum(n) + F.lit(jitter)).alias(n) for n in names])


def group_similarity(pts: Points, kernel: Kernel, group: str) -> DataFrame:
    """Per point and group: sum and number of kernel values to that group's other points (self left out)."""

    def rows(ids, groups, sums, counts):
        at = np.repeat(np.arange(len(ids)), len(groups))
        return pd.DataFrame({"id": ids[at], "other": np.tile(groups, len(ids)), "s": sums.ravel(), "c": counts.ravel().astype("int64")})

    def members(block):
        groups, of = np.unique(block.extra[group], return_inverse=True)
        return groups.astype("int64"), of, (of[:, None] == np.arange(len(groups))).astype(float)

    def fn(a: Block, b: Block, parts):
        same = a.blk == b.blk
        ga, _, in_a = members(a)
        gb, of_b, in_b = members(b)
        back = np.zeros((len(b.ids), len(ga)))
        for part, d in parts:
            k = kernel.of_distance(d)
            if same:
                k[part.own()] = 0.0
            counts = np.tile(in_b.sum(0), (len(part.ids), 1))
            if same:
                counts[np.arange(len(part.ids)), of_b[part.offset : part.offset + len(part.ids)]] -= 1
            yield rows(part.ids, gb, k @ in_b, counts)
            if not same:
                back += k.T @ in_a[part.offset : part.offset + len(part.ids)]
        if not same:
            yield rows(b.ids, ga, back, np.tile(in_a.sum(0), (len(b.ids), 1)))

    out = pts.reduce(fn, "id bigint, other int, s double, c bigint")
    return out.groupBy("id", "other").agg(F.sum("s").alias("sim_sum"), F.sum("c").alias("sim_n"))


def pair_type_stats(pts: Points, kernel: Kernel, label: str = "label") -> DataFrame:
    """Unordered pairs by type (signal-signal, null-null, cross): count, mean distance, mean kernel."""

    def fn(a: Block, b: Block, d: np.ndarray):
        yield from _by_type(a, b, d, kernel, label)

    out = pts.reduce(each_strip(fn), "pair_type string, n bigint, sd double, sk double")
    g = out.groupBy("pair_type").agg(F.sum("n").alias("n"), F.sum("sd").alias("sd"), F.sum("sk").alias("sk"))
    return g.select("pair_type", "n", (F.col("sd") / F.col("n")).alias("mean_distance"), (F.col("sk") / F.col("n")).alias("mean_kernel"))


def _types(a: Block, b: Block, label: str | None) -> np.ndarray:
    """Pair code per cell: 0 signal-signal, 1 cross, 2 null-null; -1 for cells that are not counted."""
    shape = (len(a.ids), len(b.ids))
    code = np.zeros(shape, dtype=np.int8) if label is None else np.add.outer(a.extra[label].astype(np.int8), b.extra[label].astype(np.int8))
    if a.blk == b.blk:
        later = np.arange(len(b.ids))[None, :] > (np.arange(len(a.ids)) + a.offset)[:, None]
        code = np.where(later, code, np.int8(-1))
    return code


TYPE_NAMES = {0: "H1-H1", 1: "cross", 2: "H0-H0"}


def _by_type(a, b, d, kernel, label):
    code, k = _types(a, b, label), kernel.of_distance(d)
    for t, name in TYPE_NAMES.items():
        m = code == t
        if m.any():
            yield pd.DataFrame({"pair_type": [name], "n": [int(m.sum())], "sd": [d[m].sum()], "sk": [k[m].sum()]})


MAX_KEPT = 200_000


def distance_quantiles(
    pts: Points, probs: Sequence[float], label: str | None = None, with_diagonal: bool = False, bins: int = 4096
) -> DataFrame:
    """Exact quantiles of all pair distances, per pair type if ``label`` is given.

    Counting passes narrow the value range around each wanted rank until few distances are left there; a last
    pass collapses those to (value, count) rows.  Only bin counts and these few rows reach the driver.
    ``with_diagonal`` counts the full matrix: every pair twice plus zeros.
    """
    types = TYPE_NAMES if label else {0: "all"}
    size = pts.blocks.agg(
        F.sum(F.size("ids")).alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("m"), F.max(F.size("x") / F.size("ids")).alias("d")
    ).first()
    top = 2.0 * size["m"] * math.sqrt(size["d"]) * 1.0001 + 1e-300

    def spread(ranges: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        def fn(a: Block, b: Block, parts):
            counts = np.zeros((len(ranges), bins), dtype="int64")
            for part, d in parts:
                for t, x in by_type(part, b, d):
                    for r, (_, edges) in enumerate(ranges):
                        if ranges[r][0] == t:
                            counts[r] += in_bins(x, edges)
            r, at = np.nonzero(counts)
            yield pd.DataFrame({"r": r.astype("int32"), "bin": at.astype("int64"), "c": counts[r, at]})

        got = pts.reduce(fn, "r int, bin bigint, c bigint").groupBy("r", "bin").agg(F.sum("c").alias("c"))
        return got.toPandas().sort_values(["r", "bin"])  # at most ranges * bins rows

    def by_type(a: Block, b: Block, d: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The distances of each pair type."""
        if label is None and a.blk != b.blk:
            yield 0, d.ravel()
            return
        code = _types(a, b, label)
        for t in types:
            yield t, d[code == t]

    grid = np.linspace(0.0, top, bins + 1)
    first = spread([(t, grid) for t in types])
    want = []  # type, probability, position, rank, range start, range end, pairs below, pairs inside
    out = []
    for r, t in enumerate(types):
        h = first[first.r == r]
        pairs = int(h.c.sum())
        mult, zeros = (2, int(size["n"])) if with_diagonal else (1, 0)
        total = pairs * mult + zeros
        if not pairs:
            continue
        for q in probs:
            pos = (total - 1) * q
            for full_rank in {math.floor(pos), math.ceil(pos)}:
                if full_rank < zeros:
                    out.append((t, float(q), pos, full_rank, 0.0))
                else:
                    want.append(_narrow(t, float(q), pos, full_rank, (full_rank - zeros) // mult, grid, h, 0))
    while want and sum(w[-1] for w in want) > MAX_KEPT and max(w[7] - w[6] for w in want) > 1e-12 * top:
        ends = sorted({(w[0], w[6], w[7]) for w in want})  # neighbouring ranks mostly share their range
        cuts = [np.linspace(lo, hi, bins + 1) for _, lo, hi in ends]
        h = spread([(e[0], c) for e, c in zip(ends, cuts)])
        at = [ends.index((w[0], w[6], w[7])) for w in want]
        want = [_narrow(*w[:5], cuts[i], h[h.r == i], w[5]) for i, w in zip(at, want)]
    ends = sorted({(w[0], w[6], w[7]) for w in want})

    def keep(a: Block, b: Block, d: np.ndarray):
        for t, x in by_type(a, b, d):
            for r, (other, lo, hi) in enumerate(ends):
                if t == other:
                    u, c = np.unique(x[(x >= lo) & (x < hi)], return_counts=True)
                    yield pd.DataFrame({"r": r, "d": u, "c": c.astype("int64")})

    if want:
        kept = pts.reduce(each_strip(keep), "r int, d double, c bigint").groupBy("r", "d").agg(F.sum("c").alias("c")).toPandas()
        for w in want:
            h = kept[kept.r == ends.index((w[0], w[6], w[7]))].sort_values("d")
            at = np.searchsorted(h.c.cumsum().to_numpy(), w[4] - w[5], side="right")
            out.append((w[0], w[1], w[2], w[3], float(h.d.iloc[at])))
    rows = []
    for t, q, pos in sorted({o[:3] for o in out}):
        v = [o[4] for o in sorted(out, key=lambda o: o[3]) if o[:3] == (t, q, pos)]
        rows.append((types[t], q, v[0] + (v[-1] - v[0]) * (pos - math.floor(pos))))
    return pts.blocks.sparkSession.createDataFrame(rows, "pair_type string, prob double, value double")


def in_bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many values lie in each of the even bins [edges[i], edges[i + 1]); others are left out."""
    n = len(edges) - 1
    x = x[(x >= edges[0]) & (x < edges[-1])]
    width = (edges[-1] - edges[0]) / n
    at = np.clip((x - edges[0]) / width, 0, n - 1).astype(np.intp) if width > 0 else np.zeros(len(x), dtype=np.intp)
    at -= x < edges[at]  # the quotient is rounded, the edges decide
    at += x >= edges[at + 1]
    return np.bincount(at, minlength=n)


def _narrow(t, q, pos, full_rank, rank, edges, hist, below):
    """Pick the histogram bin that holds a rank: (..., pairs below the bin, bin start, bin end, pairs inside)."""
    cum = hist.c.cumsum().to_numpy() + below
    at = int(np.searchsorted(cum, rank, side="right"))
    b = int(hist.bin.iloc[at])
    inside = int(hist.c.iloc[at])
    return (t, q, pos, full_rank, rank, int(cum[at]) - inside, edges[b], edges[b + 1], inside)


def median_length_scale(pts: Points, with_diagonal: bool = False) -> float:
    """Median heuristic over all pairs."""
    return float(distance_quantiles(pts, [0.5], with_diagonal=with_diagonal).first()["value"])


def scott_scale(n: int, d: int) -> float:
    return n ** (-1.0 / (d + 4))


def length_scale(pts: Points, n: int, d: int, method: str = "median") -> float:
    if method == "median":
        return median_length_scale(pts)
    if method == "scott":
        return scott_scale(n, d)
    raise ValueError(f"unknown length-scale method {method!r}")


def closest(d: np.ndarray, k: int) -> np.ndarray:
    """Flat positions of cells that hold every row's k smallest values, ties included, and few others: the kth smallest of the
    minima of disjoint groups of columns is a bound that at least k values reach."""
    n, m = d.shape
    size = m // max(4 * k, 64)
    if size < 2:
        return np.arange(n * m)
    groups = m // size
    least = np.fmin.reduce(d[:, : size * groups].reshape(n, size, groups), axis=1)
    bound = np.partition(least, k - 1, axis=1)[:, k - 1]
    bound[np.isnan(bound)] = np.inf
    return np.flatnonzero(d <= bound[:, None])


def neighbours(pts: Points, k: int, include_self: bool = False, other: Points | None = None) -> DataFrame:
    """The k nearest points of each point: ``id, rank, nid, d`` (ties by id).  Each task keeps k candidates per point."""

    def best(nids, d):
        """Row, id and distance of the k nearest of every row, sorted; ``nids`` has the id of a column or of a cell."""
        cells = closest(d, k)
        i, j = np.divmod(cells, d.shape[1])
        x, n = d.ravel()[cells], nids[j] if nids.ndim == 1 else nids.ravel()[cells]
        order = np.lexsort((n, x, i))
        i, n, x = i[order], n[order], x[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[kept], n[kept], x[kept]

    def rows(ids, i, n, x):
        out = pd.DataFrame({"id": ids[i], "nid": n, "d": x})
        return out[np.isfinite(out.d)]

    alone = other is None

    def fn(a: Block, b: Block, parts):
        same = alone and a.blk == b.blk
        near, near_ids = np.full((len(b.ids), k), np.inf), np.full((len(b.ids), k), np.iinfo("int64").max)
        for part, d in parts:
            if same and not include_self:
                d[part.own()] = np.inf
            yield rows(part.ids, *best(b.ids, d))
            if alone and not same:
                i, n, x = best(part.ids, np.ascontiguousarray(d.T))
                place = np.arange(len(i)) - np.searchsorted(i, i)
                both = np.full((len(b.ids), 2 * k), np.inf)
                both_ids = np.full((len(b.ids), 2 * k), np.iinfo("int64").max)
                both[:, :k], both_ids[:, :k] = near, near_ids
                both[i, k + place], both_ids[i, k + place] = x, n
                order = np.lexsort((both_ids, both), axis=1)[:, :k]
                near, near_ids = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)
        if alone and not same:
            yield rows(b.ids, np.repeat(np.arange(len(b.ids)), k), near_ids.ravel(), near.ravel())

    cand = pts.reduce(fn, "id bigint, nid bigint, d double", other)
    w = W.partitionBy("id").orderBy("d", "nid")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def kernel_entries(pts: Points, kernel: Kernel, min_value: float, other: Points | None = None) -> DataFrame:
    """Entries ``id, nid, k`` of the kernel (or of a rows-by-columns slice of it) that reach ``min_value``: a sparse matrix
    whose size follows the data, not the number of pairs."""
    alone = other is None

    def fn(a: Block, b: Block, d: np.ndarray):
        k = kernel.of_distance(d)
        i, j = np.nonzero(k >= min_value)
        yield pd.DataFrame({"id": a.ids[i], "nid": b.ids[j], "k": k[i, j]})

    return pts.reduce(each_strip(fn), "id bigint, nid bigint, k double", None if alone else other, triangle=False)


def location_density(pts: Points, n: int, d: int, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density of every location, with Scott's factor by default.  ``log_density`` keeps the constant
    out of the exponent, so high dimensions do not overflow."""
    h = scott_scale(n, d) if bandwidth is None else bandwidth
    sums = row_sums(pts, {"s": Kernel("rbf", h)})
    const = math.log(n) + d * (math.log(h) + 0.5 * math.log(2 * math.pi))
    return sums.select("id", (F.log("s") - F.lit(const)).alias("log_density"))


def affinity_degrees(pts: Points, kernel: Kernel) -> DataFrame:
    """Row sums plus 1e-10: the degrees of the normalised affinity D^-1/2 K D^-1/2."""
    return row_sums(pts, {"degree": kernel}, jitter=1e-10)


@dataclass
class BlockKernel:
    """A whole kernel matrix as an operator.  Kept are the pairs of point blocks, every block once beside each partner (points *
    blocks); each product computes the entries of its pairs anew, strip by strip, so nothing grows with the square of the rows
    but time."""

    pairs: DataFrame
    n_blocks: int
    tasks: int
    kernel: Kernel
    jitter: float = 0.0
    scale: str | None = None

    @classmethod
    def build(cls, pts: Points, kernel: Kernel, jitter: float = 0.0, scale: str | None = None) -> BlockKernel:
        """``scale`` names an extra column s; the entries become s_i K_ij s_j (e.g. inverse root degrees)."""
        # kept where the vector blocks come to meet them; a lost partition is dealt again from the checkpointed points
        pairs, tasks = paired(pts.blocks, None, pts.n_blocks, pts.n_blocks)
        return cls(pairs.persist(StorageLevel.MEMORY_AND_DISK), pts.n_blocks, tasks, kernel, jitter, scale)

    def release(self) -> None:
        self.pairs.unpersist()

    def matvec(self, vec: DataFrame, width: int = 1) -> DataFrame:
        """K times a vector (``id, y double``) or a bundle of vectors (``y array<double>`` of the given width)."""
        n, kernel, jitter, scale = self.n_blocks, self.kernel, self.jitter, self.scale
        blk = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        y = F.col("y") if width > 1 else F.array("y")
        packed = vec.select(blk.alias("blk"), F.struct("id", y.alias("y")).alias("s")).groupBy("blk")
        packed = packed.agg(F.flatten(F.sort_array(F.collect_list("s")).getField("y")).alias("y"))
        # a pair needs the vector of both its sides; one row per pair carries them
        partner = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
        sent = packed.select("blk", "y", partner)
        left = F.col("blk") <= F.col("other")
        bi, bj = F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj")
        sent = sent.select(bi, bj, F.when(left, F.col("y")).alias("ly"), F.when(F.col("blk") >= F.col("other"), F.col("y")).alias("ry"))
        sent = sent.repartition(self.tasks, "bi", "bj").groupBy("bi", "bj").agg(F.max("ly").alias("ly"), F.max("ry").alias("ry"))
        met = self.pairs.join(sent.hint("shuffle_hash"), ["bi", "bj"])

        def run(batches):
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    ly, ry = unpack(row.pop("ly"), len(row["l_ids"])), unpack(row.pop("ry"), len(row["r_ids"]))
                    a, b = sides(row)
                    same = a.blk == b.blk
                    back = np.zeros((len(b.ids), width))
                    for part, d in strips(a, b, same):
                        k = kernel.of_distance(d)
                        if same and jitter:
                            k[part.own()] += jitter
                        if scale:
                            k *= part.extra[scale][:, None]
                            k *= b.extra[scale][None, :]
                        yield frame(part.ids, k @ ry)
                        if not same:
                            back += k.T @ ly[part.offset : part.offset + len(part.ids)]
                    if not same:
                        yield frame(b.ids, back)

        def frame(ids, part):
            return pd.DataFrame({"id": ids, **{f"y{j}": part[:, j] for j in range(width)}})

        parts = met.mapInPandas(run, "id bigint, " + ", ".join(f"y{j} double" for j in range(width)))
        sums = parts.groupBy("id").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)])
        out = F.array(*[F.col(f"y{j}") for j in range(width)]) if width > 1 else F.col("y0")
        return sums.select("id", out.alias("y"))


def cross_apply(
    df: DataFrame,
    centres: DataFrame,
    kernel: Kernel,
    weights: Sequence[str],
    features: str = "v",
    max_centres: int = MAX_CENTRES,
) -> DataFrame:
    """Replace the features of every row by ``k_<w>`` = sum_j K(row, centre_j) * w_j for each weight column of the centres.

    Up to ``max_centres`` centres (checked) travel to the tasks and the rows stream past them; a larger set is
    packed into blocks and met block by block, with the same result.
    """
    few = centres.select("id", features, *weights).limit(max_centres + 1).toPandas()
    if len(few) <= max_centres:
        c = np.stack([np.asarray(v, dtype=float) for v in few[features]])
        w = few[list(weights)].to_numpy(dtype=float)

        def run(batches):
            for pdf in batches:
                step = max(1, STRIP_CELLS // max(1, len(c)))  # rows per product, so memory stays flat
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at : at + step]
                    x = np.stack([np.asarray(v, dtype=float) for v in part[features]])
                    out = kernel.of_distance(distances(x, c, False)) @ w
                    yield part.drop(columns=features).assign(**{f"k_{n}": out[:, j] for j, n in enumerate(weights)})

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != features)
        return df.mapInPandas(run, fields + "".join(f", k_{n} double" for n in weights))
    left = Points.pack(df.select("id", F.col(features).alias("v")))
    right = Points.pack(centres.select("id", F.col(features).alias("v"), *weights), extra=list(weights))

    def fn(a: Block, b: Block, d: np.ndarray):
        k = kernel.of_distance(d)
        yield pd.DataFrame({"id": a.ids, **{f"k_{n}": k @ b.extra[n] for n in weights}})

    sums = left.reduce(each_strip(fn), "id bigint" + "".join(f", k_{n} double" for n in weights), right)
    return df.drop(features).join(sums.groupBy("id").agg(*[F.sum(f"k_{n}").alias(f"k_{n}") for n in weights]), "id")
