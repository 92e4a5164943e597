"""Scores z'Wz of a graph under many permutations of z.

A permutation sorts the nodes by a hash; its value at place k is the z of the k-th node.  Values and edges meet in tiles:

* ``permuted``: per permutation the nodes go by hash into cells of bounded size, each sorted by one task; counts of the cells give the
  places.  A node and permutation travel once, as twelve bytes of an array.
* ``tiled``: places are cut into few blocks, the edges between two blocks are one tile, packed by row.
* ``scores``: a task holds the edges of one tile and reads the two value blocks of its permutations one after the other, so it never holds more
  than one permutation's.  A value is sent once a block, never once an edge; an edge once a group of permutations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..session import cut_lineage

CELL = 1 << 18  # values sorted by one task at once
FLUSH = 1 << 15  # nodes of a task whose draws are held at once
PLAIN = 1 << 12  # neighbouring places that go together where nothing is to be ranked
TILE = 24_000_000  # edges a task holds, nine bytes each or thirteen
PACK = 1 << 19  # edges of a packed row
GROUP_BYTES = 640 << 20  # values sent to one task


@dataclass(frozen=True)
class Tiles:
    """How places and permutations are dealt: blocks of ``size`` places, ``groups`` of permutations."""

    size: int
    count: int
    groups: int

    @classmethod
    def of(cls, nodes: int, edges: int, n_perms: int, cores: int) -> Tiles:
        count = max(1, math.ceil(math.sqrt(2 * edges / TILE))) if edges > TILE else 1
        size = max(1, -(-nodes // count))
        groups = max(-(-cores // (count * (count + 1) // 2)), -(-2 * size * 8 * (n_perms + 1) // GROUP_BYTES))
        return cls(size, count, min(n_perms + 1, groups))

    def pair(self, left, right):
        """Number of the tile of two blocks, left <= right."""
        return (left * self.count + right).cast("int")


def in_line(nodes: DataFrame) -> DataFrame:
    """Nodes (id, z) with their number ``line`` in the order that breaks ties of a permutation's hash."""
    width = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    order = F.concat(F.col("id").cast("string"), F.lit("|"))
    ranged = nodes.withColumn("_s", order).repartitionByRange(width, "_s").sortWithinPartitions("_s")
    return cut_lineage(ranged.select("id", "z", F.monotonically_increasing_id().alias("line")))


def cells_of(batch: pa.RecordBatch, n_perms: int, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a batch's nodes, a column a permutation, and the cells they fall into."""
    h = batch.column("h").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_perms)
    return h.astype(np.uint32), (h * n_cells >> 32).astype(np.int32)


def permuted(nodes: DataFrame, n_perms: int, tiles: Tiles, n: int) -> DataFrame:
    """Nodes (id, z) -> the values of every permutation in order of place: (perm from 1, block, start, z binary)."""
    n_cells, size = max(1, -(-n // CELL)), tiles.size
    key = F.col("id").cast("string")
    draws = F.transform(F.sequence(F.lit(1), F.lit(n_perms)), lambda p: hash32(F.concat_ws("|", key, p.cast("string")), "perm"))
    drawn = in_line(nodes).select("line", "z", draws.alias("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_perms, n_cells), np.int64)
        for batch in batches:
            cell = cells_of(batch, n_perms, n_cells)[1]
            for p in range(n_perms):
                total[p] += np.bincount(cell[:, p], minlength=n_cells)
        p, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total[p, c])], names=["p", "cell", "n"])

    first = np.zeros((n_perms, n_cells + 1), np.int64)
    for r in drawn.select("h").mapInArrow(count, "p int, cell int, n bigint").groupBy("p", "cell").agg(F.sum("n").alias("n")).collect():
        first[r["p"], r["cell"] + 1] = r["n"]  # a row a cell, some 260,000 values each
    first = first.cumsum(1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            line, z = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("line", "z"))
            h, cell = (np.concatenate(v) for v in zip(*(cells_of(b, n_perms, n_cells) for b in held), strict=True))
            out = []
            for p in range(n_perms):
                order = np.argsort(cell[:, p], kind="stable")  # in line within a cell
                cuts = np.flatnonzero(np.r_[True, np.diff(cell[order, p]) != 0, True])
                for at in (order[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)):
                    out.append((p, int(cell[at[0], p]), int(line[at[0]]), h[at, p].tobytes(), z[at].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["p", "cell", "line", "h", "z"])

        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held, rows = [*held, batch], rows + batch.num_rows
            if rows >= FLUSH:
                yield dealt(held)
                held, rows = [], 0
        if held:
            yield dealt(held)

    def rank(table: pa.Table) -> pa.Table:
        p, cell = table.column("p")[0].as_py(), table.column("cell")[0].as_py()
        order = np.argsort(table.column("line").to_numpy(), kind="stable").tolist()
        joined = [b"".join(table.column(c)[i].as_py() for i in order) for c in ("h", "z")]
        at = np.argsort(np.frombuffer(joined[0], np.uint32), kind="stable")
        return cut_places(p + 1, int(first[p, cell]), np.frombuffer(joined[1], np.float64)[at], size)

    dealt = drawn.mapInArrow(deal, "p int, cell int, line bigint, h binary, z binary")
    return dealt.groupBy("p", "cell").applyInArrow(rank, PIECE)


PIECE = "perm int, block int, start int, z binary"


def cut_places(perm: int, first: int, z: np.ndarray, size: int) -> pa.Table:
    """Values of neighbouring places, cut where a block ends."""
    cuts = [first, *range((first // size + 1) * size, first + len(z), size), first + len(z)]
    rows = [(perm, lo // size, lo % size, z[lo - first : hi - first].tobytes()) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({n: pa.array(v, t) for n, v, t in zip(("perm", "block", "start", "z"), zip(*rows, strict=True), kinds, strict=True)})


def unpermuted(places: DataFrame, tiles: Tiles) -> DataFrame:
    """Values (k, z) at their own places, as permutation 0."""

    def rank(table: pa.Table) -> pa.Table:
        k, z = table.column("k").to_numpy(), table.column("z").to_numpy()
        order = np.argsort(k)
        return cut_places(0, int(k[order[0]]), z[order], tiles.size)

    return places.select(F.floor(F.col("k") / PLAIN).alias("cell"), F.col("k").cast("bigint").alias("k"), "z").groupBy("cell").applyInArrow(rank, PIECE)


def tiled(pairs: DataFrame, tiles: Tiles) -> DataFrame:
    """Edges (lo, hi, w) between places, lo <= hi, packed: (tile, rows, starts, cols, w)."""
    width = 4 * pairs.sparkSession.sparkContext.defaultParallelism
    left, right = (F.floor(F.col(c) / tiles.size).cast("int") for c in ("lo", "hi"))
    row, col = ((F.col(c) % tiles.size).cast("int") for c in ("lo", "hi"))
    e = pairs.select(tiles.pair(left, right).alias("tile"), row.alias("row"), col.alias("col"), "w")
    e = e.repartition(width, "tile", F.shiftright("row", 8)).sortWithinPartitions("tile", "row", "col")

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, row, col, w = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(4))
        cuts = np.flatnonzero(np.r_[True, np.diff(tile) != 0, True])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            start = np.flatnonzero(np.r_[True, np.diff(row[lo:hi]) != 0])
            small = w[lo:hi].astype(np.float32)  # whole numbers mostly: half the bytes where nothing is lost
            made = [row[lo:hi][start], start.astype(np.int32), col[lo:hi], small if (small == w[lo:hi]).all() else w[lo:hi]]
            yield pa.RecordBatch.from_arrays([pa.array([int(tile[lo])], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in made]], names=["tile", "rows", "starts", "cols", "w"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held, size = [*held, batch], size + batch.num_rows
            if size >= PACK:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    return e.mapInArrow(pack, "tile int, rows binary, starts binary, cols binary, w binary")


class Tile:
    """The edges a task holds and the two value blocks of one permutation."""

    def __init__(self, tile: int, tiles: Tiles):
        self.left, self.right = divmod(tile, tiles.count)
        self.size, self.edges, self.perm, self.values = tiles.size, [], None, {}

    def add_edges(self, row: dict) -> None:
        rows, start, cols = (np.frombuffer(row[c], np.int32) for c in ("rows", "starts", "cols"))
        self.edges.append((rows, start, cols, np.frombuffer(row["w"], np.float32 if len(row["w"]) == 4 * len(cols) else np.float64)))

    def add_values(self, row: dict) -> None:
        if row["block"] not in self.values:
            self.values[row["block"]] = np.zeros(self.size)
        z = np.frombuffer(row["z"], np.float64)
        self.values[row["block"]][row["start"] : row["start"] + len(z)] = z

    def score(self) -> float:
        """Sum of w z z over the edges."""
        left, right = self.values[self.left], self.values[self.right]
        return sum(float(np.add.reduceat(right[cols] * w, start) @ left[rows]) for rows, start, cols, w in self.edges)


def scores(pairs: DataFrame, places: DataFrame, n_perms: int, n_pairs: int, n: int) -> DataFrame:
    """(perm, s): sum over the edges (lo, hi, w) between places of w times the values there, for the values (id, k, z) themselves (0) and
    under permutations 1 to ``n_perms``; no rows without edges."""
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    tiles = Tiles.of(n, n_pairs, n_perms, cores)
    values = unpermuted(places, tiles).unionByName(permuted(places.select("id", "z"), n_perms, tiles, n))
    group = (F.col("perm") % tiles.groups).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.lit(tiles.count - 1)))
    values = values.withColumn("other", partner).withColumn("tile", tiles.pair(F.least("block", "other"), F.greatest("block", "other")))
    values = values.withColumn("group", group).drop("other")
    edges = tiled(pairs, tiles).withColumn("perm", F.lit(-1)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(tiles.groups - 1))))
    left = F.floor(F.col("tile") / tiles.count).cast("int")
    before = left * tiles.count - F.floor(left * (left - 1) / 2).cast("int") - left  # tiles are numbered with gaps, tasks without
    met = values.unionByName(edges, allowMissingColumns=True)
    met = met.withColumn("task", ((before + F.col("tile") % tiles.count) * tiles.groups + F.col("group")).cast("int"))
    met = met.repartitionById(tiles.count * (tiles.count + 1) // 2 * tiles.groups, "task").sortWithinPartitions("perm").drop("task", "group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, out = None, []

        def close() -> None:
            if tile.perm is not None and tile.edges:
                out.append((tile.perm, tile.score()))
            tile.values = {}

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                tile = tile or Tile(row["tile"], tiles)
                if row["perm"] < 0:
                    tile.add_edges(row)
                    continue
                if row["perm"] != tile.perm:
                    close()
                    tile.perm = row["perm"]
                tile.add_values(row)
        if tile:
            close()
        perm, s = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(perm, pa.int32()), pa.array(s, pa.float64())], names=["perm", "s"])

    return met.mapInArrow(run, "perm int, s double").groupBy("perm").agg(F.sum("s").alias("s"))
