"""SimHash near-duplicates by a grid range join over per-segment bit counts.

Fingerprints are 64-bit majority votes over shingle hashes. Two fingerprints link at ``max_bits`` or fewer differing bits.

Search: the 64 bits are cut into 2-bit segments; the vector of segment bit counts changes by at most the Hamming distance in
Manhattan distance, so that is a lower bound. A link has at most one unit of it in one of the two halves of the vector
(max_bits <= 3), hence the range join: every distinct fingerprint goes to the grid cell of each half and to the cells one
count above, so that pairs meet if a half is within Manhattan distance one; the exact distance of all 64 bits then decides. A half has about 23 bits of entropy, so cells stay small unless texts are alike.

Groups of copies: equal fingerprints are one node. Cells that no other fingerprint can share are dropped by a join with the
occupied cells. A cell with very many members is cut into blocks by hash; a task gets one block against one block and
returns a spanning forest of its links, never the pairs, so output is linear in the members.

Defined cases: null, empty and blank texts have no words and the fingerprint zero, which links like any other. Fewer words than
a shingle: the whole sequence is the only shingle. Repeated rows and repeated ids each get a row. A null doc_id gets a row; it
is ignored in component ids unless its group has no other id. An empty table gives an empty result. Extra columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SLICE = 16 << 20
BLOCK = 1024  # fingerprints of a cell block
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # bits of each byte value, lowest first


def text_fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    by_byte = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(by_byte[:, k], minlength=256) @ BITS
        out |= int(((2 * ones > len(starts)) << np.arange(8)).sum()) << (8 * k)
    return out


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp long): the fingerprint's bits as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE):
                fp = np.array([text_fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return common.add_id_check(docs, ["doc_id", "text"]).mapInArrow(hashed, "doc_id long, fp long")


LOW = 0x55555555  # the low bit of each 2-bit segment of a half


def segment_counts(half):
    """Bit counts of the 16 two-bit segments of a 32-bit half, in place."""
    return half.bitwiseAND(F.lit(LOW)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(LOW))


def grid_rows(fps: DataFrame) -> DataFrame:
    """(fp) -> (cell, fp, own): its cell in each half, and the cells one count above in one segment (own = false)."""
    fp = F.col("fp")
    halved = fps.select("fp", segment_counts(fp.bitwiseAND(F.lit(0xFFFFFFFF))).alias("c0"), segment_counts(F.shiftrightunsigned(fp, 32)).alias("c1"))
    places = []
    for half in (0, 1):
        value, tag = F.col(f"c{half}"), F.lit(half << 32)
        places.append(F.struct(value.bitwiseOR(tag).alias("cell"), F.lit(True).alias("own")))
        for k in range(16):
            room = F.shiftrightunsigned(value, 2 * k).bitwiseAND(F.lit(3)) < 2
            places.append(F.when(room, F.struct((value + F.lit(1 << (2 * k))).bitwiseOR(tag).alias("cell"), F.lit(False).alias("own"))))
    return halved.select("fp", F.explode(F.array(*places)).alias("at")).where("at is not null").select("at.cell", "fp", "at.own")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over links i-j."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(left: np.ndarray, right: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among two blocks of fingerprints: (member, representative) for members that link to something else."""
    nodes, where = np.unique(np.r_[left, right], return_inverse=True)
    where_left, where_right = where[: len(left)], where[len(left) :]
    found_i, found_j = [], []
    for s in range(0, len(left), 256):
        apart = np.bitwise_count(left[s : s + 256, None] ^ right[None, :])
        i, j = np.nonzero(apart <= max_bits)
        found_i.append(where_left[s + i])
        found_j.append(where_right[j])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    root = forest(len(nodes), i, j)
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Distinct (fp) -> (a, b): links that connect exactly the fingerprints reachable over pairs of at most ``max_bits`` bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the two-half grid is exact for 0 to 3 differing bits")
    rows = grid_rows(fps)
    occupied = rows.where("own").groupBy("cell").agg(F.count("*").alias("n_own"))
    met = rows.join(common.dealt(occupied), "cell").where("not own or n_own > 1")
    met = common.scratch(met, "grid")
    # a cell's own members matter if it has two of them or a member from below
    size = met.groupBy("cell").agg(F.count("*").alias("n_all"), F.max("n_own").alias("n"))
    alone = rows.where("own").join(common.dealt(met.where("not own").select("cell").distinct()), "cell", "left_semi").select("cell", "fp")
    left = alone.union(met.where("own").select("cell", "fp")).distinct()
    blocks = size.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_left"), F.ceil((F.col("n_all") + F.col("n")) / BLOCK).cast("int").alias("n_right"))
    h = F.xxhash64("fp")
    blocks = common.dealt(blocks)
    lefts = left.join(blocks, "cell").select(
        "cell", F.pmod(h, F.col("n_left")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("j"), "fp", F.lit(0).alias("side")
    )
    rights = left.union(met.where("not own").select("cell", "fp")).join(blocks, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("i"), F.pmod(h, F.col("n_right")).cast("int").alias("j"), "fp", F.lit(1).alias("side")
    )
    width = common.shuffle_width(fps.sparkSession)
    units = lefts.union(rights).repartition(width, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs():
            held, held_key = [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                cols = [batch.column(c).to_numpy() for c in ("cell", "i", "j", "side", "fp")]
                cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
                for s, e in zip(np.r_[0, cut], np.r_[cut, len(cols[0])], strict=True):
                    k = (cols[0][s], cols[1][s], cols[2][s])
                    if held_key is not None and k != held_key:
                        yield held
                        held = []
                    held_key = k
                    held.append((cols[3][s:e], cols[4][s:e]))
            if held:
                yield held

        a, b = [], []
        for unit in runs():
            side, fp = np.concatenate([x[0] for x in unit]), np.concatenate([x[1] for x in unit]).view(np.uint64)
            left_, right_ = fp[side == 0], fp[side == 1]
            if len(left_) and len(right_):
                x, y = block_links(left_, right_, max_bits)
                if len(x):
                    a.append(x)
                    b.append(y)
            if sum(map(len, a)) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

    return units.mapInArrow(linked, "a long, b long").distinct()


def components_of(docs: DataFrame, words: int = 3, seed: int = 42, max_bits: int = 3) -> DataFrame:
    """docs -> (doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    fps = common.scratch(fingerprints(docs, words, seed), "fingerprints")
    nodes = common.scratch(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    member = components(links(nodes.select("fp"), max_bits))  # (node, root) over fingerprints
    grouped = nodes.join(common.dealt(member), nodes["fp"] == member["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(common.dealt(least), "root").select("fp", "component_id")
    return fps.join(common.dealt(named), "fp").select("doc_id", "fp", "component_id")


def fingerprint_text(fp):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, words: int = 3, seed: int = 42, max_bits: int = 3) -> DataFrame:
    """docs with one row of each group: the rows of its smallest doc_id, and of rows that repeat that id only one.

    Rows with a null doc_id stay only if their group has no other id; one of them is kept.
    """
    return rows_of_least(docs, components_of(docs, words, seed, max_bits))


def rows_of_least(docs: DataFrame, *groupings: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is its own component_id in every grouping (doc_id, component_id), one a doc_id."""
    columns = docs.columns
    own = [ids.where("doc_id <=> component_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.lit(1).alias("k")) for ids in groupings]
    kept = own[0] if len(own) == 1 else reduce(DataFrame.union, own).groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("k").alias("k")).where(F.col("k") == len(own))
    name = common.unique_name(columns, "_kept")
    kept = common.scratch(kept.select(F.col("doc_id").alias(name), "n"), "kept-ids")
    rows = docs.join(kept.select(name).hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")
    if kept.where("n > 1").isEmpty():  # no id repeats: the next step would change nothing
        return rows
    return rows.dropDuplicates(["doc_id"])
