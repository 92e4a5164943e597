"""Near copies by exact Jaccard similarity of five-word shingle sets, over candidates from banded MinHash.

Texts with equal shingle sets are one node. A node's BANDS keys, each of ROWS MinHash values, put it into buckets; a pair of
similarity s shares a bucket with probability 1 - (1 - s^ROWS)^BANDS (0.999997 at 0.8). Every link is decided by the exact
similarity of the two sets.

Bands are worked off in a few steps, the first of one band: a text that is linked to one with a smaller id leaves all later bands, so a
large group of copies shrinks before it would fill every bucket. A step has two passes. In the first, a bucket is dealt by hash to units of
bounded rows and shingles; a unit compares its members, in id order, with the earlier ones that are linked to no earlier one. A
group of copies so costs one row a member and leaves a few members a unit. In the second pass, the rest of the buckets that
needed several units meets in every pair of units; only a large bucket of unlike texts makes many of these. Sets go to the task that
compares them and links come back, never pairs. Of two rows that stay none is a near copy of the other if they shared a bucket: in
a unit where both are, the smaller is compared with the larger. Every text that goes has a link to a smaller id; links
between texts that both go may be missing, so a chain of near copies may keep more than its smallest id, never two alike.

Defined cases: texts without words are one node. Fewer words than a shingle are one shingle. Null ids, repeated ids and repeated rows
as in ``simhash.representatives``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import rows_of_least
from .sketches import WORDS, shingle_hashes

BANDS, ROWS = 32, 5
SIMILARITY = 0.8
SLICE = 8 << 20
STRIP = 4096
STEPS = (1, 3, 8, BANDS)  # ends of the groups of bands worked off together
BLOCK, SHINGLES = 512, 1 << 19  # rows and shingles of a unit; a worker sorts its shingles in memory
_DRAWN = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
FACTORS, SHIFTS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for s in range(0, len(hashes), STRIP):
        mixed = hashes[s : s + STRIP, None] * FACTORS + SHIFTS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, node, n, keys): node is a hash of the shingle set, n its size."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE):
                sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                keys = pa.array([band_keys(s).view(np.int64).tolist() for s in sets], pa.list_(pa.int64()))
                columns = [batch.column("doc_id").cast(pa.int64()), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), keys]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "keys"])

    return common.add_id_check(docs, ["doc_id", "text"]).mapInArrow(sign, "doc_id long, node long, n long, keys array<long>")


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text, ...) -> (node, shingles binary)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE):
                raw = [shingle_set(t, words).tobytes() for t in batch.column("text").to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(raw, pa.binary())], names=["node", "shingles"])

    return common.add_id_check(docs, ["doc_id", "text"]).mapInArrow(make, "node long, shingles binary")


def greedy_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(later, earlier) for every set that is at least ``similarity`` alike to an earlier one that is not itself such a one."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    alive, out = np.arange(len(sets)), []
    held, starts = codes, np.r_[0, np.cumsum(sizes)[:-1]]
    marked = np.zeros(codes.max() + 1, np.int64)
    at = 0
    while at < len(alive) - 1:
        first = alive[at]
        mine = held[starts[at] : starts[at] + sizes[first]]
        marked[mine] = 1
        both = np.add.reduceat(marked[held[starts[at + 1] :]], starts[at + 1 :] - starts[at + 1])
        marked[mine] = 0
        later = alive[at + 1 :]
        like = both >= similarity * (sizes[first] + sizes[later] - both)
        if like.any():
            out += [(int(k), int(first)) for k in later[like]]
            stay = np.r_[np.ones(at + 1, bool), ~like]
            held = held[np.repeat(stay, sizes[alive])]
            alive = alive[stay]
            starts = np.r_[0, np.cumsum(sizes[alive])[:-1]]
        at += 1
    return out


def compared(units: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """units(bucket, i, j, m) -> (a, b, node): links between members of a unit, a < b, with the node of the larger id."""
    spark = units.sparkSession
    placed = units.join(common.dealt(sets), F.col("m.node") == sets["node"]).select("bucket", "i", "j", F.col("m.least").alias("least"), "node", "shingles")
    placed = placed.repartition(common.shuffle_width(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "least", "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs():
            key, nodes, found = None, [], []
            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j")), strict=True))
                ids, raw = batch.column("node").to_pylist(), batch.column("shingles")
                for k, node, value in zip(keys, ids, raw, strict=True):
                    if k != key:
                        if len(nodes) > 1:
                            yield nodes, found
                        key, nodes, found = k, [], []
                    nodes.append(node)
                    found.append(np.frombuffer(value.as_py(), np.uint64))
            if len(nodes) > 1:
                yield nodes, found

        later, earlier = [], []
        for nodes, found in runs():
            for x, y in greedy_links(found, similarity):
                later.append(nodes[x])
                earlier.append(nodes[y])
        x, y = np.array(later, np.int64), np.array(earlier, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(x)], names=["a", "b", "node"])

    return placed.mapInArrow(check, "a long, b long, node long")


def crowded(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one."""
    return members.join(common.dealt(members.groupBy("bucket").count().where("count > 1").select("bucket")), "bucket", "left_semi")


def links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """nodes(node, least, n, keys, one doc_id of it) -> (a, b): links that leave no two near copies unlinked to a smaller id."""
    at = nodes.select(F.struct(F.coalesce("least", F.lit(2**63 - 1)).alias("least"), "node", "n").alias("m"), F.posexplode("keys").alias("band", "key"))
    everyone = common.scratch(crowded(at.select("band", F.xxhash64("band", "key").alias("bucket"), "m")), "buckets")
    wanted = common.dealt(everyone.select("m.node").distinct())
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("least").alias("_id")).distinct()
    texts = docs.join(common.dealt(ids), docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    sets = common.scratch(sets_of(texts, words).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "shingle-sets")
    out = docs.sparkSession.createDataFrame([], "a long, b long")
    gone = docs.sparkSession.createDataFrame([], "node long")  # nodes linked to a smaller id: they need no other link
    for first, end in zip((0, *STEPS), STEPS, strict=False):
        step = everyone.where(F.col("band").between(first, end - 1)).select("bucket", "m")
        members = common.scratch(crowded(without(step, gone)), "buckets")
        for whole in (False, True):
            units, large = units_of(members, whole), None
            found = common.scratch(compared(units, sets, similarity), "near-links")
            out, gone = out.union(found.select("a", "b")), common.scratch(gone.union(found.select("node")).distinct(), "gone")
            if not whole:
                large = common.scratch(parts_of(members).where("parts > 1"), "large-buckets")
                left = common.scratch(crowded(without(members.join(common.dealt(large), "bucket", "left_semi"), gone)), "buckets")
                common.delete(members)
                members = left
                if large.isEmpty():
                    break
        common.delete(members)
    return out


def parts_of(members: DataFrame) -> DataFrame:
    """(bucket, parts): how many units of bounded rows and shingles a bucket needs."""
    return members.groupBy("bucket").agg(F.ceil(F.sum(1 / F.lit(BLOCK) + F.col("m.n") / F.lit(float(SHINGLES)))).cast("int").alias("parts"))


def units_of(members: DataFrame, whole: bool) -> DataFrame:
    """Members dealt to the parts of their bucket by hash; ``whole``: to every pair of parts that holds theirs, so all members meet."""
    met = members.join(common.dealt(parts_of(members)), "bucket")
    part = F.pmod(F.xxhash64("m.node"), F.col("parts")).cast("int")
    if not whole:
        return met.select("bucket", part.alias("i"), part.alias("j"), "m")
    met = met.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "m")


def without(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(common.dealt(gone), F.col("m.node") == gone["node"], "left_anti")


def components_of(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """docs -> (doc_id, component_id): component_id is the smallest doc_id reachable over the links found, itself included."""
    marked = common.scratch(signed(docs, words), "signatures")
    nodes = common.scratch(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")), "set-nodes")
    member = components(links(docs, nodes, similarity, words)).withColumnRenamed("node", "_node")
    grouped = nodes.join(common.dealt(member), nodes["node"] == member["_node"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "node").join(common.dealt(grouped.join(common.dealt(least), "root").select("node", "component_id")), "node").select("doc_id", "component_id")


def representatives(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """docs with one row of each group of near copies, as ``simhash.representatives``."""
    return rows_of_least(docs, components_of(docs, similarity, words))
