"""Document fingerprints: bottom-k sketches of hashed five-word shingles.

A sketch is the ``K`` smallest distinct 48-bit hashes of a text's shingles, in ascending order. It estimates the number of
distinct shingles, and with another sketch resemblance and containment; sketches of parts merge into the sketch of their union.
A text with at most ``K`` distinct shingles is kept exactly, so its estimates are exact against such texts.

Words are runs of non-white-space, A-Z lower-cased; fewer than five words are one shingle, no words an empty sketch. Hashes are
built from word hashes with numpy, so equal texts have equal sketches on any machine.

Defined cases: a null text counts as empty; two empty sketches resemble each other fully (1), an empty and another not (0).
Repeated rows and ids are documents of their own, ordered by id and then text; a null id comes last. A single document is its own
next document. An empty table gives an empty result. Extra columns are unread.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, WORDS = 256, 5
SPACE48 = 1 << 48
SLICE = 8 << 20


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """48-bit hashes of all shingles, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(h) - words + 1)
    total = np.full(n, min(words, len(h)), np.uint64)
    for k in range(min(words, len(h))):  # order matters: each step multiplies before the next word is added
        total = (total ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return (total ^ (total >> np.uint64(32))) >> np.uint64(16)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values."""
    if len(hashes) > 8 * k:
        near = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(near) >= k:
            return near[:k]
    return np.unique(hashes)[:k]


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    return bottom(shingle_hashes(text, words), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's shingles that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles: exact below k, else from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) * SPACE48 / float(a[k - 1] + np.uint64(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b has."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def packed(a: np.ndarray) -> bytes:
    return a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(six), 2), np.uint8), six], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def as_text(a: np.ndarray) -> str:
    return base64.b64encode(packed(a)).decode()


def from_text(s: str) -> np.ndarray:
    return unpacked(base64.b64decode(s))


def sketched(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, sketch binary, shingles double)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE):
                made = [sketch(t, k, words) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array([packed(a) for a in made], pa.binary()), pa.array([distinct_count(a, k) for a in made], pa.float64())],
                    names=["doc_id", "sketch", "shingles"],
                )

    return common.add_id_check(docs, ["doc_id", "text"]).mapInArrow(make, "doc_id long, sketch binary, shingles double")


def merged(sketches: DataFrame, by: str, k: int = K, salts: int = 64) -> DataFrame:
    """(by, sketch) -> (by, sketch): sketches of unions. Groups are merged per salt first, so a group may hold any share of the rows."""

    @F.pandas_udf("binary")
    def union(parts: pd.Series) -> bytes:
        out = np.empty(0, np.uint64)
        for s in range(0, len(parts), 256):
            out = bottom(np.concatenate([out, *(unpacked(bytes(p)) for p in parts.iloc[s : s + 256] if p is not None)]), k)
        return packed(out)

    salted = sketches.select(F.col(by), "sketch", F.pmod(F.xxhash64("sketch"), F.lit(salts)).alias("_salt"))
    return salted.groupBy(by, "_salt").agg(union("sketch").alias("sketch")).groupBy(by).agg(union("sketch").alias("sketch"))


def with_neighbours(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, in the order of descending doc_id.

    Edited: the last third of the code points is replaced by the first as many of the next document (after the last: the first).
    One range shuffle of the texts: ids are cut at quantiles into more ranges than partitions; the first row of a range is sent
    to the range before it as well, so every document meets its successor in its own range.
    """
    spark = docs.sparkSession
    docs = common.add_id_check(docs, ["doc_id", "text"])
    width = common.shuffle_width(spark)
    cuts = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / width for i in range(1, width)], 1 / (4 * width))
    cuts = sorted({int(c) for c in cuts}, reverse=True)  # width numbers at most
    place = F.lit(len(cuts))
    if cuts:
        bounds = F.array(*[F.lit(c) for c in cuts])
        place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(bounds, lambda c: c > F.col("doc_id"))))
    ranged = docs.withColumn("range", place.cast("int")).withColumn("copy", F.lit(False))
    # the head of a range: its largest doc_id, of equal ids the smallest text hash; ids and hashes of at most `width` rows on the driver
    tie = F.xxhash64("text")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(-F.col("doc_id"), F.lit(0)).alias("o"), tie.alias("t"))
    heads = ranged.groupBy("range").agg(F.min(order).alias("h")).orderBy("range").collect()
    if not heads:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    full = [r["range"] for r in heads]
    before = {r: (full[i - 1] if i else full[-1]) for i, r in enumerate(full)}
    turn = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])  # a range and the one before it
    firsts = spark.createDataFrame([(r["range"], r["h"]["none"], r["h"]["o"], r["h"]["t"]) for r in heads], "r int, none boolean, o long, t long")
    keyed = ranged.withColumn("none", F.col("doc_id").isNull()).withColumn("o", F.coalesce(-F.col("doc_id"), F.lit(0))).withColumn("t", tie)
    copies = keyed.join(F.broadcast(firsts), ["none", "o", "t"], "left_semi").dropDuplicates(["range"])
    copies = copies.withColumn("range", turn[F.col("range")]).withColumn("copy", F.lit(True))
    names = ["range", "copy", "none", "o", "t", "doc_id", "text"]
    rows = keyed.select(names).union(copies.select(names))
    ordered = rows.repartitionById(max(full) + 1, F.col("range")).sortWithinPartitions("range", "copy", "none", "o", "t")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for whole in batches:
                for batch in common.slices(whole, "text", SLICE):
                    yield from zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)

        out: list[tuple] = []
        last = None
        for where, doc, text in stream():
            text = text or ""
            now = (where, doc, text, sketch(text, k, words))
            if last is not None and last[0] == where:
                _, d, t, own = last
                cut = len(t) // 3
                edited = t[: len(t) - cut] + text[:cut]
                other = sketch(edited, k, words)
                out.append((d, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(other), resemblance(own, other, k), resemblance(own, now[3], k)))
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
            last = now
        if out:
            yield batch_of(out)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=fields)

    return ordered.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
