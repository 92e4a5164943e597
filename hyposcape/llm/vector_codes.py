"""Product codes of vectors with exact integer arithmetic: limb-split products and first nearest entries.

A component becomes floor(1024 x). Vectors are cut into PARTS consecutive parts; every part position has a codebook of ENTRIES
integer vectors. A round assigns each part to its nearest entry and moves each entry to the floored mean of its parts. The
distance |x|^2 - 2 x.c + |c|^2 needs dot products of integers only: both sides are split into limbs so small that a BLAS product in
double precision stays below 2**53 and is exact, and the limb products are recombined in int64. The first least distance wins.

A round is one pass over the vectors. A task returns integer sums and counts of its entries (PARTS x ENTRIES x width numbers at
most, whatever its rows), Spark adds them up, and the new codebooks go out with the next round's tasks. Sums are exact, so the
result depends neither on the partitions nor on a task that ran twice.

Defined cases: null and empty vectors and those with null or non-finite components get no row, nor do vectors of another length than
the most frequent one (ties: the longer), as they fit no codebook. A length that PARTS does not divide is cut at floor(k d / PARTS).
Components are held at +-2**b where sums of squares would leave 64 bits (b is 27 for parts of 16; see ``limit_of``). Fewer vectors than
ENTRIES give fewer entries. Rows that repeat a vec_id are rows of their own; the first codebook takes them in the order of the
vector, null ids last. A ``label_error`` beyond 64 bits is null. An empty table gives an empty result. Extra columns are unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import attach
from . import common, vectors
from .vectors import exact_products, floored

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def cuts_of(dim: int, parts: int = PARTS) -> list[int]:
    return [k * dim // parts for k in range(parts + 1)]


def limit_of(width: int) -> int:
    """Largest component held: width squares of differences, and two dot products, stay below 2**62."""
    return 1 << ((60 - max(1, width).bit_length()) // 2)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first nearest entry, squared distance) of every integer row, exact."""
    scores = (book * book).sum(1) - 2 * exact_products(x, book)
    code = scores.argmin(1)
    return code, scores[np.arange(len(x)), code] + (x * x).sum(1)


def entry_sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """(entries, 1 + width): how many rows took an entry, and their sum; integers throughout."""
    out = np.zeros((entries, 1 + x.shape[1]), np.int64)
    if len(x):
        order = np.argsort(code, kind="stable")
        sorted_code = code[order]
        starts = np.flatnonzero(np.r_[True, np.diff(sorted_code) != 0])
        out[sorted_code[starts], 1:] = np.add.reduceat(x[order], starts, axis=0)
        out[:, 0] = np.bincount(code, minlength=entries)
    return out


def first_books(rows: DataFrame, dim: int, cuts: list[int], limit: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors of the ``entries`` smallest ids."""
    held = rows.where(vectors.usable("embedding") & (F.size("embedding") == dim)).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries)
    x = floored(np.array([r["embedding"] for r in held.select("embedding").collect()], np.float64).reshape(-1, dim), SCALE, limit)
    return [x[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def moved_books(rows: DataFrame, books: list[np.ndarray], dim: int, cuts: list[int], limit: int) -> list[np.ndarray]:
    """One round: every used entry becomes the floored mean of the parts nearest to it."""
    spans, n = list(zip(cuts, cuts[1:], strict=False)), len(books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((n, 1 + b - a), np.int64) for a, b in spans]
        for batch in batches:
            for _, v in vectors.matrices(batch, dim):
                x = floored(v, SCALE, limit)
                for total, book, (a, b) in zip(totals, books, spans, strict=True):
                    part = np.ascontiguousarray(x[:, a:b])
                    total += entry_sums(part, nearest(part, book)[0], n)
        flat = np.concatenate([t.ravel() for t in totals])
        yield vectors.slot_batch(np.arange(len(flat)), flat)

    found = vectors.sums_by_slot(rows.select("embedding").mapInArrow(sums, "slot long, total long"))
    moved, start = [], 0
    for book, (a, b) in zip(books, spans, strict=True):
        wide, new = 1 + b - a, book.copy()
        for e in range(n):
            count = found.get(start + e * wide, 0)
            if count:
                new[e] = [found.get(start + e * wide + 1 + k, 0) // count for k in range(b - a)]
        moved.append(new)
        start += n * wide
    return moved


def fit(rows: DataFrame, dim: int, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> list[np.ndarray]:
    """Codebooks, one (entries, width) int64 matrix a part."""
    cuts = cuts_of(dim, parts)
    limit = limit_of(max(b - a for a, b in zip(cuts, cuts[1:], strict=False)))
    books = first_books(rows, dim, cuts, limit, entries)
    for _ in range(rounds):
        books = moved_books(rows, books, dim, cuts, limit)
    return books


def assigned(rows: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """(vec_id, label, code string, error long) of every usable vector: two hex digits a part."""
    cuts = cuts_of(dim, len(books))
    spans = list(zip(cuts, cuts[1:], strict=False))
    limit = limit_of(max(b - a for a, b in spans))
    kind = rows.schema["label"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in vectors.matrices(batch, dim):
                x = floored(v, SCALE, limit)
                codes, error = np.zeros((len(x), len(spans)), np.uint8), np.zeros(len(x), np.int64)
                for k, (book, (a, b)) in enumerate(zip(books, spans, strict=True)):
                    codes[:, k], apart = nearest(np.ascontiguousarray(x[:, a:b]), book)
                    error += apart
                digits, wide = codes.tobytes().hex(), 2 * len(spans)
                text = pa.array([digits[i : i + wide] for i in range(0, len(digits), wide)], pa.string())
                held = batch.select(["vec_id", "label"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([held.column(0).cast(pa.int64()), held.column(1), text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(encode, f"vec_id long, label {kind}, code string, error long")


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def coded(table: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, embedding, ...) -> (vec_id, code, error, label_error, codebooks_sha256)."""
    rows = common.add_id_check(table, ["vec_id", "label", "embedding"])
    dim = vectors.dimension(rows)
    if not dim:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    books = fit(rows, dim, entries, rounds)
    codes = common.scratch(assigned(rows, books, dim), "codes")
    codes = codes.withColumns({"_null": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    totals = codes.groupBy("_null", "_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    joined = attach(codes, totals, ["_null", "_label"])
    return joined.select("vec_id", "code", "error", F.expr("try_cast(total as bigint)").alias("label_error"), F.lit(books_sha256(books)).alias("codebooks_sha256"))
