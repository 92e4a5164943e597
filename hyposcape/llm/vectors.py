"""Shared by the vector operators: usable rows of Arrow batches as matrices, floored integers, exact integer products, exact sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 8192  # rows worked on at once


def usable(column: str):
    """Vectors that are not null or empty and hold numbers only."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(column) > 0) & finite, F.lit(False))


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The most frequent length of usable vectors (ties: the longer); 0 if there are none."""
    lengths = vectors.where(usable(column)).groupBy(F.size(column).alias("d")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return int(first["d"]) if first else 0


def matrices(batch: pa.RecordBatch, dim: int, column: str = "embedding") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, double matrix) of the usable vectors of length ``dim``, some rows at a time."""
    for s in range(0, batch.num_rows, ROWS):
        lists = batch.column(column).slice(s, ROWS)
        fits = np.flatnonzero(pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == dim)
        flat = lists.take(pa.array(fits)).flatten().cast(pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(len(fits), dim)  # null entries become NaN
        fine = np.isfinite(x).all(1)
        if fine.any():
            yield s + fits[fine], x[fine]


def floored(x: np.ndarray, factor: int, limit: int) -> np.ndarray:
    """floor(factor * x) as int64; beyond +-limit the limit stands."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(factor * x), -limit, limit).astype(np.int64)


def limb_bits(terms: int) -> int:
    """Bits of a limb so that a sum of ``terms`` products of two limbs stays below 2**53."""
    return (53 - int(terms).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Doubles with x = sum of limb k times 2**(k bits); limbs are signed, at most 2**(bits - 1) in size."""
    half, out = 1 << (bits - 1), []
    while True:
        low = ((x + half) & ((1 << bits) - 1)) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> bits
        if not x.any():
            return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact: limb products by BLAS, recombined in int64 (the result has to fit there)."""
    bits = limb_bits(a.shape[1])
    total = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, bits)
    for i, p in enumerate(limbs(a, bits)):
        for j, q in enumerate(right):
            if p.any() and q.any():
                total += (p @ q.T).astype(np.int64) << (bits * (i + j))
    return total


def sums_by_slot(parts: DataFrame) -> dict[int, int]:
    """parts(slot long, total long) of the tasks -> exact sum of each slot; the slots are bounded by the model, not by the rows."""
    summed = parts.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {r["slot"]: int(r["total"]) for r in summed.collect()}


def slot_batch(slots: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    used = totals != 0
    return pa.RecordBatch.from_arrays([pa.array(slots[used].astype(np.int64)), pa.array(totals[used].astype(np.int64))], names=["slot", "total"])
