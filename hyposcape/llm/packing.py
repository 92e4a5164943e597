"""Best-fit packing of tokenised documents into sequences of a fixed length.

Sizes are whole numbers up to the sequence length, so sorted documents and sorted gaps are runs of equal sizes, and a place in
the order is (size, rank within the size). The ranks of the rows are found on the executors; the bulk-synchronous matching
works on runs:

* a step takes all pieces of the largest remaining size at once;
* a successor sweep over the gap runs in ascending order gives them the smallest gaps that hold them, a gap that holds several
  takes several; ranks resolve who gets which place, since run by run the next ranks go to the next bins;
* the gaps shrink (runs split in two at most), the next step follows, until no size remains.

That is best-fit decreasing. It sees at most ``length`` sizes and emits intervals "ranks r.. of size s go to bins b.., k each at
offset o", whose number depends on the sequence length and not on the corpus; the pieces then look up their interval in a
broadcast of bounded size. Rows, texts and tokens never pass through the driver.

Documents longer than a sequence are cut from the end into full pieces, so the first piece is the remainder and may be shorter.

Defined cases: a null or empty text is the end token alone. Repeated rows and ids are packed each; they get equal piece rows at
different places. A null doc_id stays null. An empty table gives an empty result. Extra columns are unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH = 2048
SLICE = 4 << 20


@cache  # Python workers live through many tasks
def tokenizer(ranks_path: str, pattern: str):
    """Token ids of a text under the byte-level vocabulary, as a function; the same ids as the JSON form of that vocabulary."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@cache
def json_tokenizer(json_path: str):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(json_path)
    return lambda text: known.encode(text, add_special_tokens=False).ids


SPECIAL = "<|endoftext|>"


def encoder(name: str = "byte_bpe_50k"):
    """Text -> ids of a public vocabulary. Texts that hold its special string go to the JSON form, loaded when one comes."""
    import public_tokenizers as P

    plain = tokenizer(P.path(f"{name}.tiktoken"), P.PATTERN)
    return lambda text: json_tokenizer(P.path(f"{name}.json"))(text) if SPECIAL in text else plain(text)


def piece_lengths(n: int, length: int) -> list[int]:
    """Full pieces from the end; the first takes what is left."""
    first = n % length or length
    return [n] if n <= length else [first] + [length] * ((n - first) // length)


def tokenised(docs: DataFrame, length: int = LENGTH, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32[, ids])."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE):
                rows, ids_out = [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = encode(text or "")
                    ids.append(end_id)
                    raw = np.array(ids, "<u4")
                    del ids
                    start = 0
                    for piece, n in enumerate(piece_lengths(len(raw), length)):
                        part = raw[start : start + n]
                        rows.append((doc, piece, start, n, zlib.crc32(part)))
                        if with_ids:
                            ids_out.append(part.astype(np.int32))
                        start += n
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                if with_ids:
                    arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return common.add_id_check(docs, ["doc_id", "text"]).mapInArrow(cut, schema)


def best_fit(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """{size: pieces} -> intervals (size, first rank, end rank, first bin, pieces a bin, offset).

    Ranks first..end-1 of a size go, ``pieces a bin`` each, to bins first bin, first bin + 1, ...; the k-th of a bin starts at
    offset + k * size. The sum of the sizes of a bin is at most ``length`` and offsets have no gaps.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first bin, bins)
    bins = 0
    out = []
    for size in sorted((s for s, n in histogram.items() if n), reverse=True):
        left, rank = histogram[size], 0
        fitting = sorted(g for g in gaps if g >= size)
        changed: list[tuple[int, tuple[int, int]]] = []
        for gap in fitting:
            while left and gaps[gap]:
                first, n = gaps[gap].pop()
                each = min(gap // size, left)
                full = min(n, left // each)
                out.append((size, rank, rank + full * each, first, each, length - gap))
                changed.append((gap - each * size, (first, full)))
                left, rank = left - full * each, rank + full * each
                if full < n:
                    gaps[gap].append((first + full, n - full))
            if not gaps[gap]:
                del gaps[gap]
            if not left:
                break
        while left:
            each = min(length // size, left)
            full = left // each
            out.append((size, rank, rank + full * each, bins, each, 0))
            changed.append((length - each * size, (bins, full)))
            bins, left, rank = bins + full, left - full * each, rank + full * each
        for gap, run in changed:
            if gap:
                gaps.setdefault(gap, []).append(run)
    return out


def place(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces with ``length`` (and any other columns) -> the same rows with sequence_id long and offset long.

    Ranks: rows of a size are dealt to shards by hash, numbered inside their shard, and shifted by the counts of the shards
    before, so one size may hold any share of the rows.
    """
    spark = pieces.sparkSession
    shards = max(4, common.shuffle_width(spark))
    key = [c for c in pieces.columns if c != "ids"]
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int"))
    counted = dealt.groupBy("length", "_shard").agg(F.count("*").alias("_n"))  # at most length x shards rows
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    sizes = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `length` rows
    plan = best_fit(sizes, length)
    columns = "length long, _from long, _to long, _bin long, _each long, _at long"
    intervals = spark.createDataFrame(plan, columns)
    # every size's intervals, by first rank, as one array: the piece finds its own with a filter over its size's array only
    lists = intervals.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_bin", "_each", "_at"))).alias("_plan"))
    numbered = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_shard").orderBy(*key)))
    ranked = numbered.join(offsets, ["length", "_shard"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    found = ranked.join(F.broadcast(lists), "length").withColumn(
        "_hit", F.element_at(F.filter("_plan", lambda x: (x["_from"] <= F.col("_rank")) & (F.col("_rank") < x["_to"])), 1)
    )
    step = F.col("_rank") - F.col("_hit._from")
    return found.select(
        *[F.col(c) for c in pieces.columns],
        (F.col("_hit._bin") + F.floor(step / F.col("_hit._each"))).cast("long").alias("sequence_id"),
        (F.col("_hit._at") + F.pmod(step, F.col("_hit._each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents -> one row a piece with its sequence and offset."""
    return place(common.scratch(tokenised(docs, length, end_id, with_ids), "pieces"), length)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> (sequence_id, ids, doc_ids, offsets), a row a training sequence; a sequence has at most ``length`` ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
