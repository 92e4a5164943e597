"""Line deduplication by range-partitioned line hashes and per-document keep bitmaps.

1. Each document's lines are hashed where the text is (128 bits of xxh3 over the normalised line); only hashes move.
2. The hashes are range-partitioned by (hash, document descending, position) and sorted inside the partitions, so even one
   line that fills a third of the corpus spreads over many tasks.
3. A streaming pass sees the documents of a line from the largest id down. The first document keeps its lines; the others
   lose theirs once ``min_docs`` documents are seen. Only the first and last line of a partition can continue elsewhere:
   those leave a summary (its largest documents, at most ``min_docs`` ids) and are settled by merging the summaries.
4. Dropped positions become one zlib-compressed keep bitmap per document, joined to the text to rebuild it.

Defined cases: null or empty text is one empty line. Documents are told apart by doc_id; rows that repeat a doc_id belong to
one document and each keeps its own bitmap, equal rows share one. A null doc_id is one document below all others. An empty
table gives an empty result. Only doc_id and text are read for the decision; extra columns pass through untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LOWEST = -(2**63)  # stands for a null doc_id
SLICE = 16 << 20


def line_keys(text: str | None) -> list[bytes]:
    """Normalised lines: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [x.strip() for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text) -> (h1, h2, doc, row, pos), a row per line of at least ``min_chars`` code points; row tells rows of one doc_id apart."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE):
                digests, docs_, rows, pos = [], [], [], []
                for doc, text, row in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("row").to_pylist(), strict=True):
                    for i, key in enumerate(line_keys(text)):
                        if _long_enough(key, min_chars):
                            digests.append(xxhash.xxh3_128_digest(key))
                            docs_.append(doc)
                            rows.append(row)
                            pos.append(i)
                both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(docs_, pa.int64()), pa.array(rows, pa.int64()), pa.array(pos, pa.int32())],
                    names=["h1", "h2", "doc", "row", "pos"],
                )

    return docs.select(F.coalesce("doc_id", F.lit(LOWEST)).cast("long").alias("doc"), "text", F.xxhash64("text").alias("row")).mapInArrow(
        hashed, "h1 long, h2 long, doc long, row long, pos int"
    )


DROP, OPEN, SUMMARY = 0, 1, 2


def decide(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Sorted (h1, h2, doc desc) rows of one partition -> dropped rows, undecided rows and summaries of the edge runs.

    State between batches is one run: its key, the ids of at most ``min_docs`` documents and the rows that wait for more of
    them, which are rows of fewer than ``min_docs`` documents.
    """
    key, ids, waiting, first = None, [], [], True  # waiting: (row, pos, doc), positions of documents after the first

    def out(kind, h1, h2, doc, row, pos):
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int8)), *(pa.array(np.broadcast_to(np.asarray(x, np.int64), n)) for x in (h1, h2, doc, row)), pa.array(np.broadcast_to(np.asarray(pos, np.int32), n))],
            names=["kind", "h1", "h2", "doc", "row", "pos"],
        )

    def summary():
        return out(SUMMARY, key[0], key[1], ids, 0, 0)

    def flush(kind):
        parts = waiting[:]
        waiting.clear()
        for doc, row, pos in parts:
            yield out(kind, key[0], key[1], doc, row, pos)

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, row, pos = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc", "row", "pos"))
        new = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        starts, ends = np.r_[0, new], np.r_[new, len(h1)]
        # runs that begin and end inside the batch are decided at once
        step = np.zeros(len(h1), np.int64)
        step[1:] = doc[1:] != doc[:-1]
        at = np.cumsum(step)
        rank = at - np.repeat(at[starts], ends - starts)  # 0 for the largest document of the run
        inner = np.zeros(len(starts), bool)
        inner[1:-1] = True
        take = np.repeat(inner & (rank[ends - 1] + 1 >= min_docs), ends - starts) & (rank > 0)
        if take.any():
            yield out(DROP, h1[take], h2[take], doc[take], row[take], pos[take])
        for s, e in [(starts[0], ends[0]), (starts[-1], ends[-1])][: len(starts)]:
            now = (int(h1[s]), int(h2[s]))
            if now != key:
                if key is not None:
                    if first:
                        yield summary()
                        yield from flush(OPEN)
                    waiting.clear()
                    first = False
                key, ids = now, []
            d, r, p = doc[s:e], row[s:e], pos[s:e]
            for x in d[np.r_[True, d[1:] != d[:-1]]]:
                if len(ids) < min_docs and (not ids or ids[-1] != x):
                    ids.append(int(x))
            if first:
                yield out(OPEN, *key, d, r, p)
            elif len(ids) >= min_docs:
                yield from flush(DROP)
                if (m := d != ids[0]).any():
                    yield out(DROP, *key, d[m], r[m], p[m])
            elif (m := d != ids[0]).any():
                waiting.append((d[m], r[m], p[m]))
    if key is not None:
        yield summary()
        if not first:
            yield from flush(OPEN)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text, ...) -> (doc, row, n_dropped, bitmap) for every document row that loses a line.

    ``bitmap`` is zlib over the packed bits of the document's lines up to the last dropped one, 1 = keep; later lines stay.
    """
    spark = docs.sparkSession
    hashes = common.scratch(line_hashes(docs.select("doc_id", "text"), min_chars), "line-hashes")  # sampled for the ranges, then sorted
    by = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("row"), F.col("pos")]
    ordered = hashes.repartitionByRange(common.shuffle_width(spark), *by).sortWithinPartitions(*by)
    decided = common.scratch(
        ordered.mapInArrow(lambda b: decide(b, min_docs), "kind byte, h1 long, h2 long, doc long, row long, pos int"), "line-decisions"
    )
    # at most two edge runs a partition leave summaries of min_docs rows: bounded by the shuffle width
    held = decided.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.count_distinct("doc").alias("n"))
    held = held.where(F.col("n") >= min_docs)
    late = decided.where(F.col("kind") == OPEN).join(F.broadcast(held), ["h1", "h2"]).where("doc <> keeper")
    dropped = decided.where(F.col("kind") == DROP).select("doc", "row", "pos").union(late.select("doc", "row", "pos"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, counts = [], []
            for found in batch.column("at").to_pylist():
                at = np.unique(np.asarray(found, np.int64))
                keep = np.ones((int(at[-1]) // 8 + 1) * 8, np.uint8)  # whole bytes: no zero padding
                keep[at] = 0
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
                counts.append(len(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "row", "n_dropped", "bitmap"]
            )

    lists = dropped.groupBy("doc", "row").agg(F.collect_list("pos").alias("at"))  # positions of one document
    return lists.mapInArrow(packed, "doc long, row long, n_dropped long, bitmap binary")


def apply_bitmap(text: str | None, bitmap: bytes | None) -> tuple[str, int, int]:
    """(kept text, lines before, lines dropped)."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    drop = np.flatnonzero(bits == 0)
    keep = np.ones(len(lines), bool)
    keep[drop] = False
    return "\n".join(x for x, k in zip(lines, keep, strict=True) if k), len(lines), len(drop)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs plus the column ``bitmap`` (null: all lines stay); bitmaps are far smaller than the texts and are the hashed side."""
    doc, row = common.unique_name(docs.columns, "_doc"), common.unique_name(docs.columns, "_row")
    name = common.unique_name(docs.columns, "bitmap")
    side = bitmaps.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("bitmap").alias(name)).hint("shuffle_hash")
    keyed = docs.withColumn(doc, F.coalesce("doc_id", F.lit(LOWEST)).cast("long")).withColumn(row, F.xxhash64("text"))
    return keyed.join(side, [doc, row], "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{name}`"))


def deduplicated(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with its repeated lines removed from ``text``, all columns kept; n_chars, if there, is counted anew.

    Texts without dropped lines stay as they are (null stays null).
    """
    marked = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    mark = next(c for c in marked.columns if c not in docs.columns)
    columns = docs.columns
    text_at = columns.index("text")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE):
                maps = batch.column(mark)
                texts = batch.column("text").to_pylist()
                if maps.null_count < len(maps):
                    texts = [t if m is None else apply_bitmap(t, m)[0] for t, m in zip(texts, maps.to_pylist(), strict=True)]
                arrays = list(batch.columns[: len(columns)])
                arrays[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    out = marked.mapInArrow(rebuilt, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def digests(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) a document row."""
    import hashlib

    docs = common.add_id_check(docs, ["doc_id", "text"])
    marked = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE):
                rows = [apply_bitmap(t, m) for t, m in zip(batch.column("text").to_pylist(), batch.column("bitmap").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(r[0].encode("utf-8", "surrogatepass")).hexdigest() for r in rows], pa.string()),
                    ],
                    names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
                )

    return marked.mapInArrow(digested, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
