"""Quality filter: the byte-level network of ``byte_net`` trained on labelled documents and applied to every whole text.

Training reads labels of documents outside the held-out fold (crc32 of the id's text mod 4 is 2) and takes at most ``per_class``
documents of each class in hash order, each with all chunks of its whole text: the number of labelled rows is the one bound of the
fitting sample. The texts of these rows come to the driver as bytes; of a repeated id only the smallest text is taken. The class shares are counted over all training labels. Scoring sees every byte
of every text and no label, language, source or id.

Defined cases: null and empty texts are scored as one empty chunk. Without labels, or with one class only, the score is a
constant. Repeated labels of a document: the lowest quality counts. A null doc_id is never trained on and not held out. An empty
table gives an empty result. Extra columns are unread or pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_net, common

PER_CLASS, THRESHOLD, SLICE = 1200, 0.7, 4 << 20


def held_out(doc_id):
    """True in the fold that training never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict[str, np.ndarray]:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    share = known.agg(F.avg("quality")).first()[0]
    order = F.xxhash64("doc_id", F.lit("quality-sample"))
    ids = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class) for q in (0, 1)]
    sample = ids[0].union(ids[1]).withColumnsRenamed({"doc_id": "_id", "quality": "_quality"})  # at most 2 x per_class rows

    met = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    rows = met.groupBy("doc_id", "_quality").agg(F.min("text").alias("text")).orderBy("doc_id").collect()  # a row an id
    parts = [byte_net.chunks(r["text"]) for r in rows]
    epochs = min(100, max(20, math.ceil(48_000 / max(1, len(parts)))))  # enough steps for small samples
    return byte_net.train(parts, np.array([r["_quality"] for r in rows]), share=min(0.99, max(0.01, share or 0.5)), epochs=epochs)


def scored(docs: DataFrame, net: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, score)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(byte_net.scores(net, batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"]
                )

    return common.add_id_check(docs, ["doc_id", "text"]).mapInArrow(score, "doc_id long, score double")


def kept(docs: DataFrame, net: dict[str, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns unchanged."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE):
                yield batch.filter(pa.array(byte_net.scores(net, batch.column("text").to_pylist()) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
