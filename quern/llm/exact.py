"""Exact deduplication by two passes over a Bloom filter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, durable, join_groups, texts_of

#: Bits of the broadcast filter, at most: 32 MB. Beyond about 20 million rows it fills up, and more rows than
#: the repeated ones go on to the shuffle (digests and ids only); results are exact at any fill.
MOST_BITS = 1 << 28
#: Hashes that one segment of the filter should get, and segments at most.
SEGMENT_ROWS, MOST_SEGMENTS = 1 << 18, 1 << 14


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_sha256): SHA-256 of the whole text, A-Z lower-cased; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hexes = [hashlib.sha256(t.translate(LOWER)).hexdigest() for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hexes, pa.string())], ["doc_id", "text_sha256"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, text_sha256 string")


def _hashes(column) -> np.ndarray:
    return np.array([int(x[:16], 16) for x in column.to_pylist()], dtype=np.uint64)


def _cells(h: np.ndarray, segments: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment and the two bits in it of each hash."""
    return (h & np.uint64(segments - 1)).astype(np.int64), ((h >> np.uint64(14)) & np.uint64(bits - 1)).astype(np.uint32), ((h >> np.uint64(38)) & np.uint64(bits - 1)).astype(np.uint32)


def repeated_filter(found: DataFrame, total: int) -> tuple[np.ndarray, int, int]:
    """Pass one: bits that two or more rows set, as (segments x bytes), with the numbers of segments and bits.

    Each task sends, for each segment, the bits it set once and twice; a segment's task merges these.
    A text's copies within a task cost two entries at most, so that hot texts are no hot keys.
    """
    segments = min(MOST_SEGMENTS, 1 << max(0, (total // SEGMENT_ROWS).bit_length()))
    bits = min(MOST_BITS // segments, 1 << max(10, (16 * total // segments).bit_length()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            h = np.concatenate([h, h[n > 1]])
            seg, x, y = _cells(h, segments, bits)
            order = np.argsort(seg, kind="stable")
            seg, cells = seg[order], np.stack([x, y], 1)[order]
            ids, at = np.unique(seg, return_index=True)
            blobs = [c.tobytes() for c in np.split(cells, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["seg", "cells"])

        held, n = [], 0
        for b in batches:
            held.append(_hashes(b.column(0)))
            n += len(held[-1])
            if n >= 1 << 20:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def merge(table: pa.Table) -> pa.Table:
        count = np.zeros(bits, np.uint8)
        for blob in table.column("cells").to_pylist():
            cells = np.frombuffer(blob, np.uint32)
            np.minimum(count + np.minimum(np.bincount(cells, minlength=bits), 2).astype(np.uint8), 2, out=count)
        return pa.table({"seg": table.column("seg").slice(0, 1), "twice": pa.array([np.packbits(count > 1).tobytes()], pa.binary())})

    rows = found.select("text_sha256").mapInArrow(partial, "seg int, cells binary").groupBy("seg").applyInArrow(merge, "seg int, twice binary").collect()
    out = np.zeros((segments, bits // 8), np.uint8)
    for r in rows:
        out[r.seg] = np.frombuffer(r.twice, np.uint8)
    return out, segments, bits


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest id of a group stays. Null texts count as
    empty, and empty texts are equal. Null ids count in group_size and never are the larger; if all ids of
    a group are null, all its rows are kept. Rows that repeat both id and text are marked alike. Other columns
    are ignored, whatever their names. An empty table gives no rows.

    Pass one builds the filter of bits set twice, pass two tests every digest; rows that fail to set it off pass
    straight through, and only the possibly repeated shuffle.
    """
    found = durable(digests(docs, id_col, text_col))
    total = found.count()
    cells, segments, bits = repeated_filter(found, total)
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for b in batches:
            seg, x, y = _cells(_hashes(b.column(1)), segments, bits)
            hit = np.ones(len(seg), bool)
            for at in (x, y):
                hit &= (twice[seg, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit)], ["doc_id", "text_sha256", "maybe"])

    id_type = found.schema["doc_id"].dataType.simpleString()
    tested = found.mapInArrow(test, f"doc_id {id_type}, text_sha256 string, maybe boolean")
    maybe = durable(tested.where("maybe").select("doc_id", "text_sha256"))
    groups = durable(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    shape = ["doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"]
    single = tested.where("not maybe").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long"))
    return single.select(*shape).unionByName(join_groups(maybe, groups, "text_sha256", "group_size", total).select(*shape))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() doesn't keep; all columns stay. Ids must be unique and not null."""
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti")
