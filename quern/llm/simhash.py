"""SimHash near-deduplication with multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, components, durable, join_groups, texts_of

SEED = 42
#: Fingerprints that share a segment: more than this, and the bucket takes the exact way for crowded ones.
BUCKET = 64
#: Shingle hashes that a Python worker holds at once, unless one document has more.
HELD = 400_000


def _majority(h: list[int], sizes: list[int]) -> np.ndarray:
    """For each run of sizes in h, the bits that over half of its hashes set; runs may be empty."""
    out = np.zeros(len(sizes), np.uint64)
    n = np.array(sizes, np.int64)
    full = n > 0
    if not full.any():
        return out
    a, at, half, got = np.array(h, np.uint64), np.concatenate([[0], np.cumsum(n[full])[:-1]]), n[full], np.zeros(int(full.sum()), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((a >> np.uint64(bit)) & np.uint64(1), at).astype(np.int64)
        got |= (2 * ones > half).astype(np.uint64) << np.uint64(bit)
    out[full] = got
    return out


def shingles(text: bytes, k: int) -> Iterator[bytes]:
    """k-word shingles, space-joined, repeats included; of fewer words, the whole sequence; of none, nothing."""
    words = text.translate(LOWER).split()
    if not words:
        return
    line, end, ends = b" ".join(words), -1, []
    for w in words:
        end += len(w) + 1
        ends.append(end)
    if len(words) <= k:
        yield line
        return
    start = 0
    for i in range(k - 1, len(words)):
        yield line[start : ends[i]]
        start = ends[i - k + 1] + 1


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text as a signed long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            parts, h, sizes = [], [], []
            for t in texts_of(b.column(1)):
                before = len(h)
                h += [digest(s, SEED) for s in shingles(t, k)]
                sizes.append(len(h) - before)
                if len(h) >= HELD:
                    parts.append(_majority(h, sizes))
                    h, sizes = [], []
            parts.append(_majority(h, sizes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts).view(np.int64))], ["doc_id", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


def _half(segment: str, fp: str) -> str:
    return f"IF({segment} = 0, shiftrightunsigned({fp}, 32), {fp} & 4294967295L)"


def neighbours(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) and stars (centre, fp): of the distinct fingerprints fps (fp), any two that differ in 2 bits or fewer are a pair or share a star.

    Multi-index hashing with two segments of 32 bits: one of them differs in one bit at most, so every
    fingerprint looks up the 33 values of the ball around each of its segments in that segment's table, and
    the complete distance is verified. A bucket of over BUCKET fingerprints isn't paired up: whoever touches
    one gives the 65 centres of its ball of radius 1 instead. Fingerprints at distance 2 or less share a
    centre, and a centre has 65 neighbours at most.
    """
    table = durable(fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg")).select("seg", F.expr(_half("seg", "fp")).alias("val"), "fp"))
    crowded = durable(table.groupBy("seg", "val").count().where(F.col("count") > BUCKET).select("seg", "val"))
    probe = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("i")).select(
        "fp", F.expr("CAST(i >= 33 AS INT)").alias("seg"), F.expr(f"{_half('CAST(i >= 33 AS INT)', 'fp')} ^ IF(i % 33 = 0, 0L, shiftleft(1L, i % 33 - 1))").alias("val")
    )
    index = table.join(crowded.hint("merge"), ["seg", "val"], "left_anti").select("seg", "val", F.col("fp").alias("other"))
    index = index.unionByName(crowded.withColumn("other", F.lit(None).cast("long")))
    # Spark takes the probes' size to be that of the fingerprints, a 66th, and would broadcast them
    met = durable(probe.hint("merge").join(index, ["seg", "val"]).where("other IS NULL OR (fp < other AND bit_count(fp ^ other) <= 2)").select("fp", "other"))
    near = met.where("other IS NOT NULL").select(F.col("fp").alias("u"), F.col("other").alias("v"))
    centres = met.where("other IS NULL").select("fp").distinct().select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    return near, centres.select(F.expr("fp ^ IF(i = 0, 0L, shiftleft(1L, i - 1))").alias("centre"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all of the distinct fingerprints fps (fp) which differ in 2 bits or fewer: neighbours(), whose stars connect them exactly."""
    near, stars = neighbours(fps)
    stars = stars.groupBy("centre").agg(F.collect_set("fp").alias("all"))
    stars = stars.where(F.size("all") > 1).select(F.explode("all").alias("u"), F.array_min("all").alias("v")).where("u <> v")
    return near.unionByName(stars).distinct()


def near_groups(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at 2 or fewer differing bits link; component_id is the smallest doc_id reachable, itself
    included. Null and empty texts have fingerprint zero and link like any other. Null ids never are the smallest; a
    component of null ids only has a null component_id. Repeated rows get equal results. Other columns are ignored; an empty
    table gives no rows. Copies share a fingerprint and are one node: neither buckets nor edges grow with them.
    Tables that grow with the corpus meet by merges, as their files' sizes tell little of the memory that they would take as broadcasts.
    """
    found = durable(fingerprints(docs, k, id_col, text_col))
    total = found.count()
    nodes = durable(found.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = durable(named)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    named = durable(join_groups(named, least.hint("merge"), "root", "members", nodes.count()).select("fp", "component_id", "copies"))
    out = join_groups(found, named.hint("merge"), "fp", "copies", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
