"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent-semantic space of text shape."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of

#: Labelled rows that the model holds at most (the documented bound of the sample), its dimensions, and neighbours that vote.
SAMPLE, DIMENSIONS, NEIGHBOURS = 4096, 48, 15
#: Votes weigh as cosine to this power.
SHARPNESS = 16
#: Documents whose products with the labelled vectors are made at once.
BLOCK = 512


def _byte_kinds() -> tuple[np.ndarray, int]:
    """Kinds of bytes: small and capital letters (also of two-byte letters), digits, spaces, line ends, each ASCII sign."""
    number: dict = {}
    out = np.zeros(256, np.int64)
    for b in range(256):
        if 97 <= b <= 122 or 0xA0 <= b < 0xC0:
            kind = "small"
        elif 65 <= b <= 90 or 0x80 <= b < 0xA0:
            kind = "capital"
        elif b >= 0xC0:
            kind = "lead"
        elif 48 <= b <= 57:
            kind = "digit"
        elif b in b"\t\v\f\r ":
            kind = "space"
        elif b < 32 or b == 127:
            kind = "line" if b == 10 else "control"
        else:
            kind = b
        out[b] = number.setdefault(kind, len(number))
    return out, len(number)


KIND, KINDS = _byte_kinds()
#: Terms: pairs of neighbouring bytes' kinds, then words equal to the one before, words seen before, and distinct words.
TERMS = KINDS * KINDS + 3


def terms(text: bytes) -> np.ndarray:
    """Square roots of the terms' shares, over the whole text; zeros for an empty one."""
    out = np.zeros(TERMS, np.float32)
    x = KIND[np.frombuffer(text, np.uint8)]
    if len(x) > 1:
        out[:-3] = np.bincount(x[:-1] * KINDS + x[1:], minlength=KINDS * KINDS) / len(x)
    if words := text.split():
        distinct = len(set(words))
        out[-3:] = np.array([sum(map(eq, words, words[1:])), len(words) - distinct, distinct]) / len(words)
    return np.sqrt(out)


class Model:
    """Labelled rows' vectors in the space of the largest right singular vectors of their weighted terms."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        n = len(rows)
        self.labels, self.prior = labels.astype(np.float32), float(labels.mean()) if n else 0.5
        df = (rows > 0).sum(0)
        self.weight = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0).astype(np.float32)
        z = rows * self.weight
        self.axes = np.linalg.eigh((z.T @ z).astype(np.float64))[1][:, ::-1][:, :DIMENSIONS].astype(np.float32) if n else np.zeros((TERMS, 1), np.float32)
        self.vectors = self.project(rows)

    def project(self, rows: np.ndarray) -> np.ndarray:
        q = (rows * self.weight) @ self.axes
        return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Between 0 and 1; the labels' mean where no neighbour is alike, as for empty texts."""
        out = [np.zeros(0)]
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), BLOCK):
            block = self.project(np.stack([terms(t) for t in texts[i : i + BLOCK]]))
            if not k:
                out.append(np.full(len(block), self.prior))
                continue
            cosine = block @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
            total = vote.sum(1)
            out.append(np.where(total > 1e-9, (vote * self.labels[near]).sum(1) / np.maximum(total, 1e-9), self.prior))
        return np.clip(np.concatenate(out), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Broadcast:
    """The model of at most sample labelled documents, those with the least hashes of their ids, broadcast.

    may_learn is a condition on the column doc_id. Labels over a half on average of a document count as 1; null labels and ids are
    passed over. The vectors broadcast are sample x DIMENSIONS numbers at most, whatever the data.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("double").alias("y")).where(may_learn).where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("doc_id").agg((F.avg("y") > 0.5).cast("int").alias("y"))
    there = docs.select(F.col(id_col).alias("doc_id"))
    known = known.join(there, "doc_id", "left_semi")
    n = known.count()
    if n > sample:
        # the least hashes lie below this, so that each task sorts and sends few
        known = known.where(F.xxhash64("doc_id") < F.lit(min(2**63 - 1, int(-(2**63) + 2**64 * (1.1 * sample / n)))))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in b.column(0).to_pylist()]), b.column(1), pa.array([terms(t).tobytes() for t in texts_of(b.column(2))], pa.binary())], ["doc_id", "y", "terms"])

    # of repeated ids, the row with the greatest terms
    found = {r.doc_id: r for r in sorted(rows.mapInArrow(run, "doc_id string, y int, terms binary").collect(), key=lambda r: bytes(r.terms))}
    order = sorted(found)
    x = np.stack([np.frombuffer(found[d].terms, np.float32) for d in order]) if order else np.zeros((0, TERMS), np.float32)
    return docs.sparkSession.sparkContext.broadcast(Model(x, np.array([found[d].y for d in order], np.float64)))


def score(docs: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs: 0 to 1, higher if label 1 is likelier.

    Null texts are empty; empty texts and those unlike all labelled ones get the labels' mean. Scores depend on the text alone, so that
    repeated rows have equal scores. Other columns are ignored. An empty table gives no rows; without labels every score is 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.scores(texts_of(b.column(1))), pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Broadcast, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores threshold or more."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.value.scores(texts_of(b.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
