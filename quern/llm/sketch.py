"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: A paragraph here: within a line, up to four words, ended early by a sentence's end. Edits leave the others alone.
PARAGRAPH = re.compile(rb"(?:[^\s.!?]++[ \t\r\f\v]*+){1,4}[.!?]*|[.!?]+")
#: Cells of a fingerprint; a retry has GROWTH times as many at least. Multiples of the three hash functions.
CELLS, GROWTH = 12, 4
#: Documents and bytes of text that a task compares at once.
DOCS_AT_ONCE, BYTES_AT_ONCE = 500, 4 << 20
#: Ranges of ids that documents are dealt to, at most, and documents in one, about.
RANGES, RANGE_DOCS = 4096, 1000

_U = np.uint64


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts."""
    x = x + _U(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def paragraph_digests(text: bytes) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraphs; the n-th copy of one counts as a paragraph of its own."""
    digest = xxhash.xxh64_intdigest
    found = np.array([digest(p) for p in PARAGRAPH.findall(text)], np.uint64)
    values, back, n = np.unique(found, return_inverse=True, return_counts=True)
    if len(values) == len(found):
        return values
    order = np.argsort(back, kind="stable")
    copy = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
    return np.where(copy > 0, _mix(found[order] ^ _mix(copy.astype(np.uint64), 11), 12), found[order])


class Sketches:
    """Sketches side by side, the i-th of sizes[i] cells: counts, sums of keys and of key checks."""

    def __init__(self, sizes: np.ndarray):
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.count, self.keys, self.checks = np.zeros(int(sizes.sum()), np.int64), np.zeros(int(sizes.sum()), _U), np.zeros(int(sizes.sum()), _U)

    def cells(self, owner: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        third = self.sizes[owner] // 3
        return [self.starts[owner] + j * third + (_mix(keys, j) % third.astype(np.uint64)).astype(np.int64) for j in range(3)]

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> list[np.ndarray]:
        by = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        k, c = keys * by.view(_U) if by.flags.c_contiguous else keys * by.astype(_U), _mix(keys, 7) * by.astype(_U)
        at = self.cells(owner, keys)
        for cells in at:
            np.add.at(self.count, cells, by)
            np.add.at(self.keys, cells, k)
            np.add.at(self.checks, cells, c)
        return at

    def less(self, other: Sketches) -> Sketches:
        out = Sketches(self.sizes)
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes out what can be recovered: owners, keys, signs (1: only in the first), and whether each came out empty."""
        got: list[tuple] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            keys = self.keys[look] * sign.astype(_U)
            pure = (np.abs(sign) == 1) & (_mix(keys, 7) * sign.astype(_U) == self.checks[look])
            look, keys, sign = look[pure], keys[pure], sign[pure]
            owner = np.searchsorted(self.ends, look, side="right")
            _, first = np.unique(keys ^ _mix(owner.astype(np.uint64), 13), return_index=True)
            owner, keys, sign = owner[first], keys[first], sign[first]
            got.append((owner, keys, sign))
            look = np.unique(np.concatenate(self.add(owner, keys, -sign))) if len(keys) else look[:0]
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        empty = ~np.logical_or.reduceat(left, self.starts) if len(self.starts) else np.zeros(0, bool)
        owner, keys, sign = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, kind) for i, kind in enumerate((np.int64, _U, np.int64)))
        return owner, keys, sign, empty


def sketch(sets: list[np.ndarray], sizes: np.ndarray) -> Sketches:
    out = Sketches(sizes)
    if sets:
        out.add(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets))
    return out


def fingerprint_strings(sets: list[np.ndarray], made: Sketches) -> list[str]:
    """Number of paragraphs, then for each cell its count, sum of keys and (half of its) sum of checks, in hex."""
    n = len(sets)
    body = np.concatenate([made.count.astype(">u4").view(np.uint8).reshape(n, -1), made.keys.astype(">u8").view(np.uint8).reshape(n, -1), (made.checks >> _U(32)).astype(">u4").view(np.uint8).reshape(n, -1)], axis=1) if n else ()
    return [f"{len(s):08x}" + row.tobytes().hex() for s, row in zip(sets, body)]


def _room(n: np.ndarray) -> np.ndarray:
    return np.maximum(CELLS, -(-n // 3) * 3)


def differences(a: list[np.ndarray], b: list[np.ndarray], base_a: Sketches, base_b: Sketches) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of sets, the keys only in the first and only in the second, from their sketches.

    The sketches subtract and are peeled. Where that fails, both are made anew with GROWTH times as many cells, or
    twice as many as the cells' counts suggest there are differences, up to twice all keys and more; if even that
    fails, the sets are compared.
    """
    out: list = [None] * len(a)
    todo, diff = np.arange(len(a)), base_a.less(base_b)
    sizes = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    while len(todo):
        guess = (np.add.reduceat(diff.count**2, diff.starts) + 2) // 3
        owner, keys, sign, done = diff.peel()
        order = np.argsort(owner, kind="stable")
        owner, keys, sign = owner[order], keys[order], sign[order]
        cuts = np.searchsorted(owner, np.arange(len(todo) + 1))
        for i in np.flatnonzero(done):
            k, s = keys[cuts[i] : cuts[i + 1]], sign[cuts[i] : cuts[i + 1]]
            out[todo[i]] = (k[s > 0], k[s < 0])
        failed = np.flatnonzero(~done)
        most = _room(2 * sizes[todo[failed]] + 30)
        for i in failed[diff.sizes[failed] >= most]:
            x, y = a[todo[i]], b[todo[i]]
            out[todo[i]] = (np.setdiff1d(x, y), np.setdiff1d(y, x))
        again = diff.sizes[failed] < most
        failed, most = failed[again], most[again]
        bigger = np.minimum(most, _room(np.maximum(GROWTH * diff.sizes[failed], 2 * guess[failed])))
        todo = todo[failed]
        if len(todo):
            diff = sketch([a[i] for i in todo], bigger).less(sketch([b[i] for i in todo], bigger))
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], base_a: Sketches, base_b: Sketches) -> list[float]:
    """Shared paragraphs among all of either, by what the sketches tell apart; 1 if both have none."""
    out = []
    for x, y, (only_a, only_b) in zip(a, b, differences(a, b, base_a, base_b)):
        either = len(x) + len(only_b)
        out.append((len(x) - len(only_a)) / either if either else 1.0)
    return out


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, tail, doc_id, text), dealt by range and sorted: each range of ids is followed by a tail row, the first of the next range.

    The last range's tail is the first row of all. Only the ranges' bounds and first ids, RANGES at most, reach the driver.
    """
    from pyspark.ml.feature import Bucketizer

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    low, n = rows.agg(F.min("doc_id"), F.count("*")).first()
    parts = max(1, min(RANGES, n // RANGE_DOCS))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    cuts = sorted(set(rows.where("doc_id IS NOT NULL").select(place.alias("p")).approxQuantile("p", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    ranged = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="place", outputCol="range").transform(rows.withColumn("place", place)) if cuts else rows.withColumn("range", F.lit(0.0))
    ranged = ranged.select(F.col("range").cast("int").alias("range"), "doc_id", "text")
    firsts = sorted((r.range, r.first) for r in ranged.groupBy("range").agg(F.when(F.count("doc_id") == F.count("*"), F.min("doc_id")).alias("first")).collect())
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    before = spark.createDataFrame([(r, first, firsts[i - 1][0]) for i, (r, first) in enumerate(firsts)], f"range int, first {kind}, previous int")
    told = ranged.join(F.broadcast(before), "range")
    both = F.array(F.struct(F.col("range"), F.lit(False).alias("tail")), F.when(F.expr("doc_id <=> first"), F.struct(F.col("previous").alias("range"), F.lit(True).alias("tail"))))
    told = told.select("doc_id", "text", F.explode(F.array_compact(both)).alias("to")).select("to.range", "to.tail", "doc_id", "text")
    return told.repartition("range").sortWithinPartitions("range", "tail", "doc_id", "text")


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars/2) code points replaced by the first as many (or all) of the next
    document's, by ascending id, then text; after the last comes the first. near_edited and near_next are the
    likeness of the document's fingerprint to the edited text's and the next document's. Null texts are empty; an empty
    text has no paragraphs, is like another such (1) and unlike the rest (0). Null ids come first. Repeated rows follow each
    other. Equal texts have equal fingerprints. Other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        id_kind = None

        def compare(held: list[tuple]) -> pa.RecordBatch:
            ids = [x[0] for x in held]
            edited = [(own[: len(own) - len(own) // 2] + after[: len(own) // 2]).encode() for _, own, after in held]
            cache: dict[int, np.ndarray] = {}
            sets = [[cache[id(t)] if id(t) in cache else cache.setdefault(id(t), paragraph_digests(t.encode())) for t in (x[1], x[2])] for x in held]
            own, after, new = [s[0] for s in sets], [s[1] for s in sets], [paragraph_digests(t) for t in edited]
            size = np.full(len(held), CELLS)
            base, base_after, base_new = sketch(own, size), sketch(after, size), sketch(new, size)
            columns = [pa.array(ids, id_kind), pa.array([len(x[1]) for x in held], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array(fingerprint_strings(own, base)), pa.array(fingerprint_strings(new, base_new)), pa.array(likeness(own, new, base, base_new), pa.float64()), pa.array(likeness(own, after, base, base_after), pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names)

        held, size, last = [], 0, None
        for b in batches:
            id_kind = b.column(2).type
            for part, tail, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                text = text or ""
                if last is not None and last[0] == part:
                    held.append((last[1], last[2], text))
                    size += len(text)
                    if len(held) >= DOCS_AT_ONCE or size >= BYTES_AT_ONCE:
                        yield compare(held)
                        held, size = [], 0
                last = None if tail else (part, doc, text)
        if held:
            yield compare(held)

    return in_order_with_next(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
