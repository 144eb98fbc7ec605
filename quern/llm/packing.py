"""Mixture-controlled packing of token ids into sequences."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, swept, texts_of
from .wordbpe import WORDS, word_encoder

#: Sources with a queue of their own; of more sources, several share a queue by hash.
QUEUES = 256
#: Tokens that a block gets, about; a block is the unit that one call packs.
BLOCK = 1 << 18
#: Tokens that a queue owes at least when it is served, so that documents aren't cut into crumbs.
QUANTUM = 16
#: Blocks take whole multiples of so many tokens from a source, but for its last ones.
GRAIN = 64
#: Bytes of earlier partitions' sums that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST = 16 << 20


def _runs(column, rows: int = 256, most: int = 2 << 20) -> Iterator[list[bytes]]:
    """A column's texts in runs of about most bytes, few at a time."""
    run, n = [], 0
    for i in range(0, len(column), rows):
        for t in texts_of(column.slice(i, rows)):
            run.append(t)
            n += len(t)
            if n >= most:
                yield run
                run, n = [], 0
    if run:
        yield run


def _one(values, kind: pa.DataType) -> pa.Array:
    return pa.array([list(values)], pa.list_(kind))


def source_queues(docs: DataFrame, source_col: str) -> tuple[list[str | None], dict[str | None, int], int]:
    """Sources in order, null first, their queues (empty if several sources share one by hash), and the number of queues."""
    names = [r[0] for r in docs.select(F.col(source_col).cast("string").alias("s")).distinct().limit(QUEUES + 1).collect()]
    names = sorted(names, key=lambda s: (s is not None, s or ""))
    number = {s: i for i, s in enumerate(names)} if len(names) <= QUEUES else {}
    return names, number, len(number) or QUEUES


def token_chunks(docs: DataFrame, tokenizer: str, end_id: int, as_text: bool, number: dict, n_queues: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Chunks of documents' ids in input order.

    Columns: part (the task that made it), chunk (its number there), doc_ids, starts, lengths, totals, queues (one
    entry for each piece of a document), before (tokens of each queue in the part's earlier chunks), ids.
    """
    id_kind, most, words = docs.schema[id_col].dataType.simpleString(), BLOCK, WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, chunk, before = word_encoder(tokenizer, as_text, words), TaskContext.get().partitionId(), 0, np.zeros(n_queues, np.int64)
        held, size, arrow_id, width = [], 0, None, encoder.width
        last = encoder.packed([end_id])

        def emit() -> pa.RecordBatch:
            nonlocal held, size, chunk, before
            doc_ids, starts, lengths, totals, queues, parts = zip(*held)
            columns = [pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), _one(doc_ids, arrow_id), _one(starts, pa.int64()), _one(lengths, pa.int64()), _one(totals, pa.int64()), _one(queues, pa.int32()), _one(before, pa.int64()), pa.array([b"".join(parts)], pa.binary())]
            before = before + np.bincount(queues, weights=lengths, minlength=n_queues).astype(np.int64)
            held, size, chunk = [], 0, chunk + 1
            return pa.RecordBatch.from_arrays(columns, ["part", "chunk", "doc_ids", "starts", "lengths", "totals", "queues", "before", "ids"])

        for b in batches:
            arrow_id = b.column(0).type
            ids = iter(b.column(0).to_pylist())
            sources = iter(b.column(2).to_pylist())
            for texts in _runs(b.column(1)):
                for got in encoder.encode(texts):
                    doc, source = next(ids), next(sources)
                    queue = number[source] if number else zlib.crc32(("" if source is None else "." + source).encode()) % n_queues
                    got += last
                    total, at = len(got) // width, 0
                    while at < total:
                        n = min(total - at, most - size)
                        held.append((doc, at, n, total, queue, got[width * at : width * (at + n)]))
                        size += n
                        at += n
                        if size == most:
                            yield emit()
        if held:
            yield emit()

    shape = f"part int, chunk long, doc_ids array<{id_kind}>, starts array<long>, lengths array<long>, totals array<long>, queues array<int>, before array<long>, ids binary"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source")).mapInArrow(run, shape)


class Deal:
    """Which block gets which tokens of a queue: every block the target proportions, as long as queues last.

    Tokens are placed on a line; up to each place, a queue has given its share of them. When a queue is used up, the others share
    its part in proportion; queues without a share come last. Block k is the line from k * block on.
    """

    def __init__(self, totals: np.ndarray, target: np.ndarray, block: int, grain: int):
        self.totals, self.block, self.grain = totals.astype(np.int64), block, grain
        self.blocks = max(1, -(-int(totals.sum()) // block))
        left, places, given = totals.astype(float), [0.0], [np.zeros(len(totals))]
        while (left > 0.5).any():
            rate = np.where(left > 0.5, target, 0.0)
            rate = np.where(left > 0.5, left, 0.0) if rate.sum() <= 0 else rate
            rate = rate / rate.sum()
            lasts = np.where(rate > 0, left / np.maximum(rate, 1e-300), np.inf)
            step = lasts.min()
            left = np.where(lasts <= step * (1 + 1e-12), 0.0, left - rate * step)
            places.append(places[-1] + step)
            given.append(totals - left)
        self.places, self.given = np.array(places), np.array(given)

    def line(self, queue: int, block: int) -> float:
        """Tokens of a queue on the line before a block."""
        return float(np.interp(block * self.block, self.places, self.given[:, queue]))

    def cut(self, queue: int, block: int) -> int:
        """Tokens of a queue that the blocks before this one get."""
        total = int(self.totals[queue])
        return total if block >= self.blocks else min(total, int(self.line(queue, block) / self.grain) * self.grain)

    def of(self, queue: int, at: int) -> int:
        """The block that gets the queue's token number at."""
        k = int(np.interp(at, self.given[:, queue], self.places)) // self.block if len(self.places) > 1 else 0
        k = min(max(k, 0), self.blocks - 1)
        while k and self.cut(queue, k) > at:
            k -= 1
        while k < self.blocks - 1 and self.cut(queue, k + 1) <= at:
            k += 1
        return k

    def owed(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The target shares in a block, and what earlier blocks owe each queue."""
        queues = range(len(self.totals))
        start = np.array([self.line(q, block) for q in queues])
        share = np.array([self.line(q, block + 1) for q in queues]) - start
        return share / max(share.sum(), 1e-300), start - np.array([self.cut(q, block) for q in queues])


def dealt(chunks: DataFrame, deal: Deal, id_kind: str) -> DataFrame:
    """Rows of (block, part, chunk, doc_ids, starts, lengths, totals, queues, ids): each chunk's pieces by the block that gets them.

    chunks also have earlier: (queue, n) of all earlier parts. Pieces are cut where blocks meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                blob, place = row["ids"], list(row["before"])
                width = len(blob) // max(1, sum(row["lengths"]))
                for x in row["earlier"]:
                    place[x["queue"]] += x["n"]
                until: dict[int, tuple[int, int]] = {}  # by queue: the block at hand, and where it ends
                by_block: dict[int, list[tuple]] = {}
                base = 0
                for doc, start, n, total, q in zip(row["doc_ids"], row["starts"], row["lengths"], row["totals"], row["queues"]):
                    at = place[q]
                    place[q] = end = at + n
                    while at < end:
                        k, stop = until.get(q, (0, -1))
                        if at >= stop:
                            k = deal.of(q, at)
                            until[q] = k, (stop := deal.cut(q, k + 1))
                        take = min(end, stop) - at
                        by_block.setdefault(k, []).append((doc, start, take, total, q, blob[width * base : width * (base + take)]))
                        at, start, base = at + take, start + take, base + take
                names = ["doc_ids", "starts", "lengths", "totals", "queues"]
                kinds = [b.schema.field(c).type.value_type for c in names]
                for k, pieces in by_block.items():
                    columns = list(zip(*pieces))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int64()), pa.array([row["part"]], pa.int32()), pa.array([row["chunk"]], pa.int64()), *(_one(c, kind) for c, kind in zip(columns, kinds)), pa.array([b"".join(columns[5])], pa.binary())],
                        ["block", "part", "chunk", *names, "ids"],
                    )

    shape = f"block long, part int, chunk long, doc_ids array<{id_kind}>, starts array<long>, lengths array<long>, totals array<long>, queues array<int>, ids binary"
    return chunks.mapInArrow(run, shape)


def plan_block(lengths: list[int], queues: list[int], share: np.ndarray, deficit: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Deficit round-robin over a block's pieces: (sequence, offset, piece, from, length), every token once.

    Each window adds its length times a queue's share to the queue's deficit; queues that owe at least QUANTUM are
    served in turn, up to what they owe, and what room remains goes to the queues that owe most. deficit carries over
    from window to window. After the last full window, the rest fills windows of descending powers of two.
    """
    waiting: dict[int, deque] = {}
    left: dict[int, int] = {}
    for piece, (n, q) in enumerate(zip(lengths, queues)):
        waiting.setdefault(q, deque()).append([piece, 0, n])
        left[q] = left.get(q, 0) + n
    rest = sum(lengths)
    sizes = [window] * (rest // window) + [1 << b for b in range(window.bit_length(), -1, -1) if (rest % window) >> b & 1]
    ring, owed = sorted(waiting), {q: float(deficit[q]) for q in waiting}
    turn = 0
    for sequence, size in enumerate(sizes):
        offset = 0

        def serve(q: int, most: int) -> Iterator[tuple[int, int, int, int, int]]:
            nonlocal offset
            owed[q] -= most
            left[q] -= most
            while most:
                piece, at, n = head = waiting[q][0]
                take = min(most, n - at)
                yield sequence, offset, piece, at, take
                offset += take
                most -= take
                head[1] += take
                if head[1] == n:
                    waiting[q].popleft()

        for q in ring:
            owed[q] += share[q] * size
        for q in ring[turn:] + ring[:turn]:
            if left[q] and owed[q] >= QUANTUM and offset < size:
                yield from serve(q, min(int(owed[q]), left[q], size - offset))
        while offset < size:
            q = max((q for q in ring if left[q]), key=lambda q: (owed[q], -q))
            yield from serve(q, min(max(QUANTUM, int(owed[q])), left[q], size - offset))
        turn = (turn + 1) % len(ring)


def _packed(block: int, rows: list[dict], deal: Deal, window: int, per_block: int, id_type: pa.DataType) -> pa.RecordBatch:
    """The pieces of one block in sequences."""
    column = {c: [x for r in rows for x in r[c]] for c in ("doc_ids", "starts", "lengths", "totals", "queues")}
    blob = b"".join(r["ids"] for r in rows)
    ids = np.frombuffer(blob, f"<u{len(blob) // sum(column['lengths'])}").astype("<u4")
    plan = np.array(list(plan_block(column["lengths"], column["queues"], *deal.owed(block), window)), np.int64)
    sequence, offset, piece, at, n = plan.T
    base = np.cumsum(column["lengths"]) - column["lengths"]
    first, ends = (base[piece] + at).tolist(), np.cumsum(n)
    flat = np.concatenate([ids[a : a + k] for a, k in zip(first, n.tolist())])
    bounds = pa.array(np.concatenate([[0], 4 * ends]).astype(np.int32))
    blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, bounds.buffers()[1], pa.py_buffer(flat.tobytes())])
    docs = pa.array(column["doc_ids"], id_type).take(pa.array(piece))
    columns = [docs, pa.array(np.array(column["starts"])[piece] + at), pa.array(n), pa.array(np.array(column["totals"])[piece]), pa.array(block * per_block + sequence), pa.array(offset), blobs]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, mixture: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", as_text: bool = False) -> DataFrame:
    """Pieces of documents in sequences of window tokens: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    A document is its text's ids, then end_id; ids holds the piece's, four bytes each, little-endian. Every id lies in
    exactly one piece. Strings of special tokens in a text are these tokens, as the tokenizer's plain call has it, or ordinary text if as_text.
    mixture gives target proportions of tokens by source; by default those of all of docs, which last to the end. Blocks get each
    source's share of tokens wherever in the input these are (Deal), and a window takes from the queues what they
    owe against the target; debts carry over windows, and over blocks and partitions by sums over the earlier ones, so that no
    task waits. As no token is dropped or repeated, a queue that runs dry leaves its share to the others. What
    doesn't fill a window at a block's end goes to sequences of powers of two, which need no padding. Null texts
    are empty and give one piece of end_id; null sources are one source of their own; null and repeated ids
    are packed row by row. Other columns are ignored. An empty table gives no rows.
    """
    names, number, n_queues = source_queues(docs, source_col)
    if mixture and not number:
        raise ValueError(f"a mixture needs at most {QUEUES} sources")
    swept(docs.sparkSession)
    chunks = durable(token_chunks(docs, tokenizer, end_id, as_text, number, n_queues, id_col, text_col, source_col))
    sums = durable(chunks.select("part", F.explode(F.arrays_zip("queues", "lengths")).alias("x")).groupBy("part", F.col("x.queues").alias("queue")).agg(F.sum("x.lengths").alias("n")))
    total = {r.queue: r.n for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    totals = np.array([total.get(q, 0) for q in range(n_queues)], np.int64)
    target = np.array([mixture.get(s, 0.0) for s in names], float) if mixture else totals.astype(float)
    deal = Deal(totals, target, BLOCK, GRAIN)
    w = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("part").distinct()
    cells = parts.withColumn("queue", F.explode(F.sequence(F.lit(0), F.lit(n_queues - 1)))).join(sums, ["part", "queue"], "left")
    earlier = cells.withColumn("n", F.coalesce(F.sum("n").over(w), F.lit(0))).groupBy("part").agg(F.collect_list(F.struct("queue", "n")).alias("earlier"))
    if parts.count() * n_queues * 16 <= BROADCAST:
        earlier = F.broadcast(earlier)
    id_kind = docs.schema[id_col].dataType.simpleString()
    per_block = (BLOCK + (GRAIN + 1) * n_queues) // window + window.bit_length() + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        id_type = None
        for b in batches:
            id_type = b.schema.field("doc_ids").type.value_type
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                if held and held[0]["block"] != row["block"]:
                    yield _packed(held[0]["block"], held, deal, window, per_block, id_type)
                    held = []
                held.append(row)
        if held:
            yield _packed(held[0]["block"], held, deal, window, per_block, id_type)

    swept(docs.sparkSession)
    moved = dealt(chunks.join(earlier, "part"), deal, id_kind).repartition("block").sortWithinPartitions("block", "part", "chunk")
    return moved.mapInArrow(run, f"doc_id {id_kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
