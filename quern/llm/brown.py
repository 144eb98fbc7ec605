"""LM scoring by a class-based bigram model whose classes come from exchange clustering (Brown et al.)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.scratch import new_path

from .common import LOWER as LOWER

#: Most frequent words that are broadcast, at most; the rarer ones' classes and counts are joined.
KNOWN = 100_000
#: The most frequent words, which the driver deals out to CLASSES (63 at most) one by one, in ROUNDS at most; the next start by their neighbours' classes, the others by their ending.
CLUSTERED, CLASSES, ROUNDS, ASSIGNED = 1200, 48, 12, 20_000
#: Rounds of exchange over all training words, at most.
SWEEPS = 2
#: Bytes of a word's ending; words start in the class that most known words of their ending have, and those that training hasn't stay there.
ENDING = 3
#: Distinct words that a task counts before it passes its counts on.
DISTINCT = 400_000
#: The end token, which no word can be.
END = b"\n"
CHUNKS = 32
#: Tokens and distinct rare words of which a task gathers the places before it passes them on.
BLOCK, BLOCK_WORDS = 2_000_000, 400_000
#: Bytes of texts that are split into words at once, but for longer texts.
TEXT_BYTES = 4 << 20
#: Rare words that move at once.
TOGETHER = 40_000
#: In the type of the sums, as np.add.at converts others one by one.
ONE = np.int32(1)
#: Tokens counted at once.
SLICE = 1_000_000
#: A rare word's place: twice the row, and one more in training; the codes of the words beside it, or -1 for rare ones.
PLACE = np.dtype([("row", "<i8"), ("left", "<i4"), ("right", "<i4")])
#: Instead of a class: the neighbour is the word itself.
ITSELF = 63
#: Weight of the classes' own frequencies in transitions.
PRIOR = 2.0


def _kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """Written to the folder that the cluster shares, smaller than by common's durable."""
    path = path or new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _by_sorting(spark: SparkSession) -> Iterator[None]:
    """Lists are gathered from sorted rows, once, and stay in order for joins; by hash, Spark sorts rows twice where there are over 128 keys and loses the order."""
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _removed(spark: SparkSession, *paths: str) -> None:
    """Takes the room of tables back that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """Of a string column, by about TEXT_BYTES: the first row, how many words it and the next rows have, all their words lower-cased. Null is empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    i = 0
    while i < len(texts):
        end = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TEXT_BYTES, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(i, end - i)))  # byte for byte as bytes.split()
        words = lists.flatten()
        some = pc.not_equal(words, pa.scalar("", words.type))  # there are empty ones where a text begins or ends with white space
        before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
        yield i, np.diff(before[np.asarray(lists.offsets)]), words.filter(some).view(pa.large_binary())
        i = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n): tokens of the whole texts (text), with one end token a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n_held = n_ends = 0

        def merged() -> pa.Table:
            each = pa.concat_arrays([x for t in held for x in t["word"].chunks]).dictionary_encode()  # takes a third of the time of group_by
            n = np.concatenate([np.asarray(t["n"], np.int64) for t in held])
            sums = np.zeros(len(each.dictionary), np.int64)
            np.add.at(sums, np.asarray(each.indices), n)
            return pa.table({"word": each.dictionary, "n": sums})

        def out(tally: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from tally.set_column(0, "word", tally["word"].cast(pa.binary())).to_batches()

        for b in batches:
            for _, sizes, words in _words(b.column(0)):
                found = pc.value_counts(words)
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                n_held, n_ends = n_held + len(found), n_ends + len(sizes)
                if n_held >= 2 * DISTINCT:
                    held = [merged()]
                    n_held = len(held[0])
                    if n_held >= DISTINCT:
                        yield from out(held.pop())
                        n_held = 0
        if n_ends:
            held.append(pa.table({"word": pa.array([END], pa.large_binary()), "n": pa.array([n_ends], pa.int64())}))
            yield from out(merged())

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _blobs(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """data's items as binary values of sizes items each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _flat(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of binary values, and all their bytes; null is empty."""
    blobs = blobs.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(blobs.buffers()[1], "<i8")[blobs.offset : blobs.offset + len(blobs) + 1] if len(blobs) else np.zeros(1, np.int64)
    data = blobs.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return np.diff(offsets), data


def encoded(docs: DataFrame, table: dict[bytes, int]) -> DataFrame:
    """(kind, row, doc_id, train, ids, word, near, places) of three kinds.

    0: a document's token codes as four bytes each: 0 the end, then table's words, then one for all rarer ones.
    1: a rarer word and some of its places. 2: a rarer word, the rarer one before it, and as row twice the row, with one more in training.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sorted(table, key=table.__getitem__))
    kind = docs.schema["doc_id"].dataType
    names = ["kind", "row", "doc_id", "train", "ids", "word", "near", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_binary())
        rare, row = len(known), TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray]] = []  # twice the rows, one more in training; codes, those of rare words as places in local
        local: list[pa.Array] = []
        tokens, n_local, id_type = 0, 0, None

        def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
            types = dict(zip(names, (pa.int32(), pa.int64(), id_type, pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, types[c])) for c in names], names)

        def placed() -> Iterator[pa.RecordBatch]:
            x, of_row = np.concatenate([x for _, x in held]), np.concatenate([r for r, _ in held])
            each = pa.concat_arrays(local).dictionary_encode()  # a word once, though several texts' parts have it
            words = each.dictionary.cast(pa.binary())
            left, right = np.append(np.int32(0), x[:-1]), np.append(x[1:], np.int32(0))
            at, to = np.flatnonzero(x >= rare), np.flatnonzero((x >= rare) & (left >= rare))
            of = np.asarray(each.indices)
            word = of[x[at] - rare]
            order = np.argsort(word, kind="stable")
            at, sizes = at[order], np.bincount(word, minlength=len(words))
            places = np.empty(len(at), PLACE)
            places["row"] = of_row[at]
            places["left"] = np.where(left[at] < rare, left[at], -1)
            places["right"] = np.where(right[at] < rare, right[at], -1)
            for i, m in _steps(sizes, BLOCK_WORDS):
                first = int(sizes[:i].sum())
                yield rows(m, kind=pa.array(np.full(m, 1, np.int32)), word=words.slice(i, m), places=_blobs(places[first : first + int(sizes[i : i + m].sum())], sizes[i : i + m]))
            if len(to):
                yield rows(len(to), kind=pa.array(np.full(len(to), 2, np.int32)), row=pa.array(of_row[to]), word=words.take(pa.array(of[x[to] - rare])), near=words.take(pa.array(of[left[to] - rare])))
            held.clear()
            local.clear()

        for b in batches:
            id_type = b.column(0).type
            train = np.array([bool(t) for t in b.column(2).to_pylist()], np.int64)
            for i, sizes, words in _words(b.column(1)):
                n, each = len(sizes), words.dictionary_encode()
                codes = np.asarray(pc.index_in(each.dictionary, value_set=known).fill_null(rare))
                others = codes == rare
                x = np.zeros(len(words) + n, np.int32)
                is_word = np.ones(len(x), bool)
                is_word[np.cumsum(sizes + 1) - 1] = False
                x[is_word] = np.where(others, rare + n_local + np.cumsum(others) - 1, codes)[np.asarray(each.indices)]
                yield rows(n, kind=pa.array(np.zeros(n, np.int32)), row=pa.array(np.arange(row, row + n)), doc_id=b.column(0).slice(i, n), train=b.column(2).slice(i, n), ids=_blobs(np.minimum(x, rare).astype("<u4"), sizes + 1))
                if others.any():
                    held.append((np.repeat(2 * np.arange(row, row + n) + train[i : i + n], sizes + 1), x))
                    local.append(each.dictionary.filter(pa.array(others)))
                    tokens, n_local = tokens + len(x), n_local + int(others.sum())
                row += n
                if tokens >= BLOCK or n_local >= BLOCK_WORDS:
                    yield from placed()
                    tokens = n_local = 0
        if held:
            yield from placed()

    return docs.select("doc_id", F.col("text").cast("string"), "train").mapInArrow(run, f"kind int, row long, doc_id {kind.simpleString()}, train boolean, ids binary, word binary, near binary, places binary")


def _steps(sizes: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    for i in range(0, len(sizes), step):
        yield i, min(step, len(sizes) - i)


def _packed(sums: np.ndarray) -> bytes:
    """Sums that are 0 for the most part: how many aren't, the steps between their places and they themselves, byte by byte and compressed."""
    at = np.flatnonzero(sums)
    parts = np.diff(at, prepend=0), sums[at]
    planes = b"".join(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in parts)
    return len(at).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unpacked(blob: bytes, size: int) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], 16 * n), np.uint8).reshape(2, 8, n)
    steps, sums = (np.ascontiguousarray(x.T).view("<i8").reshape(-1) for x in planes)
    out = np.zeros(size, np.int64)
    out[np.cumsum(steps)] = sums
    return out


def _chunks(sums: np.ndarray) -> pa.RecordBatch:
    """(chunk, sums): an array of a multiple of CHUNKS cells, by CHUNKS parts."""
    blobs = [_packed(x) for x in sums.reshape(CHUNKS, -1)]
    return pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "sums"])


def _total(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of (chunk, sums) of several tasks, added up by chunks; only the total reaches the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = _unpacked(blob, width)
                total[chunk] = total[chunk] + x if chunk in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(x) for x in total.values()], pa.binary())], ["chunk", "sums"])

    width = -(-size // CHUNKS)
    out = np.zeros((CHUNKS, width), np.int64)
    for r in parts.repartition("chunk").mapInArrow(merge, "chunk int, sums binary").collect():
        out[r.chunk] = _unpacked(r.sums, width)
    return out.reshape(-1)[:size]


def tallied(tokens: DataFrame, size: int, cells: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """How often each cell 0..size-1 occurs, where cells maps codes and the codes before them to cells."""
    width = -(-size // CHUNKS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width * CHUNKS, np.int32)
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4")
            for i in range(0, len(x), SLICE):
                part = x[i : i + SLICE].astype(np.int64)
                np.add.at(sums, cells(part, _previous(part, int(x[i - 1]) if i else 0)), ONE)
        yield _chunks(sums)

    return _total(tokens.select("ids").mapInArrow(partial, "chunk int, sums binary"), size)


def _previous(x: np.ndarray, first: int = 0) -> np.ndarray:
    return np.concatenate([[first], x[:-1]])


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """A class for each of n words, from their n x n bigram counts.

    Exchange clustering: words start dealt out by rank; each in turn moves to the class that raises the
    likelihood of the class bigrams most, until no word moves or the rounds are over.
    """
    n = len(pairs)
    if n <= classes:
        return np.arange(n)
    of = np.arange(n) % classes
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    after, before = pairs @ member, (member.T @ pairs).T  # of each word: to and from each class
    joint = member.T @ after
    left, right = pairs.sum(1).astype(float), pairs.sum(0).astype(float)
    lefts, rights = joint.sum(1), joint.sum(0)
    each = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            k, own = of[w], float(pairs[w, w])
            out, back = after[w].copy(), before[w].copy()
            out[k] -= own
            back[k] -= own  # to and from the other words
            joint[k] -= out
            joint[:, k] -= back
            joint[k, k] -= own
            lefts[k] -= left[w]
            rights[k] -= right[w]
            base = _h(joint)
            gain = (_h(joint + out) - base).sum(1) + (_h(joint + back[:, None]) - base).sum(0)
            # the class's cell with itself gets both, and the word's pairs with itself
            both = joint[each, each]
            gain += _h(both + out + back + own) - _h(both + out) - _h(both + back) + _h(both)
            gain -= _h(lefts + left[w]) - _h(lefts) + _h(rights + right[w]) - _h(rights)
            to = int(np.argmax(gain))
            to = k if gain[to] <= gain[k] + 1e-9 else to
            joint[to] += out
            joint[:, to] += back
            joint[to, to] += own
            lefts[to] += left[w]
            rights[to] += right[w]
            if to != k:
                moved += 1
                of[w] = to
                after[:, k] -= pairs[:, w]
                after[:, to] += pairs[:, w]
                before[:, k] -= pairs[w]
                before[:, to] += pairs[w]
        if not moved:
            break
    return of


def gains(joint: np.ndarray, of: np.ndarray, out: np.ndarray, back: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How much each word (row) raises the likelihood of the class bigrams in each class, over its being in none.

    joint counts the class bigrams, the word's own in class of included; out and back are the word's counts to and
    from the classes of other words, own those with itself. The figures are those of exchange(), for many words.
    """
    each = np.arange(len(of))
    gain = np.zeros(out.shape)
    # most words are rare, so that their counts are few and small: terms are worked out for each count once, but where the word's own are to be taken off
    for sums, n in ((joint.sum(1), out.sum(1) + own), (joint.sum(0), back.sum(1) + own)):
        size, of_size = np.unique(n, return_inverse=True)
        terms = (_h(sums + size[:, None]) - _h(sums))[of_size]
        terms[each, of] = _h(sums[of]) - _h(sums[of] - n)
        gain -= terms
    for mine, other, cells in ((out, back, joint), (back, out, joint.T)):
        w, d = np.nonzero(mine)
        if not len(w):
            continue
        n, k = mine[w, d], of[w]
        size, of_size = np.unique(n, return_inverse=True)
        pair, of_pair = np.unique(of_size * len(joint) + d, return_inverse=True)
        rest = cells.T[pair % len(joint)].astype(float)  # of each count: the cells of all classes with its class
        terms = (_h(rest + size[pair // len(joint)][:, None]) - _h(rest))[of_pair]
        cell = cells[k, d].astype(float)
        terms[np.arange(len(w)), k] = _h(cell) - _h(cell - n)
        same = np.flatnonzero(d == k)  # here all cells have counts of the word
        rest = cells.T[d[same]].astype(float) - other[w[same]]
        rest[np.arange(len(same)), k[same]] -= n[same] + own[w[same]]
        terms[same] = _h(rest + n[same, None]) - _h(rest)
        starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        gain[w[starts]] += np.add.reduceat(terms, starts, axis=0)
    # the class's cell with itself gets both, and the word's pairs with itself; where one is all there is, nothing is to be added
    w, c = np.nonzero((out > 0) & (back > 0) | (own > 0)[:, None])
    both = np.diag(joint).astype(float)[c] - np.where(c == of[w], out[w, c] + back[w, c] + own[w], 0)
    gain[w, c] += _h(both + out[w, c] + back[w, c] + own[w]) - _h(both + out[w, c]) - _h(both + back[w, c]) + _h(both)
    return gain


def _moved(joint: np.ndarray, of: np.ndarray, out: np.ndarray, back: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class of each word after a move to where it gains most; class 0 is the end's alone."""
    new = of.copy()
    for i in range(0, len(of), 2000):
        at = slice(i, i + 2000)
        gain = gains(joint, of[at], out[at].astype(float), back[at].astype(float), own[at].astype(float))
        gain[:, 0] = -np.inf
        to, each = np.argmax(gain, axis=1), np.arange(len(gain))
        new[at] = np.where(gain[each, to] > gain[each, of[at]] + 1e-9, to, of[at])
    return new


def _start(tokens: DataFrame, words: list[bytes]) -> tuple[np.ndarray, int]:
    """A class for the end and the ASSIGNED most frequent words to start with, and the number of classes."""
    train = tokens.where("train")
    n = min(CLUSTERED, len(words)) + 1  # the end takes part with a code of its own

    def close(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        both = (x < n) & (p < n)
        return p[both] * n + x[both]

    pairs = tallied(train, n * n, close).reshape(n, n)
    classes = 1 + min(CLASSES, max(1, n - 1))
    of = np.concatenate([[0], 1 + exchange(pairs[1:, 1:], CLASSES, ROUNDS)])
    m = min(ASSIGNED, len(words)) + 1
    if m > n:
        table = np.concatenate([of, np.full(m - n, -1)])
        top = len(table)

        def beside(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            c = np.where(x < top, table[np.minimum(x, top - 1)], -1)
            before = np.where(p < top, table[np.minimum(p, top - 1)], -1)
            to = (x >= n) & (x < m) & (before >= 0)
            back = (p >= n) & (p < m) & (c >= 0)
            return np.concatenate([x[to] * (2 * classes) + before[to], p[back] * (2 * classes) + classes + c[back]])

        profile = tallied(train, m * 2 * classes, beside).reshape(m, 2, classes)[n:]
        joint = np.zeros((classes, classes))
        np.add.at(joint, (of[:, None].repeat(n, 1), of[None, :].repeat(n, 0)), pairs)
        joint += 0.1
        score = np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))
        fit = profile[:, 0] @ score[:, 1:] + profile[:, 1] @ score[1:].T
        of = np.concatenate([of, 1 + np.argmax(fit, axis=1)])
    return of, classes


def _by_ending(words: list[bytes], counts: np.ndarray, of: np.ndarray, classes: int) -> tuple[dict[bytes, int], int]:
    """The class that most of the words (as often as they occur) of each ending have, and for other endings, that most words have."""
    votes: dict[bytes, np.ndarray] = {}
    total = np.zeros(classes)
    for w, c, k in zip(words, counts, of):
        votes.setdefault(w[-ENDING:], np.zeros(classes, np.int64))[k] += c
        total[k] += c
    total[0] = -1
    return {e: int(np.argmax(v)) for e, v in votes.items()}, int(np.argmax(total))


class Rare:
    """The words past the broadcast ones: their places and neighbours, by hash of the word, for all rounds."""

    def __init__(self, tokens: DataFrame) -> None:
        self.parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.places = tokens.where("kind = 1").select("word", "places").repartition(self.parts, "word").groupBy("word").agg(F.collect_list("places").alias("places")).persist(StorageLevel.DISK_ONLY)
        pairs = tokens.where("kind = 2")
        before = pairs.select("near", "word", F.lit(0).alias("side"), "row")
        after = pairs.where("row % 2 = 1 AND near <> word").select(F.col("word").alias("near"), F.col("near").alias("word"), F.lit(1).alias("side"), "row")
        self.beside = before.unionByName(after).repartition(self.parts, "near").sortWithinPartitions("near").persist(StorageLevel.DISK_ONLY)

    def told(self, classes_of: DataFrame, learn: bool) -> DataFrame:
        """(word, places, k, beside): with their classes, and for rare neighbours 128 times the row's value + 64 if it follows + its class.

        To learn, the neighbours are those in training, and 1 stands for the row's value; else those before the word.
        """
        of = classes_of.repartition(self.parts, "word")
        near = self.beside.where("row % 2 = 1" if learn else "side = 0").join(of.withColumnRenamed("word", "near"), "near")
        row = F.lit(1).cast("long") if learn else F.col("row")
        value = row * 128 + F.col("side") * 64 + F.when(F.col("near") == F.col("word"), ITSELF).otherwise(F.col("k"))
        near = near.select("word", value.alias("v")).repartition(self.parts, "word").groupBy("word").agg(F.collect_list("v").alias("beside"))
        return self.places.join(of, "word").join(near, "word", "left").select("word", "places", "k", "beside")

    def close(self) -> None:
        self.places.unpersist()
        self.beside.unpersist()


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a batch of Rare.told(): k; the word and place of each place; the word, row's value, side and class of each rare neighbour."""
    lists = b.column(1)
    sizes, data = _flat(lists.flatten())
    per_blob = sizes // PLACE.itemsize
    of_blob = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
    beside = b.column(3)
    values = np.asarray(beside.flatten(), np.int64)
    lengths = np.asarray(beside.value_lengths().fill_null(0), np.int64)
    return (np.asarray(b.column(2), np.int64), np.repeat(of_blob, per_blob), data.view(PLACE),
            np.repeat(np.arange(b.num_rows), lengths), values >> 7, values >> 6 & 1, values & 63)


def _profiles(told: DataFrame, of: np.ndarray, classes: int) -> DataFrame:
    """(word, k, n, cells) of every rare word of Rare.told(), and (chunk, sums) of each task.

    cells: for the counts that aren't 0, (which << 40) + count, which being a class before, classes + one after, or 2 classes
    for the word itself. sums: the known words' counts beside rare words in that layout, then the class bigrams that begin with a rare word.
    """
    wide = 2 * classes + 1
    known = len(of)
    size = known * wide + classes * classes
    shared = told.sparkSession.sparkContext.broadcast(of)
    names = ["word", "k", "n", "cells", "chunk", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        sums = np.zeros(-(-size // CHUNKS) * CHUNKS, np.int32)
        for b in batches:
            k, w, place, nw, value, side, near = _read(b)
            m = b.num_rows
            learnt = place["row"] & 1 == 1
            w, left, right = w[learnt], place["left"][learnt], place["right"][learnt]
            after, before = right >= 0, left >= 0
            also = value & 1 == 1
            itself = np.where(near == ITSELF, 2 * classes, near + classes * side)
            cell = np.concatenate([w[before] * wide + of[left[before]], w[after] * wide + classes + of[right[after]], (nw * wide + itself)[also]])
            counts = np.bincount(cell, minlength=m * wide).reshape(m, wide)
            np.add.at(sums, np.concatenate([left[before] * wide + classes + k[w[before]], right[after] * wide + k[w[after]]]), ONE)
            joint = sums[known * wide : size].reshape(classes, classes)
            np.add.at(joint, k, counts[:, classes : 2 * classes].astype(np.int32))
            np.add.at(joint, (k, k), counts[:, -1].astype(np.int32))
            at, which = np.nonzero(counts)
            cells = _blobs((which.astype(np.int64) << 40) + counts[at, which], np.bincount(at, minlength=m))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k), pa.array(np.bincount(w, minlength=m)), cells, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        out = _chunks(sums)
        none = [pa.nulls(CHUNKS, t) for t in (pa.binary(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, *out.columns], names)

    return told.mapInArrow(run, "word binary, k long, n long, cells binary, chunk int, sums binary")


def _exchanged(profiles: DataFrame, joint: np.ndarray) -> DataFrame:
    """(word, k): the rare words' classes after their moves; words that training hasn't stay."""
    classes = len(joint)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def moved() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            k, cells = np.asarray(t["k"], np.int64), t["cells"].combine_chunks().dictionary_encode()
            # words of one class and the same counts, as rare ones often have, move alike
            _, at, same = np.unique(np.asarray(cells.indices, np.int64) * classes + k, return_index=True, return_inverse=True)
            sizes, data = _flat(cells.dictionary.take(cells.indices.take(pa.array(at))))
            values = data.view("<i8")
            counts = np.zeros((len(at), 2 * classes + 1))
            counts[np.repeat(np.arange(len(at)), sizes // 8), values >> 40] = values & (1 << 40) - 1
            new = _moved(joint, k[at], counts[:, classes:-1], counts[:, :classes], counts[:, -1])[same]
            yield from pa.table({"word": t["word"], "k": new}).to_batches()

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(len(x) for x in held) >= TOGETHER:
                yield from moved()
        if held:
            yield from moved()

    return profiles.where("word IS NOT NULL").select("word", "k", "cells").mapInArrow(run, "word binary, k long")


def likelihood(joint: np.ndarray) -> float:
    """What exchange clustering raises: the log likelihood of the class bigrams but for a part that classes don't change."""
    return float(_h(joint).sum() - _h(joint.sum(1)).sum() - _h(joint.sum(0)).sum())


def _learn(tokens: DataFrame, rare: Rare, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, DataFrame, np.ndarray, list[float]]:
    """The classes of the end and the known words; (word, k, n) of all rare words; the class bigrams; each round's likelihood.

    Rounds of exchange over all words, broadcast or not: each moves to the class where it gains most, given the
    classes of the round before. The round of the highest likelihood is the result.
    """
    spark, docs = tokens.sparkSession, tokens.where("kind = 0")
    of, classes = _start(docs, words)
    best_of, other = _by_ending(words[: len(of) - 1], counts, of[1:], classes)
    of = np.concatenate([of, np.array([best_of.get(w[-ENDING:], other) for w in words[len(of) - 1 :]], np.int64)])
    wide = 2 * classes + 1

    def by_ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_of, other = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([best_of.get(w[-ENDING:], other) for w in b.column(0).to_pylist()], pa.int64())], ["word", "k"])

    # worked out here once, over all known words, not in each task
    shared = spark.sparkContext.broadcast(_by_ending(words, counts, of[1:], classes))
    classes_at = new_path(spark)
    classes_of = _kept(rare.places.select("word").mapInArrow(by_ending, "word binary, k long"), classes_at)
    best, best_at, seen = None, [], []
    for sweep in range(SWEEPS + 1):
        now, known = of, len(of)

        def beside(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            both = np.flatnonzero((x < known) & (p < known))  # noqa: B023
            x, p = x[both], p[both]
            own = x == p
            to, x, p = x[own], x[~own], p[~own]
            return np.concatenate([x * wide + now[p], p * wide + classes + now[x], to * wide + 2 * classes])  # noqa: B023

        profiles, profiles_at = _profiles(rare.told(classes_of, True), of, classes), new_path(spark)
        profiles = _kept(profiles if sweep < SWEEPS else profiles.drop("cells"), profiles_at)  # cells are for a next round
        _removed(spark, classes_at)
        found = _total(profiles.where("chunk IS NOT NULL").select("chunk", "sums"), known * wide + classes * classes)
        profile = found[: known * wide].reshape(known, wide)
        profile += tallied(docs.where("train"), known * wide, beside).reshape(known, wide)
        joint = found[known * wide :].reshape(classes, classes).astype(float)
        np.add.at(joint, of, profile[:, classes:-1])
        np.add.at(joint, (of, of), profile[:, -1])
        seen.append(likelihood(joint))
        if best and seen[-1] <= max(seen[:-1]):
            _removed(spark, profiles_at)
            break
        _removed(spark, *best_at)
        best_at = [profiles_at]
        best = of, profiles.where("word IS NOT NULL").select("word", "k", "n"), joint
        if sweep < SWEEPS:
            of = np.concatenate([of[:1], _moved(joint, of[1:], profile[1:, classes:-1], profile[1:, :classes], profile[1:, -1])])
            classes_at = new_path(spark)
            classes_of = _kept(_exchanged(profiles, joint), classes_at)
    return *best, seen


def held_out(id_column: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo parts, is part; a null id is an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % parts == part


def score(docs: DataFrame, is_held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are the words of the text, A-Z lower-cased, and one end. The model learns from all rows for which is_held_out
    (over docs' columns) is false. A token's probability is that of its class after the class before it, times that
    of the word in its class: (c + 0.5) / (N + 0.5 (V + 1)) over the class's words, with c = 0 for words that training hasn't; base_score
    is the same with all words in one class and no transitions. Scores are log10 of the whole text's probability.
    Null texts are empty and have their end only. Without training rows every word is unknown. Repeated rows
    count and score one by one. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (~is_held_out).alias("train"))
    counts_at = new_path(spark)
    counts = _kept(word_counts(rows.where("train")), counts_at)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the words of the highest counts, by a threshold that at most KNOWN words reach: no task sends the driver more than its share of these
    steps = counts.where(F.col("word") != F.lit(END)).groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, so_far = total + 1, 0
    for step in sorted(steps, key=lambda r: -r.step):
        so_far += step.words
        if so_far > KNOWN:
            break
        least = step.least
    top = sorted(counts.where((F.col("word") != F.lit(END)) & (F.col("n") >= least)).collect(), key=lambda r: (-r.n, bytes(r.word)))
    n_ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    _removed(spark, counts_at)
    words, n = [bytes(r.word) for r in top], np.array([r.n for r in top], np.int64)
    table = {w: i + 1 for i, w in enumerate(words)} | {END: 0}
    tokens = _kept(encoded(rows, table))
    with _by_sorting(spark):
        rare = Rare(tokens)
        of, rare_of, joint, _ = _learn(tokens, rare, words, n)
    classes = len(joint)
    in_class = joint.sum(0)
    n_words = len(words) + 1
    # distinct words of each class
    kinds = np.bincount(of, minlength=classes).astype(float)
    for r in rare_of.where("n > 0").groupBy("k").count().collect():
        kinds[r.k] += r["count"]
    share = (in_class + 0.5) / (in_class.sum() + 0.5 * classes)
    move = np.log10((joint + PRIOR * share) / (joint.sum(1, keepdims=True) + PRIOR))
    room = np.log10(in_class + 0.5 * (kinds + 1))
    known_log = np.log10(np.concatenate([[n_ends], n]) + 0.5)
    base_room = float(np.log10(total + 0.5 * (distinct + 1)))
    model = spark.sparkContext.broadcast((of, move, known_log, room, 0 if n_ends else 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, step, known_log, room, first = model.value
        # one code more stands for all rare words, which rare_run scores
        of, known_log, less = np.append(of, len(step)), np.append(known_log, 0.0), np.append(room[of], 0.0)
        step = np.pad(step, (0, 1))
        for b in batches:
            blobs = b.column(2).to_pylist()
            size = np.array([len(x) // 4 for x in blobs], np.int64)
            if not len(size):
                continue
            x = np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)
            starts = np.cumsum(size) - size
            c, own = of[x], known_log[x]
            per = step[_previous(c), c] - less[x]  # every document ends with the end's class, which the next one's first token follows
            add = lambda v: np.add.reduceat(v, starts)
            own_sum, known = add(own), add(((x >= first) & (x < n_words)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(size), pa.array(known), pa.array(own_sum - size * base_room), pa.array(own_sum + add(per))], ["row", "doc_id", "train", "n_tokens", "known", "base", "model"])

    def rare_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, step, _, room, _ = model.value
        for b in batches:
            k, w, place, nw, value, _, near = _read(b)
            own = np.bincount(w, place["row"] & 1, minlength=b.num_rows)  # how often training has the word
            left, right, c = place["left"], place["right"], k[w]
            per = np.where(left >= 0, step[of[left], c], 0) + np.where(right >= 0, step[c, of[right]], 0) - room[c]
            # a bigram of two rare words counts with its second
            near = np.where(near == ITSELF, k[nw], near)
            row, at = np.unique(np.concatenate([place["row"], value]) >> 1, return_inverse=True)
            add = lambda v: np.bincount(at[: len(v)], v, minlength=len(row))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(add(np.log10(own + 0.5)[w])), pa.array(add(np.concatenate([per, step[near, k[nw]]]))), pa.array(add((own > 0)[w]).astype(np.int64))], ["row", "own", "per", "known"])

    with _by_sorting(spark):
        told = rare.told(rare_of.select("word", "k"), False).mapInArrow(rare_run, "row long, own double, per double, known long")
        rare_rows = _kept(told.groupBy("row").agg(F.sum("own").alias("rare_own"), F.sum("per").alias("rare_per"), F.sum("known").alias("rare_known")))
    rare.close()
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = tokens.where("kind = 0").select("row", "doc_id", "ids", "train").mapInArrow(run, f"row long, doc_id {kind}, train boolean, n_tokens long, known long, base double, model double")
    out = scored.join(rare_rows, "row", "left")
    none = F.lit(0.0)
    base, whole = F.col("base") + F.coalesce("rare_own", none), F.col("model") + F.coalesce("rare_own", none) + F.coalesce("rare_per", none)
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), whole.alias("score"), F.pow(F.lit(10.0), -whole / F.col("n_tokens")).alias("perplexity"),
    )
