"""Near copies by Jaccard similarity: multi-index SimHash and, beyond its radius, MinHash find candidates; whole texts are verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable, join_groups, swept, texts_of
from .simhash import SEED, _majority, neighbours, shingles

#: Words of a shingle, and the Jaccard similarity of shingle sets that links, in tenths.
WORDS, TENTHS = 5, 8
#: Segments of the fingerprint and hashes in each: a pair at 0.8 shares a segment with probability 1 - (1 - 0.8^6)^32 = 0.99994.
SEGMENTS, ROWS = 32, 6
#: Texts that share a segment: up to so many are paired up at once; in larger buckets each meets three pivots first, and then all that it isn't linked to.
BUCKET = 16
#: Texts of a larger bucket in a block; two blocks are compared at once.
PART = 128
#: Shingle hashes that a Python worker handles at once, unless one document has more.
HELD = 60_000
#: Values of the hash by which texts without candidates are sorted out early.
SIEVE = 1 << 20

_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 2**32, SEGMENTS * ROWS, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**32, SEGMENTS * ROWS, dtype=np.uint32) | np.uint32(1)
_MIX = _rng.integers(0, 2**64, (SEGMENTS, ROWS), dtype=np.uint64) | np.uint64(1)
_AT = _rng.integers(0, 2**64, SEGMENTS, dtype=np.uint64)


def _segments(h: list[int], sizes: list[int]) -> np.ndarray:
    """(texts, SEGMENTS): each text's segments of MinHashes, as one 64-bit value each; no run of sizes is empty."""
    a, at = (np.array(h, np.uint64) >> np.uint64(32)).astype(np.uint32), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    least = np.empty((len(sizes), SEGMENTS * ROWS), np.uint32)
    for i in range(SEGMENTS * ROWS):
        least[:, i] = np.minimum.reduceat((a ^ _FLIP[i]) * _TIMES[i], at)
    out = (least.reshape(-1, SEGMENTS, ROWS).astype(np.uint64) * _MIX).sum(2, dtype=np.uint64) + _AT
    return out ^ (out >> np.uint64(29))


def _parts(text: bytes) -> list[bytes]:
    """The text's shingles; a text without words has one empty shingle, so that such texts are alike."""
    return list(shingles(text, WORDS)) or [b""]


def node_of(text_col: str) -> Column:
    """The value that stands for a row's text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def segments(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, fp, keys): node stands for the text, fp is its SimHash, keys are its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            parts, bits, h, sizes = [], [], [], []
            for t in texts_of(b.column(2)):
                before = len(h)
                h += [digest(s, SEED) for s in _parts(t)]
                sizes.append(len(h) - before)
                if len(h) >= HELD:
                    parts.append(_segments(h, sizes))
                    bits.append(_majority(h, sizes))
                    h, sizes = [], []
            if sizes:
                parts.append(_segments(h, sizes))
                bits.append(_majority(h, sizes))
            flat = np.concatenate(parts).view(np.int64).ravel() if parts else np.zeros(0, np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SEGMENTS, dtype=np.int32)), pa.array(flat))
            fps = np.concatenate(bits).view(np.int64) if bits else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps), keys], ["doc_id", "node", "fp", "keys"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), node_of(text_col).alias("node"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, node long, fp long, keys array<long>")


def with_texts(rows: DataFrame, sides: tuple[str, ...], docs: DataFrame, copies: DataFrame, total: int, text_col: str) -> DataFrame:
    """rows with the texts of the nodes in columns sides, as {side}_text."""
    uses = rows.select(F.explode(F.array(*sides)).alias("node")).groupBy("node").agg(F.count("*").alias("uses"))
    asked = durable(uses.join(copies, "node"))
    sieve = asked.select(F.col("node").bitwiseAND(F.lit(SIEVE - 1)).alias("sieve")).distinct()
    texts = docs.select(node_of(text_col).alias("node"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("sieve", F.col("node").bitwiseAND(F.lit(SIEVE - 1))).join(F.broadcast(sieve), "sieve", "left_semi").drop("sieve")
    texts = join_groups(texts, asked, "node", "copies", total).where("uses IS NOT NULL")
    texts = durable(texts.groupBy("node").agg(F.first("uses").alias("uses"), F.first("text").alias("text")))
    n = rows.count()
    for side in sides:
        rows = join_groups(rows, texts.select(F.col("node").alias(side), F.col("uses").alias(f"{side}_uses"), F.col("text").alias(f"{side}_text")), side, f"{side}_uses", n)
    return rows


def _linked(one: set[bytes], other: set[bytes]) -> bool:
    both = len(one & other)
    return 10 * both >= TENTHS * (len(one) + len(other) - both)


def alike(pairs: DataFrame, docs: DataFrame, copies: DataFrame, total: int, text_col: str) -> DataFrame:
    """Those pairs (u, v) whose texts have a Jaccard similarity of TENTHS or more, by whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for b in batches:
            keep = []
            for x, y in zip(texts_of(b.column(2)), texts_of(b.column(3)), strict=True):
                if x != last:
                    last, mine = x, set(_parts(x))
                keep.append(_linked(mine, set(_parts(y))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = with_texts(pairs, ("u", "v"), docs, copies, total, text_col)
    return durable(pairs.select("u", "v", "u_text", "v_text").mapInArrow(run, "u long, v long"))


def simhash_keys(nodes: DataFrame) -> DataFrame:
    """(node, key): any two nodes (node, fp) whose fingerprints differ in 2 bits or fewer share a key, found by multi-index hashing."""
    fps = durable(nodes.groupBy("fp").agg(F.count("*").alias("texts")))
    near, stars = neighbours(fps.select("fp"))
    pair = F.xxhash64("u", "v", F.lit(2))
    near = near.select(F.explode(F.array("u", "v")).alias("fp"), pair.alias("key"))
    stars = stars.select("fp", F.xxhash64("centre", F.lit(1)).alias("key"))
    same = fps.where("texts > 1").select("fp", F.xxhash64("fp", F.lit(0)).alias("key"))
    keys = durable(near.unionByName(stars).unionByName(same).distinct())
    # as many nodes as share a fingerprint, for as many keys as it has
    return nodes.select("fp", "node").join(keys.hint("merge"), "fp").select("node", "key")


def blocks(rows: DataFrame) -> DataFrame:
    """(key, i, j, node, root, main, first): the rows (key, node, root) of a key by pairs (i, j) of blocks of about PART rows, for compared().

    The root that most rows of a key have is main: its rows only meet the others, so that a group that is linked already
    isn't compared within. Blocks i, first, are of the other rows, blocks j of all; a key of one root has none.
    """
    of = rows.groupBy("key", "root").agg(F.count("*").alias("rows"))
    most = of.groupBy("key").agg(F.max(F.struct("rows", "root"))["root"].alias("most"), F.sum("rows").alias("all"), F.max("rows").alias("top")).where("all > top")
    parts = [F.ceil(x / PART).cast("int").alias(name) for x, name in ((F.col("all") - F.col("top"), "firsts"), (F.col("all"), "parts"))]
    told = durable(rows.join(durable(most.select("key", "most", *parts)), "key"))
    told = told.withColumns({"main": F.expr("root = most"), "turn": F.xxhash64("node")})
    first = told.where("NOT main").select("key", F.expr("CAST(pmod(turn, firsts) AS INT) AS i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "node", "root", "main", F.lit(True).alias("first"))
    each = told.select("key", F.explode(F.sequence(F.lit(0), F.col("firsts") - 1)).alias("i"), F.expr("CAST(pmod(turn, parts) AS INT) AS j"), "node", "root", "main", F.lit(False).alias("first"))
    return first.unionByName(each)


def compared(rows: DataFrame, docs: DataFrame, copies: DataFrame, total: int, text_col: str) -> DataFrame:
    """Links (u, v) that connect all texts at TENTHS or more of the rows (key, node, root) of a key, given that those of a root are connected.

    Two blocks of a key meet in a task that has the texts of both once, however many pairs they make.
    """

    def run(table: pa.Table) -> pa.Table:
        node, root, main, first = (table.column(c).to_pylist() for c in ("node", "root", "main", "first"))
        sets = {n: set(_parts(t)) for n, t in zip(node, texts_of(table.column("node_text").combine_chunks()), strict=True)}
        now: dict[int, int] = {}

        def find(x: int) -> int:
            while x in now:
                x = now[x]
            return x

        us, vs = [], []
        every = [(v, len(sets[v]), v_root, is_main) for v, v_root, is_main, is_first in zip(node, root, main, first) if not is_first]
        for u, u_root, is_first in zip(node, root, first):
            if not is_first:
                continue
            mine, size = sets[u], len(sets[u])
            for v, n, v_root, is_main in every:
                # two of the others meet once; sizes may rule a link out
                if (is_main or u < v) and 10 * n >= TENTHS * size and 10 * size >= TENTHS * n and find(u_root) != find(v_root) and _linked(mine, sets[v]):
                    now[find(u_root)] = find(v_root)
                    us.append(u)
                    vs.append(v)
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    dealt = with_texts(durable(blocks(rows)), ("node",), docs, copies, total, text_col)
    return durable(dealt.select("key", "i", "j", "node", "root", "main", "first", "node_text").groupBy("key", "i", "j").applyInArrow(run, "u long, v long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, node, root. Rows of the same root are near copies, or reach each other by them.

    Texts link whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; a text of fewer words is one
    shingle, and texts without words, null included, are alike. Candidates have SimHashes that differ in 2 bits or fewer, or, as
    texts at 0.8 differ in more, share one of SEGMENTS segments; those that share a segment or such SimHashes are a bucket. First, each text
    meets the least node of its buckets; then texts that aren't linked yet meet all others of buckets of up to BUCKET texts, and two more pivots in larger ones;
    last, they meet all others of the larger ones, so that every two texts of a bucket are linked, by others or by themselves, or compared.
    Every link is verified on the whole texts.
    """
    spark = docs.sparkSession
    found = durable(segments(docs, id_col, text_col))
    total = found.count()
    nodes = durable(found.groupBy("node").agg(F.count("*").alias("copies"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    copies = nodes.select("node", "copies")
    table = nodes.select("node", F.explode("keys").alias("key")).unionByName(simhash_keys(nodes.select("node", "fp")))
    turn = F.struct(F.xxhash64("node", "key"), "node")
    buckets = table.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least"), F.min(turn)["node"].alias("one"), F.max(turn)["node"].alias("two")).where("size > 1")
    buckets = durable(buckets)
    rows = durable(join_groups(table, buckets, "key", "size", SEGMENTS * total).where("size IS NOT NULL"))
    swept(spark)

    def ordered(df: DataFrame) -> DataFrame:
        return durable(df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    def grouped(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """(node, root) by links (u, v), and by the groups before, which count as stars: they aren't taken apart for it."""
        if before is not None:
            if links.isEmpty():
                return before
            links = links.unionByName(before.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
        swept(spark)
        return durable(nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")))

    links = alike(ordered(rows.select(F.col("node").alias("u"), F.col("least").alias("v"))), docs, copies, total, text_col)
    roots = grouped(links)
    swept(spark)
    small = rows.where((F.col("size") > 2) & (F.col("size") <= BUCKET)).select("key", "node")
    small = durable(small.join(roots, "node"))
    other = small.select("key", F.col("node").alias("v"), F.col("root").alias("v_root"))
    more = small.join(other, "key").where("node < v AND root <> v_root").select(F.col("node").alias("u"), "v")
    # pivots carry their roots, so that only pairs that aren't linked yet are made
    pivots = buckets.where(F.col("size") > BUCKET).select("key", "size", "one", "two")
    for name in ("one", "two"):
        pivots = pivots.join(roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root")), name)
    large = rows.where(F.col("size") > BUCKET).select("key", "node")
    crowded = join_groups(large, durable(pivots), "key", "size", SEGMENTS * total).join(roots, "node")
    met = F.explode(F.array(*[F.struct(F.col(name).alias("v"), F.col(f"{name}_root").alias("v_root")) for name in ("one", "two")]))
    pivoted = crowded.select(F.col("node").alias("u"), "root", met.alias("met")).where("met.v_root <> root").select("u", "met.v")
    roots = grouped(alike(ordered(more.unionByName(pivoted)), docs, copies, total, text_col), roots)
    swept(spark)
    roots = grouped(compared(large.join(roots, "node"), docs, copies, total, text_col), roots)
    named = durable(roots.join(copies, "node"))
    swept(spark)
    return join_groups(found.select("doc_id", "node"), named, "node", "copies", total).select("doc_id", "node", "root")
