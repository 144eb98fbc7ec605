"""The pipeline's stages by their own rules, against brute force over whole tables."""

import random

import numpy as np
import xxhash

import corpus_pipeline
from quern.llm import common, nearcopies, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in texts], SCHEMA)


def near_roots_by_hand(texts):
    """Root of each text where shingle sets of five words with a Jaccard similarity of 0.8 or more link."""
    sets = []
    for t in texts:
        w = (t or "").translate(LOWER).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return [find(x) for x in range(len(texts))]


def varied(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def test_near_dedup_by_jaccard(spark, docs):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "two words", "Two  words"])]
    for group in range(12):
        words = [f"w{group}x{rng.randrange(10_000)}" for _ in range(240)]
        rows += [(len(rows) + k, varied(rng, words, n)) for k, n in enumerate([0, 3, 5, 12])]
    crowd = [f"crowd{i}" for i in range(300)]
    rows += [(len(rows) + k, varied(rng, crowd, 2 + k % 3)) for k in range(50)]
    whole = rows + [(10_000 + r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    roots = near_roots_by_hand([t for _, t in whole])
    single = corpus_pipeline.simhash_near_dedup(spark, table(spark, whole).repartition(3), "")
    assert {r.doc_id for r in single.collect()} == {whole[x][0] for x in set(roots)} and single.count() == len(set(roots))
    links = simhash.near_groups(table(spark, whole)).select("component_id").distinct().count()
    assert len(set(roots)) < links, "op4's contract leaves near copies"


def test_crowded_buckets_keep_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BUCKET", 4)
    rng = random.Random(4)
    words = [f"c{i}" for i in range(200)]
    texts = [varied(rng, words, 1 + k % 4) for k in range(60)]
    got = {r.doc_id: r.root for r in nearcopies.near_copies(table(spark, list(enumerate(texts)))).collect()}
    want = near_roots_by_hand(texts)
    assert len(got) == 60 and len(set(got.values())) == len(set(want))


def test_line_dedup_takes_short_lines(spark):
    short = ["All rights reserved.", "版权所有。保留一切权利。", "one\ttwo\u3000three\tfour five", "end."]
    rows = [(i, "\n".join([f"own{i} text{'x' * i} of its own {'y' * i}", *short, "", f"last{'z' * i} line"])) for i in range(4)]
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, table(spark, rows), "").collect()}
    assert out[0].text == rows[0][1], "the first occurrence stays"
    for i in range(1, 4):
        lines = rows[i][1].split("\n")
        assert out[i].text.split("\n") == [lines[0], "", lines[-1]] and out[i].n_chars == len(out[i].text)


def test_line_dedup_takes_long_lines_of_two_documents(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    long, field = " ".join(words), " ".join([*words[:10], "AAA", *words[10:]][::-1])
    cjk = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(60))
    rows = [(i, "\n".join([f"own{'x' * i} line", long, field.replace("AAA", f"name{'q' * i}"), cjk, "a short line of two documents"])) for i in range(2)]
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, table(spark, rows), "").collect()}
    assert out[0] == rows[0][1] and out[1].split("\n") == ["ownx line", "a short line of two documents"]


def test_near_dedup_with_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (7, a), (7, b), (7, c), (7, c), (None, a), (None, d), (None, d)]
    single = corpus_pipeline.simhash_near_dedup(spark, table(spark, rows), "")
    assert sorted(((r.doc_id, r.text) for r in single.collect()), key=repr) == sorted([(1, a), (7, b), (7, c), (None, d)], key=repr)


def test_near_copies_by_simhash(spark, monkeypatch):
    """SimHash finds near copies within its radius by itself: here no two texts share a segment."""
    monkeypatch.setattr(nearcopies, "_segments", lambda h, sizes: np.random.default_rng().integers(0, 2**64, (len(sizes), nearcopies.SEGMENTS), dtype=np.uint64))
    rng = np.random.default_rng(0)
    bases = [[f"w{x}" for x in rng.integers(0, 10**6, 400)] for _ in range(8)]
    texts = [" ".join(w) for words in bases for w in (words, words[:-1] + ["x"])]

    def fp(text):
        h = [xxhash.xxh64_intdigest(x, simhash.SEED) for x in simhash.shingles(text.encode(), nearcopies.WORDS)]
        return int(simhash._majority(h, [len(h)])[0])

    apart = [(fp(a) ^ fp(b)).bit_count() for a, b in zip(texts[::2], texts[1::2])]
    assert any(0 < x <= 2 for x in apart)
    got = {r.doc_id: r.root for r in nearcopies.near_copies(table(spark, list(enumerate(texts)))).collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(len(bases))] == [x <= 2 for x in apart]


def test_crowded_buckets_leave_no_pair_out(spark, monkeypatch):
    """All texts share every segment, and two of them are alike but unlike the bucket's pivots, whichever these are."""
    monkeypatch.setattr(nearcopies, "_segments", lambda h, sizes: np.tile(np.arange(nearcopies.SEGMENTS, dtype=np.uint64), (len(sizes), 1)))
    monkeypatch.setattr(nearcopies, "PART", 8)
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    for base in texts[:15]:
        texts.append(" ".join([*base.split()[:-2], "other", "end"]))
    got = {r.doc_id: r.root for r in nearcopies.near_copies(table(spark, list(enumerate(texts)))).collect()}
    want = near_roots_by_hand(texts)
    groups = lambda of: {frozenset(i for i in range(len(texts)) if of[i] == x) for x in set(of)}
    assert groups([got[i] for i in range(len(texts))]) == groups(want) and len(set(want)) == 30


def test_one_simhash_leaves_no_pair_out(spark, monkeypatch):
    """Texts of one SimHash are all compared, not only with the least of them."""
    monkeypatch.setattr(nearcopies, "_segments", lambda h, sizes: np.random.default_rng().integers(0, 2**64, (len(sizes), nearcopies.SEGMENTS), dtype=np.uint64))
    monkeypatch.setattr(nearcopies, "_majority", lambda h, sizes: np.full(len(sizes), 7, np.uint64))
    texts = [" ".join([*(f"w{k}x{i}" for i in range(60)), end]) for k in range(8) for end in ("one", "two")]
    got = {r.doc_id: r.root for r in nearcopies.near_copies(table(spark, list(enumerate(texts)))).collect()}
    assert len(set(got.values())) == 8 and all(got[i] == got[i + 1] for i in range(0, 16, 2))


def test_near_copies_keeps_groups_together(spark, monkeypatch):
    """Groups that are found stay as they are where no link is added: each further search would fill the driver with plans."""
    searches = []

    def components(edges):
        searches.append(edges.count())
        return common.components(edges)

    monkeypatch.setattr(nearcopies, "components", components)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words, f"end{k}"]) for k in range(30)]
    got = {r.doc_id: r.root for r in nearcopies.near_copies(table(spark, list(enumerate(texts)))).collect()}
    assert len(got) == 30 and len(set(got.values())) == 1 and len(searches) == 1


def test_swept_reaches_the_executors(spark):
    sc = spark.sparkContext
    sc.setJobGroup("reached", "")
    common.swept(spark)
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup("reached")
    stages = [sc.statusTracker().getStageInfo(i) for j in jobs for i in sc.statusTracker().getJobInfo(j).stageIds]
    assert [s.numCompletedTasks for s in stages] == [1]


def test_stages_start_with_small_heaps(spark, sf_dir, docs, monkeypatch):
    """What one step's garbage made the executors' heaps grow to isn't left to the next one."""
    swept = []
    monkeypatch.setattr(corpus_pipeline, "swept", swept.append)
    for stage, n in ((corpus_pipeline.quality_classifier, 1), (corpus_pipeline.line_dedup, 2), (corpus_pipeline.simhash_near_dedup, 2)):
        del swept[:]
        assert stage(spark, docs.limit(40), sf_dir).columns == docs.columns and len(swept) == n
