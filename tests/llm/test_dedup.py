"""Exact, SimHash and line deduplication, and fingerprints, against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import common, entries, exact, lines, simhash, sketch
from quern.sources import scratch
from tests.conftest import same_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collected(df):
    return [r.asDict() for r in df.collect()]


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        g = groups[(t or "").translate(LOWER)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_exact(which, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in collected(exact.exact_groups(df))]
    assert sorted(got, key=repr) == exact_by_hand(rows)


def test_exact_when_the_filter_is_full(docs, monkeypatch):
    monkeypatch.setattr(exact, "MOST_BITS", 1024)
    monkeypatch.setattr(exact, "SEGMENT_ROWS", 64)
    assert sorted(map(repr, collected(exact.exact_groups(docs)))) == sorted(map(repr, collected(entries.QUERIES["op8_exact_dedup"](docs.sparkSession, "/root/testdata/sf0.001"))))


def test_exact_passes_single_rows_by(docs):
    found = exact.digests(docs, "doc_id", "text")
    twice, segments, bits = exact.repeated_filter(found, found.count())
    assert 0 < np.unpackbits(twice).sum() < segments * bits / 4
    kept = exact.drop_exact_copies(docs)
    assert kept.count() == len({(t or "").translate(LOWER) for (t,) in docs.select("text").collect()}) and kept.columns == docs.columns


def fingerprint_by_hand(text, k=3):
    words = (text or "").translate(LOWER).encode().split()
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(rows):
    fps = {r: fingerprint_by_hand(r[1]) for r in set(rows)}
    nodes = sorted(set(fps.values()))
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        c = find(fps[i, t])
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, f"{fps[i, t]:016x}", least.get(find(fps[i, t]))) for i, t in rows), key=repr)


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    if which == "odd_docs":
        df = df.where("text IS NULL OR length(text) < 1000")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in collected(simhash.near_groups(df))]
    assert sorted(got, key=repr) == components_by_hand([(r.doc_id, r.text) for r in df.collect()])


def test_links_broadcast_nothing(spark, monkeypatch):
    """Probes are many times what Spark takes their size to be: no such table goes through the driver, whatever the threshold."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.durable(df)

    monkeypatch.setattr(simhash, "durable", seen)
    edges = simhash.links(spark.range(50).selectExpr("id AS fp"))
    assert edges.where("u = v").count() == 0
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_in_crowded_buckets(spark, monkeypatch, bucket):
    """Hundreds of fingerprints around a few centres, in the classical and the crowded way."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    values = set()
    for c in rng.integers(0, 2**63, 4):
        for _ in range(120):
            v = int(c)
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    fps = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert all(((e.u ^ e.v) & (2**64 - 1)).bit_count() <= 2 or bucket == 2 for e in edges.collect())
    roots = {r.node: r.root for r in common.components(edges).collect()}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert {f: roots.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_by_few_and_small_plans(spark, monkeypatch):
    """Stars take no round, and a round reads its edges no oftener than its join needs, as plans fill the driver's memory."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        return scratch.written(df)

    monkeypatch.setattr(common, "durable", seen)
    stars = spark.createDataFrame([(100 * k + i, 100 * k) for k in range(3) for i in range(1, 30)], "u long, v long")
    got = {r.node: r.root for r in common.components(stars).collect()}
    assert got == {100 * k + i: 100 * k for k in range(3) for i in range(30)} and len(plans) == 1
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(int(a), 299) for a in rng.integers(0, 300, 40)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root} and max(plans) <= 5


def test_line_dedup_matches_sql(spark, duck, sf_dir):
    same_rows(entries.QUERIES["op5_template_line_dedup"](spark, sf_dir), duck, entries.ORACLE["op5_template_line_dedup"])


def test_line_dedup_cases(spark, odd_docs, no_docs):
    boiler = "Copyright 2020 by the makers of all things good"
    rows = [(i, f"own text number{i} with its very own words {'x' * i}\n{boiler.replace('2020', str(1990 + i))}\n{'tail ' * i}") for i in range(6)]
    rows += [(10 + i, f"Dear valued customer of ours {name} your parcel has left our house this morning") for i, name in enumerate(["Ann", "Bob", "Cid", "Dan"])]
    out = {r["doc_id"]: r for r in collected(lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert out[0]["text"] == rows[0][1], "the first occurrence stays"
    for i in range(1, 6):
        assert boiler[15:] not in out[i]["text"] and out[i]["dropped_lines"] == 1 and out[i]["text"].startswith("own text")
    assert out[10]["text"] and [out[11 + i]["text"] for i in range(3)] == ["", "", ""], "a varying field is generalised"
    odd = lines.drop_recurring_lines(odd_docs)
    assert odd.columns == [*odd_docs.columns, "n_lines", "dropped_lines"] and odd.count() == odd_docs.count()
    kept = {(r.doc_id, r.text) for r in odd_docs.collect()}
    for r in odd.collect():
        if not r.dropped_lines:
            assert (r.doc_id, r.text) in kept
    got = {r.doc_id: r.text for r in odd.where("doc_id in (6, 7, 8)").collect()}
    assert got[6].count("Licensed") == 1 and "Licensed" not in got[7] and got[8] == ""
    assert lines.drop_recurring_lines(no_docs).count() == 0


def sketches(a, b, cells):
    size = np.array([cells])
    return sketch.differences([a], [b], sketch.sketch([a], size), sketch.sketch([b], size))[0]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_sketch_recovers_differences(both, one, two):
    x, y = np.array(sorted(both | one), np.uint64), np.array(sorted(both | two), np.uint64)
    only_x, only_y = sketches(x, y, sketch.CELLS)
    assert set(only_x.tolist()) == (both | one) - (both | two) and set(only_y.tolist()) == (both | two) - (both | one)


def versions_by_hand(rows):
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or "")))
    out = []
    for n, (i, t) in enumerate(rows):
        t, after = t or "", rows[(n + 1) % len(rows)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        sets = [set(sketch.paragraph_digests(x.encode()).tolist()) for x in (t, edited, after)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *(round(x, 12) for x in like)))
    return Counter(out)


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_versions(which, request, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE_DOCS", 20)
    df = request.getfixturevalue(which)
    got = collected(sketch.versions(df))
    want = versions_by_hand([(r.doc_id, r.text) for r in df.collect()])
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in got) == want
    text = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}
    seen = {}
    for r in got:
        if r["doc_id"] is not None:
            assert seen.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_paragraph_copies_count():
    once, twice = sketch.paragraph_digests(b"one two.\nthree four."), sketch.paragraph_digests(b"one two.\nthree four.\none two.")
    assert len(once) == 2 and len(twice) == 3 and set(once.tolist()) < set(twice.tolist())
    assert len(sketch.paragraph_digests(b"")) == 0


def test_hot_groups_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, "none")], "i long, k string")
    groups = rows.where("k <> 'none'").groupBy("k").agg(F.count("*").alias("size"))
    out = common.join_groups(rows, groups, "k", "size", 301)
    assert out.count() == 301 and out.where("size IS NULL").count() == 1 and out.where("k = 'hot' AND size = 200").count() == 200


def test_line_dedup_parses_samples_only(spark):
    """Lines that aren't samples drop out before they are parsed, and texts are neither split once for each line nor sorted."""
    docs = spark.createDataFrame([(i, f"one two three four {i}\nfive six seven eight nine") for i in range(50)], "doc_id long, text string")
    keyed = lines._with_key(docs, "doc_id", "text")
    every = lines.parsed_lines(keyed)
    places = every.where("doc_id = 7 AND line_no = 1").select(lines._place())
    assert {(r.doc_id, r.line_no) for r in lines.parsed_lines(keyed, places=places).collect()} == {(7, 1)} and every.count() == 100
    plan = lines.drop_recurring_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" in plan and all("split(" not in part for part in plan.split("lambdafunction(")[1:])
