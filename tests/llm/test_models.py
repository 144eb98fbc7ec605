"""Quality classifier, class-based language model, chat templates, URL filters, pieces, packing and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import brown, chat, entries, packing, pieces, quality, template, urls
from tests.conftest import same_rows

WORD = "word_bpe_49k.json"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def remainder(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


# -- quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in rows_of(entries.QUERIES["op1_neighbour_quality"](spark, sf))}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r["held_out"] == (remainder(i, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in out.items())
    held = [(out[r.doc_id]["predicted"], r.quality) for r in labels if out[r.doc_id]["held_out"]]
    good = [p for p, y in held if y]
    bad = [p for p, y in held if not y]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_quality_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (9, 0, 1), (6, None, None), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_docs, labels, F.lit(True))
    assert len(model.value.labels) == 2
    out = rows_of(quality.score(odd_docs, model))
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r["score"] for r in out}
    assert by_id[0] == by_id[1] == model.value.prior and by_id[3] > 0.7 > by_id[9]
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, s in by_id.items() if i is not None and s >= 0.7}
    assert quality.score(no_docs, model).count() == 0
    blank = quality.fit(odd_docs, labels.where("false"), F.lit(True))
    assert {r["score"] for r in rows_of(quality.score(odd_docs, blank))} == {0.5}


def test_votes_by_hand():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(list(b"abc DEF!?.,12 \n"), rng.integers(20, 200)).astype(np.uint8)) for _ in range(60)]
    y = rng.integers(0, 2, 60)
    model = quality.Model(np.stack([quality.terms(t) for t in texts]), y)
    got = model.scores(texts[:10])
    for t, s in zip(texts, got):
        v = model.project(quality.terms(t)[None])[0]
        near = sorted(((float(np.maximum(v @ u, 0)), int(label)) for u, label in zip(model.vectors, y)), reverse=True)[: quality.NEIGHBOURS]
        want = sum(c**quality.SHARPNESS * label for c, label in near) / sum(c**quality.SHARPNESS for c, _ in near)
        assert abs(s - want) < 1e-4


# -- language model


def tokens(text):
    return (text or "").encode().translate(brown.LOWER).split() + [brown.END]


def base_by_hand(rows):
    count = Counter()
    for i, t in rows:
        if remainder(i, 5) != 1:
            count.update(tokens(t))
    n, room = sum(count.values()), math.log10(sum(count.values()) + 0.5 * (len(count) + 1))
    return n, [(i, remainder(i, 5) == 1, len(w), sum(count[x] > 0 for x in w), sum(math.log10(count[x] + 0.5) - room for x in w)) for i, t in rows for w in [tokens(t)]]


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
@pytest.mark.parametrize("known", [100_000, 50])
def test_scores(which, known, request, monkeypatch):
    """Also with so small a vocabulary that most words are joined."""
    monkeypatch.setattr(brown, "KNOWN", known)
    monkeypatch.setattr(brown, "CLUSTERED", 30)
    monkeypatch.setattr(brown, "CLASSES", 6)
    monkeypatch.setattr(brown, "ASSIGNED", 40)
    df = request.getfixturevalue(which)
    out = rows_of(brown.score(df, brown.held_out(F.col("doc_id"), 5, 1)))
    n, want = base_by_hand([(r.doc_id, r.text) for r in df.collect()])
    key = lambda r: repr((r[0], *r[1:4], round(r[4], 6)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in out]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * max(1, abs(b[4]))
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] < 0 and r["perplexity"] > 1 for r in out)


def test_model_beats_the_base(spark):
    out = rows_of(entries.QUERIES["op2_brown_score"](spark, "/root/testdata/sf0.01"))
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_without_rows(spark, no_docs):
    assert brown.score(no_docs, brown.held_out(F.col("doc_id"), 5, 1)).count() == 0
    only = spark.createDataFrame([(1, "never seen")], "doc_id long, text string")
    r = brown.score(only, F.lit(True)).first()
    assert r.n_known == 0 and r.train_tokens == 0 and r.n_tokens == 3 and math.isfinite(r.score)


def test_exchange_finds_classes():
    """Words of two kinds that alternate end up apart, and the likelihood doesn't fall below a random split's."""
    rng = np.random.default_rng(1)
    pairs = np.zeros((12, 12))
    for _ in range(3000):
        a, b = rng.integers(0, 6), 6 + rng.integers(0, 6)
        pairs[a, b] += 1
        pairs[b, rng.integers(0, 6)] += 1
    of = brown.exchange(pairs, 2, 20)
    assert len(set(of[:6])) == len(set(of[6:])) == 1 and of[0] != of[6]


def test_gains_are_those_of_the_likelihood():
    """Of every word and class, with bigrams of a word with itself, against the likelihood counted anew."""
    rng = np.random.default_rng(4)
    for classes in (2, 5):
        text = rng.integers(0, 14, 400)
        pairs = np.zeros((14, 14), int)
        np.add.at(pairs, (text[:-1], text[1:]), 1)
        of = rng.integers(0, classes, 14)

        def joint(of, pairs=pairs, classes=classes):
            out = np.zeros((classes, classes))
            np.add.at(out, (of[:, None].repeat(14, 1), of[None, :].repeat(14, 0)), pairs)
            return out

        member, own = np.eye(classes)[of], np.diag(pairs)
        others = pairs - np.diag(own)
        gain = brown.gains(joint(of), of, others @ member, others.T @ member, own)
        for w in range(14):
            moved = [brown.likelihood(joint(np.where(np.arange(14) == w, c, of))) for c in range(classes)]
            assert np.allclose(gain[w] - gain[w, of[w]], np.array(moved) - moved[of[w]])


def test_words_past_the_broadcast_ones_are_exchanged(spark, monkeypatch):
    """Words of two kinds that alternate, rare ones among them: rare words of one ending and count score better in their own kind's places."""
    monkeypatch.setattr(brown, "KNOWN", 12)
    monkeypatch.setattr(brown, "CLASSES", 2)
    rng = random.Random(5)
    kinds = [[f"{k}{i}" for i in range(6)] for k in "ab"]
    rare = [[f"{k}{i}xyz" for i in range(40)] for k in "pq"]

    def text(odd, n=12):
        words = [rng.choice(kinds[i % 2]) for i in range(n)]
        for i, w in odd.items():
            words[i] = w
        return " ".join(words)

    ids = iter(range(10_000))
    train = lambda: next(i for i in ids if remainder(i, 5) != 1)
    held = lambda: next(i for i in ids if remainder(i, 5) == 1)
    rows = [(train(), text({2 + k: rare[k][i], 6 + k: rare[k][(i * 7 + 1) % 40]})) for k in (0, 1) for i in range(40) for _ in range(3)]
    rows += [(train(), text({})) for _ in range(100)]
    rows += [(train(), text({4 + k: rare[k][i], 5 + k: rare[1 - k][i]})) for k in (0, 1) for i in range(40)]  # rare words side by side
    right = [(held(), f"a0 q{i}xyz a1 q{i + 1}xyz a2 b3") for i in range(30)]
    wrong = [(held(), f"a0 p{i}xyz a1 p{i + 1}xyz a2 b3") for i in range(30)]
    df = spark.createDataFrame(rows + right + wrong, "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in rows_of(brown.score(df, brown.held_out(F.col("doc_id"), 5, 1)))}
    for (a, _), (b, _) in zip(right, wrong):
        assert out[a]["n_known"] == out[b]["n_known"] == 7 and abs(out[a]["base_score"] - out[b]["base_score"]) < 0.5
        assert out[a]["score"] > out[b]["score"] + 2


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_model_by_hand(which, request, monkeypatch):
    """Class bigrams and scores from the classes of all words, with most words joined and blocks of few words."""
    for name, value in {"KNOWN": 50, "CLUSTERED": 30, "ASSIGNED": 40, "CLASSES": 6, "BLOCK": 3000, "BLOCK_WORDS": 300, "SLICE": 1000}.items():
        monkeypatch.setattr(brown, name, value)
    found, learn = [], brown._learn

    def spy(tokens, rare, words, counts):
        of, rare_of, joint, seen = learn(tokens, rare, words, counts)
        classes = dict(zip([brown.END, *words], of.tolist())) | {bytes(r.word): r.k for r in rare_of.collect()}
        found.append((classes, joint, seen))
        return of, rare_of, joint, seen

    monkeypatch.setattr(brown, "_learn", spy)
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, tokens(r.text)) for r in df.collect()]
    out = rows_of(brown.score(df, brown.held_out(F.col("doc_id"), 5, 1)))
    of, joint, seen = found[0]
    assert set(of) == {w for _, t in rows for w in t} and [w for w, k in of.items() if k == 0] == [brown.END]
    want, count = np.zeros_like(joint), Counter()
    for i, t in rows:
        if remainder(i, 5) != 1:
            count.update(t)
            for a, b in zip([brown.END, *t], t):
                want[of[a], of[b]] += 1
    assert np.array_equal(joint, want) and math.isclose(brown.likelihood(want), max(seen)) and max(seen) > seen[0]
    size = want.sum(0)
    distinct = np.bincount([of[w] for w in count], minlength=len(size))
    share = (size + 0.5) / (size.sum() + 0.5 * len(size))
    step = (want + brown.PRIOR * share) / (want.sum(1, keepdims=True) + brown.PRIOR)

    def by_hand(t):
        return sum(math.log10(step[of[a], of[b]] * (count[b] + 0.5) / (size[of[b]] + 0.5 * (distinct[of[b]] + 1))) for a, b in zip([brown.END, *t], t))

    key = lambda r: repr((r[0], r[1], round(r[2], 5)))
    got = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in out), key=key)
    for a, b in zip(got, sorted(((i, len(t), by_hand(t)) for i, t in rows), key=key)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 * max(1, abs(b[2]))


def test_model_leaves_no_tables_of_its_rounds(spark, docs, tmp_path, monkeypatch):
    """Of all it writes to the shared folder, tokens, the best round's rare words and their rows stay; sums are sent without their zeros."""
    monkeypatch.setattr(brown, "KNOWN", 50)
    monkeypatch.setattr(brown, "CLASSES", 6)
    names = (f"file://{tmp_path}/quern-{i}" for i in range(100))
    monkeypatch.setattr(brown, "new_path", lambda spark: next(names))
    rows_of(brown.score(docs, brown.held_out(F.col("doc_id"), 5, 1)))
    assert len(list(tmp_path.glob("quern-*"))) == 3
    sums = np.zeros(brown.CHUNKS * 30_000, np.int32)
    sums[::300] = np.arange(3200)
    chunks = brown._chunks(sums)
    assert sum(map(len, chunks.column(1).to_pylist())) < 2 * 3200
    assert np.array_equal(np.concatenate([brown._unpacked(x, 30_000) for x in chunks.column(1).to_pylist()]), sums)


def test_words_are_those_of_bytes(monkeypatch):
    """Any white space, other letters' capitals, empty and null texts, in parts of any size."""
    texts = ["", None, " ", "\x1cA\x85 \u00a0B\x0b\x0cc\r\n\td ", "\u00c4\u212a \0 e" * 50, "x", *["Aa bB " * k for k in range(20)]]
    want = [(t or "").encode().translate(brown.LOWER).split() for t in texts]
    for size in (1, 40, 10_000):
        monkeypatch.setattr(brown, "TEXT_BYTES", size)
        for column in (pa.array(texts), pa.array(["no", *texts], pa.large_string()).slice(1)):
            parts = list(brown._words(column))
            assert [w for _, _, words in parts for w in words.to_pylist()] == [w for t in want for w in t]
            assert [n for _, sizes, _ in parts for n in sizes] == list(map(len, want)) and [i for i, *_ in parts] == [0, *np.cumsum([len(sizes) for _, sizes, _ in parts])][:-1]


def test_class_model_sums_to_one():
    """Emissions of a class, with one unseen word, and transitions are distributions."""
    joint = np.array([[0, 3, 1], [2, 5, 4], [2, 3, 0]], float)
    share = (joint.sum(0) + 0.5) / (joint.sum() + 1.5)
    step = (joint + brown.PRIOR * share) / (joint.sum(1, keepdims=True) + brown.PRIOR)
    assert np.allclose(step.sum(1), 1)
    counts = np.array([4.0, 3.0, 1.0])
    assert math.isclose(sum((c + 0.5) / (counts.sum() + 0.5 * 4) for c in [*counts, 0]), 1)


# -- chat


def render(source, **values):
    return "".join(t for t, _ in template.compile_template(source, chat.CHAT_FILTERS)(values))


def test_template_language():
    m = [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}]
    assert render("{% for x in m %}{{ loop.index }}{{ x.role }}{% if not loop.last %},{% endif %}{% endfor %}", m=m) == "1user,2assistant"
    assert render("{% if a == 1 and not b %}x{% elif c %}y{% else %}z{% endif %}", a=2, b=1, c=0) == "z"
    assert render("{% set v = 'q' + n %}{{ v | upper }}{{ 1 + 2 }}{{ none }}{{ m['k'] }}{{ 2 in l }}", n="r", m={"k": "K"}, l=[2]) == "QR3Ktrue"
    assert render("{{ '{{' + \"\\n\" }}{ % }") == "{{\n{ % }"
    for bad in ("{% if a %}", "{% for x %}{% endfor %}", "{{ }}", "{{ a b }}", "{{ a | nope }}", "{{ f( }}", "{% odd %}", "{{ ; }}", "{% endif %}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)
    for unsafe in ("{{ m.__class__ }}", "{{ m.upper }}", "{{ x }}"):
        with pytest.raises(template.TemplateError):
            render(unsafe, m="text")


def test_constants_fold():
    tree = template.fold(template.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{{ y }}{% else %}d{% endif %}{{ 1 + 1 }}"))
    assert tree == (template.Text("abCd2"),)
    assert template.fold(template.parse("{% if true and x %}{{ x }}{% endif %}"))[0].test == template.Name("x")
    with pytest.raises(template.TemplateError):
        template.fold(template.parse("{{ 'a' < 1 }}"))


def test_escapes():
    random.seed(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "~", "<", "[", "/", "s>", "INST]", "x", "\n", "\\"]
    for _ in range(500):
        t = "".join(random.choices(parts, k=random.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in parts[:4])
        assert chat._unline(chat._line(t)) == t and "\n" not in chat._line(t)


def chat_by_hand(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    words = lambda v: (v is not None, v or "")
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), words(r[2]), words(r[3]))):
        by.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("fragment", [1 << 20, 40])
def test_chat_round_trip(spark, fragment):
    random.seed(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[~INST]", "\n", "x é", "🙂", ""]
    text = lambda: random.choice([None, "".join(random.choices(parts, k=random.randint(0, 9))), "y" * random.choice([1, 90])])
    rows = [(random.choice([None, 1, 2, 3, 4]), random.choice([None, 0, 1, 2, 3, 5]), random.choice([None, "user", "assistant", "assistant", "system", "to\nol\\", "</s>"]), text()) for _ in range(150)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, fragment string")
    made = chat.format_conversations(df, fragment=fragment)
    want = chat_by_hand(rows)
    for ordered, source in ((True, made), (False, made.repartition(3))):
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows_of(chat.read_back(source, ordered))}
        assert got == want
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_chat_query(spark, sf_dir):
    got = {r["conv_id"]: r for r in rows_of(entries.QUERIES["op3_chat_format"](spark, sf_dir))}
    own = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = chat_by_hand([*own, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")])
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
    assert got[-7]["loss_chars"] == 21


def test_other_template(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df, "{% for m in messages %}<{{ m.role }}>{% generation %}{{ m.text }}{% endgeneration %}{% endfor %}").first()
    assert r.text == "<user>hi<assistant>yo" and [r.text[s.start : s.start + s.length] for s in r.spans] == ["hi", "yo"]


# -- URLs


def test_url_query_matches_sql(spark, duck, sf_dir):
    same_rows(entries.QUERIES["op6_temporal_url_filter"](spark, sf_dir), duck, entries.ORACLE["op6_temporal_url_filter"])


def test_urls_as_of(spark):
    entry = spark.createDataFrame([("bad.org", "block", "2024-02-01"), ("bad.org", "none", "2024-03-01"), ("ok.bad.org", "allow", "2024-01-01"), ("x.net", "allow", "2024-01-05"), ("x.net", "BLOCK", "2024-01-05"), (None, "block", "2024-01-01"), ("y.net", "odd", "2024-01-01"), ("y.net", "block", None), ("bad.org", "block", "2024-02-01")], "pattern string, action string, since string").withColumn("since", F.col("since").cast("timestamp_ntz"))
    seen = [
        (1, "http://bad.org/x", "2024-01-31 23:59:59", True), (2, "https://u:p@www.BAD.org:80/?q", "2024-02-01 00:00:00", False), (3, "http://a.ok.bad.org", "2024-02-15 00:00:00", True),
        (4, "http://bad.org", "2024-03-01 00:00:00", True), (5, "http://x.net", "2024-06-01 00:00:00", False), (6, "http://notbad.org", "2024-02-02 00:00:00", True), (7, "no url", "2024-02-02 00:00:00", True),
        (8, None, "2024-02-02 00:00:00", True), (9, "http://bad.org", None, True), (10, "http://y.net", "2024-02-02 00:00:00", True), (2, "https://u:p@www.BAD.org:80/?q", "2024-02-01 00:00:00", False), (11, "http://bad.org./", "2024-02-29 23:00:00", False),
    ]
    df = spark.createDataFrame(seen, "i long, url string, fetched_at string, want boolean").withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz")).withColumn("pattern", F.lit("mine"))
    out = urls.filter_urls(df, entry)
    assert out.count() == len(seen) and out.where("kept <> want").count() == 0 and out.columns == ["i", "url", "fetched_at", "want", "pattern", "action", "kept"]
    assert urls.filter_urls(df, entry.where("false")).where("NOT kept OR pattern IS NOT NULL").count() == 0
    assert urls.filter_urls(df.where("false"), entry).count() == 0


# -- pieces


@pytest.fixture(scope="module")
def model():
    return entries.vocabulary("piece_bpe_32k.model")


def test_pieces_equal_the_library(model, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    vocabulary, encode = pieces.encoder(model)
    random.seed(1)
    parts = ["a", "b", "th", "e", "ion", "ré", " ", "  ", "日", ",", ". ", "\n", "the", "tion", "é", "0", "aaaa", "🙂", "▁", "\x00"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 80))) for _ in range(300)] + [r.text for r in docs.limit(40).collect()]
    for t in texts:
        ids = np.frombuffer(encode(t), "<u4").tolist()
        assert ids == library.encode(t)
        if "▁" not in t:
            assert pieces.decode_ids(np.array(ids, int), vocabulary) == t
        run = pieces.SPACE + t.replace(" ", pieces.SPACE)
        if t:
            assert [i for part in pieces.viterbi(run, vocabulary) for i in part] == ids
        if len(run) < 32 and t:
            assert pieces.within_window(run, vocabulary) == ids


def test_stream_commits_early(model):
    vocabulary, _ = pieces.encoder(model)
    fed = 0

    def chars():
        nonlocal fed
        for c in ("the quick brown fox " * 3000).replace(" ", pieces.SPACE):
            fed += 1
            yield c

    waits, last = [], 0
    for part in pieces.viterbi(chars(), vocabulary):
        waits.append(fed - last)
        last = fed
    assert len(waits) > 1000 and max(waits) <= 4 * vocabulary.longest


def test_window_forgets_what_is_certain(model):
    """Chunks of any size give the library's ids, and the window stays bounded."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    vocabulary, _ = pieces.encoder(model)
    text = "internationalisation 日本 counterrevolutionary🙂 " * 40
    run = pieces.SPACE + text.replace(" ", pieces.SPACE)
    for size in (1, 7, 33):
        window, found, commits = pieces.Open(vocabulary), [], 0
        for at in range(0, len(run), size):
            window.feed(run[at : at + size])
            part = window.commit()
            commits += bool(part)
            found += part
            assert len(window.last) == len(window.start) == len(window.chars) + 1 <= 4 * vocabulary.longest + size
        assert found + window.ids(window.base + len(window.chars)) == library.encode(text) and commits > 40


def test_pieces_cases(spark, odd_docs, no_docs, model):
    made = pieces.encode_texts(odd_docs, model)
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect() if r.doc_id is not None}
    for r in pieces.decode_texts(made, model).collect():
        if r.doc_id is not None:
            assert r.text == texts[r.doc_id]
    assert pieces.encode_texts(no_docs, model).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert pieces.decode_texts(nothing, model).first().text == ""


# -- packing


def check_packing(found, rows, window, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [1])) for i, x in rows)
    by_sequence = {}
    for r in found:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        at = 0
        for r in parts:
            assert r["offset"] == at
            at += r["length"]
        assert at == window or at < window and at & (at - 1) == 0
    docs: dict = {}
    for r in found:
        docs.setdefault(r["doc_id"], []).append(r)
    for i, parts in docs.items():
        copies = [list(k[1]) for k, n in want.items() if k[0] == i for _ in range(n)]
        assert sum(r["length"] for r in parts) == sum(map(len, copies))
        if len(copies) == 1:
            parts.sort(key=lambda r: r["start"])
            assert np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist() == copies[0]
            assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1]] and {r["doc_tokens"] for r in parts} == {len(copies[0])}
    assert set(docs) == {i for i, _ in rows}


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
@pytest.mark.parametrize("block", [1 << 19, 3000])
def test_packing(which, block, request, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", block)
    monkeypatch.setattr(packing, "WORDS", 500)
    df = request.getfixturevalue(which)
    path = entries.vocabulary(WORD)
    found = rows_of(packing.pack(df, path, window=2048))
    check_packing(found, [(r.doc_id, r.text) for r in df.collect()], 2048, path)


def test_packing_keeps_special_tokens(spark):
    """Ids are those of the tokenizer's plain call, in which strings of special tokens are these tokens; as_text makes them ordinary text."""
    from tokenizers import Tokenizer

    path, text = entries.vocabulary(WORD), "Hello <|endoftext|> world"
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    library = Tokenizer.from_file(path)
    for as_text in (False, True):
        library.encode_special_tokens = as_text
        found = sorted(rows_of(packing.pack(df, path, as_text=as_text)), key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in found), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [1]


def test_words_by_rules_equal_the_library():
    from tokenizers import Tokenizer

    from quern.llm import wordbpe

    path = entries.vocabulary(WORD)
    library, encoder = Tokenizer.from_file(path), wordbpe.WordEncoder(path, words=500)
    assert encoder.rules is not None
    random.seed(3)
    parts = ["a", "b", "th", "e", "don't", "'s", "ré", "É", "ß", "×", "÷", "İ", "ſ", " ", "  ", "日", ",", ". ", "\n", "the", "12", "é", "0", "aaaa", "🙂", "\x00", "K", "\x85", "\xa0", "\x1c", "ª", "²", "Ω"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(600)] + ["x" * 5000, ""]
    got = [i for at in range(0, len(texts), 50) for i in encoder.encode([t.encode() for t in texts[at : at + 50]])]
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_words_in_use_stay_known():
    """Words that each run of texts has are merged once, however many others come and go meanwhile."""
    from quern.llm import wordbpe

    encoder, asked = wordbpe.WordEncoder(entries.vocabulary(WORD), words=300), []
    learn = encoder.learn
    encoder.learn = lambda new: (asked.extend(new), learn(new))
    usual = [f"usual{i}x" for i in range(100)]
    for turn in range(12):
        texts = [" ".join([*usual, *(f"rare{turn}y{i}" for i in range(100))]).encode()]
        got = encoder.encode(texts)
        assert got == encoder.by_library(texts)
    assert all(asked.count(w.encode()) == 1 for w in usual) and len(encoder.known) <= 300 + 200


def test_packing_gives_memory_back_between_steps(spark, monkeypatch):
    """Executors' heaps are collected before texts are encoded and before blocks are packed."""
    swept, tasks = packing.swept, []

    def counted(session):
        spark.sparkContext.setJobGroup("swept", "")
        swept(session)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("swept")
        tasks.append(len(jobs))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    monkeypatch.setattr(packing, "swept", counted)
    df = spark.createDataFrame([(i, "some words " * i, f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    check_packing(rows_of(packing.pack(df, entries.vocabulary(WORD), window=64)), [(r.doc_id, r.text) for r in df.collect()], 64, entries.vocabulary(WORD))
    assert tasks == [1, 2]


def test_packing_nothing_and_many_sources(spark, no_docs, monkeypatch):
    path = entries.vocabulary(WORD)
    assert packing.pack(no_docs, path).count() == 0
    monkeypatch.setattr(packing, "QUEUES", 4)
    df = spark.createDataFrame([(i, "some words " * i, f"s{i}") for i in range(20)], "doc_id long, text string, source string")
    check_packing(rows_of(packing.pack(df, path, window=64)), [(r.doc_id, r.text) for r in df.collect()], 64, path)
    with pytest.raises(ValueError):
        packing.pack(df, path, mixture={"s1": 1.0})


def test_windows_follow_the_mixture():
    rng = np.random.default_rng(0)
    lengths, queues = rng.integers(50, 900, 400).tolist(), rng.choice(3, 400, p=[0.5, 0.3, 0.2]).tolist()
    total = np.bincount(queues, weights=lengths)
    share = total / total.sum()
    done, windows = np.zeros(3), 0
    last = -1
    for sequence, _, piece, _, n in packing.plan_block(lengths, queues, share, np.zeros(3), 2048):
        if sequence != last and sequence and sequence < sum(lengths) // 2048 - 5:
            windows += 1
            assert np.abs(done - share * done.sum()).max() <= 2 * packing.QUANTUM + 3
        last = sequence
        done[queues[piece]] += n
    assert (done == total).all() and windows > 20


def test_deficits_carry_over():
    """What a queue got too little of before comes first."""
    owed = np.array([-1500.0, 1500.0])
    first = [0, 0]
    for sequence, _, piece, _, n in packing.plan_block([4096, 4096], [0, 1], np.array([0.5, 0.5]), owed, 2048):
        first[piece] += n if sequence == 0 else 0
    assert first[1] > 2 * first[0]


# -- pipeline


def test_pipeline_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mixture_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    from quern.llm import simhash
    from quern.llm.common import durable

    good = durable(corpus_pipeline.STAGES[0][1](spark, docs, sf_dir))
    scores = {r.doc_id: r.predicted for r in entries.QUERIES["op1_neighbour_quality"](spark, sf_dir).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p} and good.columns == columns
    clean = durable(corpus_pipeline.STAGES[1][1](spark, good, sf_dir))
    assert clean.columns == columns and clean.count() == good.count() and clean.where("n_chars <> length(text)").count() == 0
    single = durable(corpus_pipeline.STAGES[2][1](spark, clean, sf_dir))
    groups = simhash.near_groups(clean).collect()
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {g.component_id for g in groups}
    packed = rows_of(corpus_pipeline.STAGES[3][1](spark, single, sf_dir))
    check_packing(packed, [(r.doc_id, r.text) for r in single.collect()], 2048, entries.vocabulary(WORD))
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in packed)


def test_pipeline_on_odd_documents(spark, odd_docs, no_docs, sf_dir):
    for df in (odd_docs, no_docs):
        now = df
        for name, stage in corpus_pipeline.STAGES[1:]:
            now = stage(spark, now, sf_dir)
            if name != "mixture_packing":
                assert now.columns == df.columns
        assert (now.count() > 0) == (df.count() > 0)
    single = corpus_pipeline.simhash_near_dedup(spark, odd_docs, sf_dir)
    ids = [r.doc_id for r in single.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 3 in ids and 4 not in ids and 5 not in ids


def test_flat_bytes():
    for kind in (pa.binary(), pa.large_binary()):
        a = pa.array([b"abc", None, b"", b"de", b"f"], kind)
        for i, j in ((0, 5), (1, 5), (3, 4), (2, 2), (0, 0)):
            lengths, data = brown._flat(a.slice(i, j - i))
            want = [x or b"" for x in a.slice(i, j - i).to_pylist()]
            assert lengths.tolist() == [len(x) for x in want] and data.tobytes() == b"".join(want)


def test_words_of_equal_counts_move_alike(spark, monkeypatch):
    """Rare words that move together, equal ones worked out once, against each by itself."""
    rng, classes, n = np.random.default_rng(8), 6, 400
    joint = rng.integers(20, 400, (classes, classes)).astype(float)
    k, counts = rng.integers(1, classes, n), np.zeros((n, 2 * classes + 1), np.int64)
    counts[np.arange(n), rng.integers(0, 2 * classes, n)] = rng.integers(1, 3, n)
    rows = [(str(i).encode(), int(k[i]), b"".join(int((c << 40) + counts[i, c]).to_bytes(8, "little") for c in np.flatnonzero(counts[i]))) for i in range(n)]
    rows.append((b"unseen", 2, b""))
    got = {bytes(r.word): r.k for r in brown._exchanged(spark.createDataFrame(rows, "word binary, k long, cells binary").repartition(3), joint).collect()}
    want = [int(brown._moved(joint, k[i : i + 1], counts[i : i + 1, classes:-1], counts[i : i + 1, :classes], counts[i : i + 1, -1])[0]) for i in range(n)]
    assert [got[str(i).encode()] for i in range(n)] == want and len(got) == n + 1


def test_lists_are_gathered_by_sorting_once(spark, docs, monkeypatch):
    """The places stay sorted by word for the joins of all rounds, and the session's setting comes back."""
    plans, init, name = [], brown.Rare.__init__, "spark.sql.execution.useObjectHashAggregateExec"

    def seen(self, tokens):
        init(self, tokens)
        plans.append(self.places._jdf.queryExecution().executedPlan().toString() + self.beside._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(brown.Rare, "__init__", seen)
    before = spark.conf.get(name)
    assert brown.score(docs.limit(40), brown.held_out(F.col("doc_id"), 5, 1)).count() == 40
    assert spark.conf.get(name) == before and "SortAggregate" in plans[0] and "ObjectHashAggregate" not in plans[0] and "Sort [near" in plans[0]
