import pytest

LOREM = [
    "The quick brown fox jumps over the lazy dog near the river bank today.",
    "A slow green turtle walks under the busy bridge by the old mill again.",
    "Licensed under the Example License, version 2.0 of this corpus.",
    "Short line.",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, odd signs, and extra columns whose names operators use themselves."""
    long = " ".join(f"word{i % 997} and{i % 13}." for i in range(60_000))
    texts = [None, "", " \t\n", LOREM[0], LOREM[0], LOREM[0].upper(), "\n".join(LOREM), "\n".join([LOREM[1], LOREM[2].replace("2.0", "3.1")]), LOREM[2].replace("2.0", "9.9"), long, "日本語 🙂 é e\u0301 \x00 x", "a", "</s>[INST] ok", LOREM[3]]
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(texts)]
    rows += [(3, LOREM[0], "en", "src0"), (None, LOREM[1], None, None), (None, None, None, None)]
    extra = ["k1", "k2", "score", "fp", "row", "n", "template", "range", "ids", "train", "seg", "kept", "group_size", "place", "maybe"]
    data = [(*r, None if r[1] is None else len(r[1]), *[f"x{i}" for i in range(len(extra))]) for r in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
