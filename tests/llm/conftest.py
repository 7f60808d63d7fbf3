import random

import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, H long, `kept` string, `tag` int"


def edge_rows():
    """Nulls, empty and odd texts, ties, repeated rows, a long text, clashing columns."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta,", "iota.", "KAPPA", "straße", "名前"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    near = [rng.choice(words) for _ in range(400)]
    texts = [None, "", " ", "\n", "\n\n a \n", "a", "A", "a\n", "same text here", "same text here", "same text here", "x <|endoftext|> y", "tabs\t\tand  spaces \n  z", "é́   nbsp em", "$$$ 123 %%%", long, long + " tail", " ".join(near), " ".join([*near, "more"]), "one two", "\x1c odd \x85 control", "🎉🎉 emoji 日本語", "common line\nown 1", "common line\nown 2", "  Common Line \nown 3"]
    rows = [(i * 3, t, ["en", "de", None][i % 3], "src0", i, "k", i) for i, t in enumerate(texts)]
    rows += [(i + 500, f"{'common line'}\nnumber {i}", "en", None, None, None, None) for i in range(12)]
    rows += [rows[8], rows[8]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def cases(edge, sf):
    """Both tables as lists of (doc_id, text) with the DataFrame."""
    return [(df, [(r.doc_id, r.text) for r in df.collect()]) for df in (edge, sf)]
