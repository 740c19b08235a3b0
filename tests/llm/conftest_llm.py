import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strong potion under pale moon light near old stone bridge and nobody sees them except one grey cat".split()
#: Names that the operators use inside, as columns of no concern to them.
CLASH = ["id", "a", "b", "u", "v", "m", "node", "root", "hi", "lo", "table", "bucket", "rank", "unit", "start", "end", "h1", "h2", "n", "f", "k", "v0", "key", "value", "word", "cell", "kind", "audio", "tokens", "count", "reject", "quality", "toxic", "label", "template", "item_id", "kept_doc_id", "distance"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def prose(seed, n=120):
    """Words in an order of their own for each seed."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) + ("." if r.random() < 0.1 else "") for _ in range(n))


def table(spark, rows):
    """Documents with every clashing column."""
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None, *["x"] * len(CLASH)) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = prose("long", 40_000)
    return [
        (1, prose(1), "en"), (1, prose(1), "en"), (2, None, "en"), (3, "", "fr"), (4, long, "en"), (5, prose(1), "de"), (None, prose(6), None),
        (7, "  \n \n.!?", "en"), (8, "é", None), (9, prose(9).replace(" ", "\n"), "fr"), (10, "x" * 200_000, "de"), (None, None, None),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return table(spark, edge_rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
