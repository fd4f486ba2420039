import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "and", "house", "river", "stone", "le", "la", "maison", "rivière", "pierre", "und", "das", "haus", "fluss", "stein", "El", "Casa", "piedra", "x2", "ñandú"]


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rnd = random.Random(7)
    long = "\n".join(sentence(rnd, 30) for _ in range(400))
    base = sentence(rnd, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", len(base)),
        (2, " ".join(near), "en", "a", len(base)),
        (3, base, "en", "b", len(base)),
        (4, None, None, None, None),
        (5, "", "fr", "", 0),
        (6, long, "fr", "a", len(long)),
        (7, "12 34 !!", "de", "b", 8),
        (7, "12 34 !!", "de", "b", 8),
        (None, sentence(rnd, 20), "de", None, 3),
        (None, None, None, "c", None),
        (8, "word", "es", "a", 4),
        (9, "a\nb\n" + base[:100] + "\n" + base[:100], "es", "a", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clean(spark):
    """Documents of distinct ids with distinct texts."""
    rnd = random.Random(3)
    rows = [(i, "\n".join(sentence(rnd, 25) + f" n{i}" for _ in range(3)), ["en", "fr", None][i % 3], f"s{i % 2}", 1) for i in range(40)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def sf_dir(spark, odd_rows, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(odd_rows, DOCS).write.parquet(f"{root}/documents.parquet")
    items = [(1, " ".join(odd_rows[0][1].split()[10:40])), (2, "word"), (3, None), (4, ""), (5, "nothing like it here at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)
