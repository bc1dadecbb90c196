import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def benchmark_items(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


# a row of every awkward kind, with columns whose names clash with the operators' own
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a", 1),
    (2, None, "en", None, None),
    (3, "", "de", "b", 0),
    (4, " \n\t ", None, "b", 4),
    (5, "12345 !!! 678", "en", "c", 13),
    (None, "Ein Satz ohne Nummer, der hier steht und sonst nirgends vorkommt.", "de", "c", 5),
    (6, "wort " * 60000, "de", "d", 300000),
    (7, "x" * 50000, None, "d", 50000),
    (8, "The quick brown fox jumps over the lazy dog. " * 3, "en", "e", 1),
    (9, "日本語 Ünïcödé <|endoftext|>   \x1c ΑΣ", "en", "f", 9),
    (10, None, None, None, None),
    (10, "zweite Zeile der zehn", "de", None, None),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rid int, key int, hi int, spans int, n_words_removed int, score int, shard int, component_id int, rank int, sketch int"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(*r, *range(10)) for r in AWKWARD], COLUMNS).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
