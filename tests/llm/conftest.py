import pytest

#: One table with the awkward cases: nulls in every column, empty and blank texts, ties and repeated rows, a very long text and a very long word.
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, row string, words string, score double, bucket int, taken long, n_lines string, ids string, kept string"
LONG = "very long text of many words. " * 8000


def edge_rows():
    tail = (1, "n", "r", "w", 0.5, 3, 9, "l", "i", "k")
    texts = [(None, None, None, None), (1, "", "en", "a"), (2, " \n\t\x0b ", "en", "a"), (3, "one", "de", None), (4, LONG, "en", "b"), (5, "x" * 20_000, None, "b"),
             (6, "same text here with some more words in it", "en", "a"), (6, "same text here with some more words in it", "en", "a"),
             (7, "same text here with some more words in it", "fr", "c"), (8, "Ünï çødé 😀 ﬁ ½ ٣ <|endoftext|> end", "fr", "c"), (9, "a\n" * 50, "es", "é"), (10, None, "en", "a")]
    return [(i, t, lang, source, None if t is None else len(t), *tail) for i, t, lang, source in texts]


def write(spark, folder, documents):
    documents.coalesce(2).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels = [(1, 1, 0), (3, 0, 1), (4, None, None), (6, 1, 0), (7, 1, 1), (99, 1, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    pages = [(1, "http://WWW.Example.com/en/a?x", "<p>"), (2, None, None), (3, "no scheme", ""), (4, "http://", "<p>"), (4, "http://", "<p>"), (None, "x://fr.net/fr/" + "y" * 50_000, "é" * 100_000), (5, "http://a.net/fr/é", "é" * 100_000)]
    items = [(1, "Some more words, in IT", "x"), (None, "", "x"), (3, None, None), (1, "Some more words, in IT", "y")]
    spark.createDataFrame(items, "item_id long, text string, doc_id string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    rows = spark.createDataFrame([(*p, "h", "v") for p in pages], "page_id long, url string, html string, host string, verdict string")
    rows.write.mode("overwrite").parquet(f"{folder}/pages.parquet")


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edge"))
    write(spark, folder, spark.createDataFrame(edge_rows(), EDGE_SCHEMA))
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", EDGE_SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return folder
