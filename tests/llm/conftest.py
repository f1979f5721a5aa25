import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame([(*r, *[None] * (len(schema.split(",")) - len(r))) for r in rows], schema)

    return make


#: Texts that every operator over documents must take: null, empty, white space, ties, repeated rows, long.
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One two three. Four five six seven eight."), (5, "One two three. Four five six seven eight."), (6, "a"), (6, "a"),
    (7, "éè \U0001f642 <|endoftext|> <|im_end|> \x0b\x0c x"), (8, "word " * 30_000), (None, "text of no document"), (9, "中文 İ " * 40),
]


@pytest.fixture(scope="session")
def edge(docs_of):
    return docs_of([(*r, "en", "s", len(r[1] or "")) for r in EDGES]).cache()


@pytest.fixture(scope="session")
def clash(edge):
    """Extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = "score kept size target taken removed removed_words fp component_id n_words key part word n media feature tokens".split()
    return edge.select("*", *[F.lit("clash").alias(n) for n in names])


@pytest.fixture(scope="session")
def some(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
