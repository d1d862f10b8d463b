import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text) pairs or texts as a documents table, with clashing extra columns if asked."""
    def make(rows, extra=()):
        rows = [(i, r) if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        schema = T.StructType(DOCS.fields + [T.StructField(c, T.StringType()) for c in extra])
        return spark.createDataFrame([(d, t, "en", "s", len(t) if t is not None else None, *["x"] * len(extra)) for d, t in rows], schema)

    return make


#: Nulls in id and text, empty and blank texts, repeated rows, a very long text, special white space and characters.
ODD = [(1, None), (None, "some words here"), (2, ""), (3, " \t\n"), (4, "one"), (5, "same text of five words\nand a second line of words"), (5, "same text of five words\nand a second line of words"),
       (6, "same text of five words\nand a second line of words"), (7, "long " * 30_000 + "end"), (8, "é ñ 　 a\x0bb\x0cc\r\nd 😀 <|endoftext|> it's")]
CLASH = ("key", "n", "word", "doc", "node", "label", "kept", "spans", "__text", "__quality", "line_no", "seed", "item", "host")
