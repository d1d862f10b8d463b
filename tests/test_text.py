from pyspark.sql import functions as F

from unionlake.functions import text as tx


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v STRING").select(expr(F.col("v")).alias("x")).first()["x"]


def test_normalize_cell_rules(spark):
    assert one(spark, tx.normalize_cell, "Hello World 42!") == "hello_world_@@*"
    assert one(spark, tx.normalize_cell, "a€b@c") == "a*b*c"
    assert one(spark, tx.normalize_cell, "tab\there") == "tabhere"  # tab is not a valid char
    assert one(spark, tx.normalize_cell, "é_ü") == ""  # only ASCII letters, '_' is not valid either
    assert one(spark, tx.normalize_cell_wildcards, "Price: 4,50 €") == "price:_4,50_€"


def test_header_code_round_trip(spark):
    enc = one(spark, tx.encode_header, "Name 1")
    assert all(ord(ch) >= 0xC0 for ch in enc)
    assert one(spark, lambda c: tx.decode_header(tx.encode_header(c)), "Name 1") == "name_@"
    assert one(spark, lambda c: tx.encode_header(c, True), "a€") == one(spark, lambda c: tx.encode_header(c, True), "a")


def test_prefixed_terms(spark):
    assert one(spark, tx.encode_prefixed_term, "d#Foo Bar") == "foo_bar"
    assert one(spark, tx.encode_prefixed_term, "x#foo") is None
    assert one(spark, tx.encode_prefixed_term, "h#ab") == one(spark, lambda c: tx.encode_header(c, True), "ab")


def test_ngrams(spark):
    assert one(spark, tx.subword_ngrams, "ab") == ["<ab", "ab>", "<ab>"]
    assert one(spark, tx.subword_ngrams, "") == []
    g = one(spark, tx.subword_ngrams, "abcdefgh")
    assert len(g) == sum(10 - n + 1 for n in range(3, 8))


def test_null_token_and_tokenize(spark):
    assert one(spark, tx.null_token, None) == "_"
    assert one(spark, tx.null_token, "") == "_"
    assert one(spark, tx.tokenize_cell, "  ") == ["-"]
    assert one(spark, tx.tokenize_cell, "Foo, bar-42") == ["foo", "bar", "42"]
    assert len(one(spark, tx.tokenize_cell, " ".join(["w"] * 50))) == 30
