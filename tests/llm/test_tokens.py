import random

import pytest

from stemma.llm import tokens as T

DIR = T.TOKENIZER_DIR
ODD = [
    "a" * 5_000, " " * 3_000, "x" + " " * 999 + "y'll don't 'tis " * 200, None, "", "  \n\n \t" * 400, "don't" * 900, "<|endoftext|> " * 300, "漢字かな🙂" * 700, "é" * 300 + "́" * 300,
    "".join(random.Random(1).choice("ab '\n12.,!ll é漢🙂 ") for _ in range(6_000)),
]


def whole(text):
    return T.encoding("byte_bpe_50k", DIR).encode_ordinary(text or "")


@pytest.mark.parametrize("chunk, overlap", [(65_536, 1_024), (100, 16), (1_000, 40)])
def test_same_ids_as_in_one_go(spark, chunk, overlap):
    rows = [*enumerate(ODD), (0, ODD[0]), (0, "b " * 800), (None, "b " * 800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, list(r["ids"])) for r in T.encode(df, "doc_id", "text", chunk=chunk, overlap=overlap).collect())
    assert got == sorted((k is None, k or 0, whole(t)) for k, t in rows)


def test_ids_are_those_of_the_public_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ODD:
        assert t.encode(text or "", add_special_tokens=False).ids == whole(text)


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in T.decode(T.encode(df, "doc_id", "text", chunk=200, overlap=20), "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in T.decode(nulls, "doc_id").collect()} == {1: None, 2: ""}


def test_lengths_and_empty_table(spark):
    df = spark.createDataFrame([(1, "s", "a b c"), (2, None, None)], "doc_id long, source string, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in T.lengths(df, ["doc_id", "source"], "text").collect()} == {1: 3, 2: 0}
    assert T.encode(df.filter("false"), "doc_id", "text").count() == 0


def test_cuts_are_common_and_never_after_blanks():
    text = "one two  three'll \n four"
    found = T.boundaries(text, T._pattern(DIR))
    assert found and all(not text[b - 1].isspace() for b in found)


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        T.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text", chunk=10, overlap=10)
