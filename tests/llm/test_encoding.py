import pytest
from pyspark.sql import functions as F

from maillake.llm import encoding as E

TEXTS = [
    "Hello, it's 2001!  Two  spaces\n\n\tand more  wide ", "", None, "   ", "\n", "naïve Übergröße 東京 🙂🙂 ​zero", "<|endoftext|> is text", "don't we'll I'VE", "x" * 5000, "a\r\nb", "Hello, it's 2001!  Two  spaces\n\n\tand more  wide ", "é \x00\x1f",
]


def want(texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("frequent", [E.FREQUENT_WORDS, 3, 0])
def test_ids_and_round_trip(spark, frequent):
    df = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(TEXTS)], "doc_id int, text string, ids string").repartition(3)
    out = E.encode(df, "text", frequent=frequent)
    assert out.columns == ["doc_id", "text", "ids"]
    rows = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert [rows[k] for k in range(len(TEXTS))] == want(TEXTS)
    back = {r["doc_id"]: r["decoded"] for r in E.decode(out).collect()}
    assert [back[k] for k in range(len(TEXTS))] == [t or "" for t in TEXTS]


def test_word_table_has_each_word_once(spark):
    df = spark.createDataFrame([("a b a",), ("b",), (None,)], "text string")
    assert {r["word"]: r["n"] for r in E.word_table(df, "text").collect()} == {"a": 1, " b": 1, " a": 1, "b": 1}


def test_empty_table_nulls_and_unknown_ids(spark):
    assert E.encode(spark.createDataFrame([], "doc_id int, text string"), "text").count() == 0
    df = spark.createDataFrame([(1, None), (2, []), (3, [39, 99_999])], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] for r in E.decode(df).collect()} == {1: None, 2: "", 3: "H"}
