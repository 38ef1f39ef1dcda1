"""Queries over documents whose texts are blank, short, padded, null or look like the frame around them."""

import duckdb
import oracle
import pytest

import __spark_entry__ as entry

TEXTS = ["", " ", "A", "É", "7", "+", "none", "View", "#a1b2", "true", None, " padded\n", " kept　", "\u001cx\u0085", "\x0bv\x0b", "end \n ", "<|a|>", "|>", "<|",
         'a"\n  [button] "go en"', '"\n  [article] "b', "x\\u0000\\", "\U0001f600", "from src1", "go en", "http://a.b", "plain text."]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("odd"))
    rows = [(at, text, ("en", "de", "fr", "es")[at % 4], f"src{at % 3}") for at, text in enumerate(TEXTS)]
    rows += [(100, "text", None, "src1"), (101, "text", "en", None), (102, "text", "en", " src "), (103, "text", "en", "")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    return sf, con


@pytest.mark.parametrize("name", ["n6_p7_tree_outline", "n6d_tree_nodes"])
def test_trees_of_odd_texts_equal_their_sql(spark, odd, name):
    sf, con = odd
    ok, note, _ = oracle.compare(spark, con, sf, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note
