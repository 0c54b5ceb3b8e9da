"""Registered queries do the whole job: whole texts, whole tables."""
import pytest

from millrace import queries

SF = "/root/testdata/sf0.001"
ASKED = ("isalnum", "isalpha", "isnumeric", "islower", "isupper", "isspace")
LONG = ["abc" * 5000, "abc" * 5000 + " d", "abc" * 5000 + "1", "123" * 5000, "123" * 5000 + "x", " \t\n" * 5000, " \t\n" * 5000 + "x", "ABC" * 5000, "ABC" * 5000 + "d", "abc d, " * 5000, "abc d, " * 5000 + "E", "　\x1c abc \x85 ", ""]


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("where", ["tables", "long"])
def test_string_predicates_see_whole_texts(spark, long_texts, where):
    folder = SF if where == "tables" else long_texts
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["string_predicates_whole"](spark, folder).collect()
    assert {r.doc_id: [r[n] for n in ASKED] for r in got} == {d: [None if t is None else getattr(t, n)() for n in ASKED] for d, t in texts.items()}


@pytest.mark.parametrize("where", ["tables", "long"])
def test_strips_see_whole_texts(spark, long_texts, where):
    folder = SF if where == "tables" else long_texts
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.text is not None}
    got = {r.doc_id: r for r in queries.QUERIES["string_strip_whole"](spark, folder).filter("own IS NOT NULL").collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        w = "  \t" + t + "\n"
        assert (got[d].own, got[d].both, got[d].left_, got[d].right_) == (t.strip(), w.strip(), w.lstrip(), w.rstrip())


def test_sort_by_expression_gives_the_whole_table_in_order(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet").collect()
    got = queries.QUERIES["sort_by_expression_whole"](spark, SF).collect()
    assert [tuple(r) for r in got] == [(o, k) for k, o in sorted((r.o_totalprice + r.o_custkey, r.o_orderkey) for r in rows)]
