"""Search index: never loses a match, reads fewer files, extends itself."""

import pytest
from pyspark.sql import functions as F

from tidesync.operators.query import search
from tidesync.plans.search_index import SearchIndex, literal_runs, pieces_of
from tidesync.session import scratch_path

TEXTS = ["alpha beta", "Alpha GAMMA", "delta 100%", "a_b under", "snow\\man", "straße", "ΟΔΟΣ x", "İstanbul", None, "", "ab", "xyz" * 2000]


@pytest.fixture(scope="module")
def index(spark):
    root = scratch_path(spark, "search-test")
    i = SearchIndex(spark, f"{root}/t", "text", f"{root}/i")
    for n, t in enumerate(TEXTS):
        spark.createDataFrame([(n, t)], "id int, text string").coalesce(1).write.mode("append").parquet(i.folder)
    assert i.extend() == len(TEXTS)
    return i


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("term", ["alpha", "LPHA g", "100%", "a_b", "a\\_b", "al%ta", "al%zz", "ow\\\\m", "straß", "οδοσ", "ΟΔΟΣ",
                                  "istan", "ab", "", "%", "xyzxyz", "nothing here", "_____"])
def test_same_rows_as_the_scan(spark, index, term, literal):
    try:
        want = ids(search(spark.read.parquet(index.folder), "text", term, literal))
    except Exception as e:  # patterns Spark refuses are refused through the index too
        with pytest.raises(type(e)):
            ids(index.search(term, literal).rows)
        return
    assert ids(index.search(term, literal).rows) == want


def test_files_read(index):
    assert index.search("gamma").files_read == 1
    assert index.search("alpha").files_read == 2
    assert index.search("nothing here").files_read == 0
    assert index.search("al").files_read == index.search("").files_read == len(TEXTS)


def test_runs_and_pieces(spark):
    assert literal_runs("%ab\\%c_d%") == ["ab%c", "d"]
    assert pieces_of(spark, "ABcd%xy") == ["abc", "bcd"]


def test_new_files_are_read_then_indexed(spark):
    root = scratch_path(spark, "search-new")
    i = SearchIndex(spark, f"{root}/t", "text", f"{root}/i")

    def add(n, text):
        spark.createDataFrame([(n, text)], "id int, text string").coalesce(1).write.mode("append").parquet(i.folder)

    add(1, "one apple")
    assert ids(i.search("apple").rows) == [1]               # no index at all yet
    assert i.extend() == 1 and i.extend() == 0
    add(2, "two pears")
    assert (ids(i.search("pears").rows), i.search("pears").files_read) == ([2], 1)
    assert i.search("apple").files_read == 2                # the new file is not indexed
    assert i.extend() == 1
    assert i.search("apple").files_read == 1


def test_partitioned_table_and_pruned_columns(spark):
    root = scratch_path(spark, "search-part")
    i = SearchIndex(spark, f"{root}/t", "text", f"{root}/i")
    df = spark.range(40).select("id", F.concat(F.lit("word"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("text"), (F.col("id") % 4).alias("p"))
    df.write.partitionBy("p").parquet(i.folder)
    i.extend()
    found = i.search("word0007")
    assert [tuple(r) for r in found.rows.select("id", "p").collect()] == [(7, 3)]
    assert found.files_read < found.files_total


def test_names_that_need_escapes(spark):
    root = scratch_path(spark, "search-names")
    i = SearchIndex(spark, f"{root}/t x", "text", f"{root}/i")
    values = ["a b", "100%", "[x]{y}*", "c=d", "é"]
    df = spark.createDataFrame([(f"word {n}{n}{n}", v) for n, v in enumerate(values)], "text string, p string")
    df.write.partitionBy("p").parquet(i.folder)
    assert i.extend() == len(values) and i.extend() == 0
    for n, v in enumerate(values):
        found = i.search(f"{n}{n}{n}")
        assert [r["p"] for r in found.rows.collect()] == [v] and found.files_read == 1
