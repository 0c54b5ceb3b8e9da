import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (None, "alpha beta gamma", "en", "a", 1), (3, "alpha beta gamma", "en", "b", 1),
        (3, "alpha beta gamma", "en", "b", 1), (4, "we'll see <|endoftext|>  the end \n\n", "en", "b", 2), (5, "é " * 30000, "fr", "c", 3), (6, "é " * 30000, "fr", "c", 3),
        (7, "x" * 50000, None, "c", 3), (8, " \t\n", "de", "d", 3), (9, "数据 处理 🙂 ١٢٣", "en", "d", 3), (10, "\\<|im_end|>\\n", "en", "d", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "doc_id", "text", "lang", "source", "n_chars", "'clash' AS keep_id", "1 AS size", "'x' AS h", "2 AS kept"
    )


def thue_morse(n=1024):
    """Two different words of n letters that polynomial hashes with an odd base take for one."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))
