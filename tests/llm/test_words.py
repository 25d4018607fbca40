"""Words are counted without a list of them."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm.common import n_words

TEXTS = [None, "", " ", "\n", "a", " a", "a ", "\ta\x0bb\x0c\r\nc ", " ", "　 x", "é ü", "\U0001f600 \U0001f600\U0001f601", "\x1c \x1f", "\x85 a", "$ \\ x", "x\n\n y\n", "\x00 \x00", "word " * 20000, " " * 9999 + "x" + " " * 9999]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_n_words(spark, text):
    got = spark.createDataFrame([(text,)], "text string").select(n_words(F.col("text"))).first()[0]
    assert got == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_n_words_holds_no_list(spark):
    df = spark.createDataFrame([("a b",)], "text string").select(n_words(F.col("text")).alias("n"))
    assert "extract_all" not in df._jdf.queryExecution().optimizedPlan().toString() and df.schema["n"].dataType.simpleString() == "bigint"
