import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.llm.registry import prepare

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def ready(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table of documents from (doc_id, text, source)."""

    def make(rows, extra=False):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:  # names that the operators use inside
            for name in ("id", "row", "size", "key", "ra", "rb", "h", "times", "copy", "found", "new", "line", "site", "u", "other"):
                df = df.withColumn(name, df.doc_id)
        return df

    return make
