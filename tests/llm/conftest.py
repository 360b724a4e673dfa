import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark, tmp_path_factory, docs_schema):
    """A written table of documents from (doc_id, text, source) rows, with extra columns whose names clash."""

    def make(rows):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        full = [(i, t, "en", s, len(t or ""), 7, "x", 3) for i, t, s in rows]
        schema = docs_schema + ", kept int, size string, key int"
        spark.createDataFrame(full, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make
