import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    at = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(at / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{at}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from {doc_id: text} or a list of (doc_id, text)."""

    def make(texts):
        pairs = texts.items() if isinstance(texts, dict) else texts
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """The sf0.01 documents, or a small sample of words where they are absent."""
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
