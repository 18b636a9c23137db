import pytest

from fleetvitals.llm.storage import show_package


@pytest.fixture(scope="session", autouse=True)
def package_for_workers(spark):
    show_package(spark)


# Dumps with every odd case: nulls, empty and blank contents, ties, repeated rows, a dump without id or cluster.
ODD = [
    (1, "c1", "10.0.0.1", "one two three four five six seven eight nine ten"),
    (2, "c1", "10.0.0.1", "one two three four five six seven eight nine ten"),
    (2, "c1", "10.0.0.1", "one two three four five six seven eight nine ten"),
    (3, "c1", None, ""),
    (4, None, "10.0.0.2", None),
    (5, None, None, " \t\n "),
    (6, "c2", "10.0.0.3", "Ünïcode ß 中文 words\u00a0here"),
    (None, "c2", "10.0.0.3", "one two three four five six seven eight nine ten"),
    (None, None, None, None),
    (7, "c2", "10.0.0.3", "solo"),
]
SCHEMA = "dump_id long, cluster_id string, node_ip string, content string"
# Names that operators use inside themselves.
CLASHING = [
    "id", "size", "digest", "row_key", "hub", "chunk", "n", "keep_id", "source", "site", "path", "evidence", "text", "dump",
    "ranges", "spans", "items", "u", "token", "tree", "page",
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    dumps = spark.createDataFrame(ODD, SCHEMA)
    return dumps.withColumns({c: F.lit(None).cast("int") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
