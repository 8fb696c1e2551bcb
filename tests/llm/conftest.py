import pytest


@pytest.fixture(scope="session")
def put(spark, tmp_path_factory):
    """Write rows as a table of a folder of their own and give the folder."""
    from docspark.llm import frames

    frames.ship(spark)

    def write(rows, schema, name="documents", folder=None):
        folder = folder or tmp_path_factory.mktemp("tables")
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
