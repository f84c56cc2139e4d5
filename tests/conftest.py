import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def oracle():
    """Rows of a SQL text over the tables of a folder, sorted, by DuckDB; and a comparison with a DataFrame's."""
    import glob

    import duckdb

    def rows(sql: str, folder: str, columns: list[str]):
        con = duckdb.connect()
        for path in glob.glob(f"{folder}/*.parquet"):
            name = os.path.basename(path).removesuffix(".parquet")
            source = path if os.path.isfile(path) else f"{path}/*.parquet"
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
        found = con.execute(f"SELECT {', '.join(columns)} FROM ({sql.strip().rstrip(';')})").fetchall()
        return sorted(found, key=repr)

    return rows
