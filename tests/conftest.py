import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(sf_dir):
    """Compares a DataFrame with a statement that DuckDB runs over the same tables."""
    import glob

    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")

    def compare(frame, sql):
        columns = sorted(frame.columns)
        tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
        own = sorted(repr([tidy(r[c]) for c in columns]) for r in frame.collect())
        found = connection.sql(sql)
        assert sorted(found.columns) == columns
        order = [found.columns.index(c) for c in columns]
        assert own == sorted(repr([tidy(r[i]) for i in order]) for r in found.fetchall())

    return compare
