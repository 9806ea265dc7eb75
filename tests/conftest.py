import pytest
from pyspark.sql import SparkSession

from rookery.session import ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples; arrays and structs become tuples."""

    def plain(v):
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return v

    def take(df, *columns):
        own = df.select(*columns) if columns else df
        return sorted((tuple(plain(v) for v in r) for r in own.collect()), key=repr)

    return take
