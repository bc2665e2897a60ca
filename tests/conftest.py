import pytest

from tests.session import session


@pytest.fixture(scope="session")
def spark():
    spark = session(8)
    spark.conf.set("spark.sql.shuffle.partitions", "4")  # tiny inputs
    return spark


@pytest.fixture()
def many_blocks(spark):
    """Keep every range partition, so that small test groups are really cut into several blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
