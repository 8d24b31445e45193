import os
import sys

import pytest
from pyspark import cloudpickle

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vellum import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session.session("vellum-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    # Converters defined in a test travel with the task that uses them.
    for name in ("test_runs",):
        if name in sys.modules:
            cloudpickle.register_pickle_by_value(sys.modules[name])
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def value(spark):
    """The values of a column expression over rows of the given columns."""
    def run(rows, schema, column):
        numbered = [(i, *r) for i, r in enumerate(rows)]
        frame = spark.createDataFrame(numbered, "i int, " + schema)
        return [r["v"] for r in frame.select("i", column.alias("v")).orderBy("i").collect()]
    return run
