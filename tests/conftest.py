import pytest

from shelfspark.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_spark("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def column(spark):
    """Evaluate a column expression over a list of values."""
    def run(values, build, ddl="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
        return [r["o"] for r in df.select("i", build("v").alias("o")).orderBy("i").collect()]
    return run
