import pytest

from weftgraph.session import session


@pytest.fixture(scope="session")
def spark():
    made = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
