import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import session

    warehouse = tmp_path_factory.mktemp("warehouse")
    spark = session("local[4]", **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(warehouse), "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
