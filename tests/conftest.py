import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillon.session import session

    s = session("tests", "local[4]", **{"spark_ui_enabled": "false", "spark_ui_showConsoleProgress": "false", "spark_sql_shuffle_partitions": "4", "spark_sql_maxMetadataStringLength": "2000", "spark_driver_memory": "3g", "spark_local_dir": tempfile.mkdtemp()})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF

