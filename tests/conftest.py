import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tessera import MatrixFrame, VectorFrame  # noqa: E402
from tessera.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4, driver_memory="4g")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tessera-test-")


def vec(spark, values, length=None):
    rows = [(i, float(x)) for i, x in enumerate(values)]
    return VectorFrame(spark.createDataFrame(rows, "i long, x double"),
                       len(values) if length is None else length, unique=True)


def sparse_vec(spark, pairs, length):
    rows = [(int(i), float(x)) for i, x in pairs]
    return VectorFrame(spark.createDataFrame(rows, "i long, x double"), length)


def dense_values(v: VectorFrame):
    return [r.x for r in v.to_dense().df.orderBy("i").collect()]


def mat(spark, triples, n_rows=None, n_cols=None, symmetry="general"):
    return MatrixFrame.from_entries(spark, triples, n_rows, n_cols, symmetry)
