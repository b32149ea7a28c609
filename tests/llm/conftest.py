import pytest


@pytest.fixture(scope="session", autouse=True)
def checkpoint_folder(spark, tmp_path_factory):
    """Local mode: every folder is shared."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
