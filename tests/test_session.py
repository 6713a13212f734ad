from pathlib import Path

from rillstone import session


class Conf:
    """A session that names a shared folder, or none."""

    def __init__(self, there):
        self.conf = {"spark.checkpoint.dir": there}


def test_scratch_tables_stay_until_swept(spark):
    session.sweep(spark)
    df = session.materialise(spark.range(5), "five")
    path = Path(session._SCRATCH[-1].removeprefix("file://"))
    assert df.count() == 5 and path.exists() and str(path).startswith(session.shared_dir(spark).removeprefix("file://"))
    assert session.sweep(spark) == 1 and not path.exists() and session.sweep(spark) == 0


def test_the_session_names_the_shared_folder():
    assert session.shared_dir(Conf("hdfs://n/shared/")) == "hdfs://n/shared"
    own = session.shared_dir(Conf(None))
    assert own == session.shared_dir(Conf("")) and Path(own.removeprefix("file://")).is_dir()
