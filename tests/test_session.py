"""Lineage cuts go where the session says."""

from cohortis import session


class Named:
    """A session whose settings name a checkpoint folder."""

    def __init__(self, spark, folder):
        self.sparkContext, self._folder = spark.sparkContext, folder

    @property
    def conf(self):
        return self

    def get(self, key, default=None):
        return self._folder if key == "spark.checkpoint.dir" else default


def test_cut_uses_the_named_folder(spark, tmp_path):
    folder = str(tmp_path / "shared")
    session._checkpoint_dir(Named(spark, folder))
    first = spark.sparkContext.getCheckpointDir()
    assert folder in first
    session._checkpoint_dir(Named(spark, folder))
    assert spark.sparkContext.getCheckpointDir() == first
    # Back under the session's own settings, the cut goes where they say.
    assert session.cut(spark.range(5)).count() == 5
    own = spark.conf.get("spark.checkpoint.dir", None)
    assert (own or folder) in spark.sparkContext.getCheckpointDir()


def test_without_a_folder_results_are_kept(monkeypatch, spark):
    monkeypatch.setattr(session, "_checkpoint_dir", lambda _: False)
    df = session.cut(spark.range(5))
    assert df.is_cached and df.count() == 5
    df.unpersist()
