from types import SimpleNamespace

import pytest

from twinlathe import storage


def _session(spark, folder, master="local[4]"):
    """The session with another shared folder."""
    context = SimpleNamespace(master=master, applicationId="app", _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: folder, set=lambda name, value: None), sparkContext=context)


def test_a_path_without_scheme_is_of_the_default_file_system(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.shared.link./kept", f"file://{tmp_path}")
    try:
        conf.set("fs.defaultFS", "viewfs://shared/")
        assert storage.shared_dir(_session(spark, "/kept")) == "viewfs://shared/kept/twinlathe-app"
        assert storage.shared_dir(_session(spark, f"file://{tmp_path}")) == f"file:{tmp_path}/twinlathe-app"
    finally:
        conf.set("fs.defaultFS", before)
    assert storage.shared_dir(_session(spark, str(tmp_path))) == f"file:{tmp_path}/twinlathe-app"


def test_a_cluster_needs_a_shared_folder_and_a_local_session_does_not(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(_session(spark, None, "spark://host:7077"))
    for master in ("local", "local[*]"):
        assert storage.shared_dir(_session(spark, None, master)).startswith("file:/")
