import pathlib
from types import SimpleNamespace

import pytest

from larder.sources import store as store_module
from larder.sources.store import storage_root, utc_now
from tests.conftest import tuples


def session(setting, master, folder=None):
    state = {"dir": folder}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: setting),
        sparkContext=SimpleNamespace(
            master=master,
            getCheckpointDir=lambda: state["dir"],
            setCheckpointDir=lambda d: state.update(dir=d),
        ),
    )


def test_root_is_the_session_setting():
    assert storage_root(session("s3a://shared/ck/", "yarn")) == "s3a://shared/ck"
    assert storage_root(session(None, "yarn", "hdfs:///set/by/user")) == "hdfs:///set/by/user"


def test_no_setting():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage_root(session(None, "yarn"))
    local = session(None, "local[4]")
    root = storage_root(local)
    assert storage_root(local) == root == local.sparkContext.getCheckpointDir()


def test_real_session(spark):
    assert storage_root(spark) == spark.conf.get("spark.checkpoint.dir", None)
    assert spark.sparkContext.getCheckpointDir()


def test_versions(spark, store):
    assert store.entries() == {}
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, s string")
    written = store.write({"a": a, "b": a.limit(1)})
    assert sorted((r["table"], r["rows"]) for r in written.collect()) == [("a", 2), ("b", 1)]
    first = store.entries()
    assert first["a"].bytes == 2 * 32 + 1
    store.write({"a": a.limit(0)})
    second = store.entries()
    assert (second["a"].rows, second["b"]) == (0, first["b"])
    assert second["a"].written_at > first["a"].written_at
    assert tuples(store.read("a")) == [] and tuples(store.read("b")) == [(1, "x")]


def test_files_are_cut_by_rows(spark, store, monkeypatch):
    monkeypatch.setattr(store_module, "ROWS_PER_FILE", 100)
    store.write({"a": spark.range(1000).coalesce(1)})
    assert len(store.read("a").inputFiles()) == 10 and store.entries()["a"].rows == 1000


def test_failed_write_changes_nothing(spark, store):
    good = spark.range(3)
    store.write({"a": good})
    before = store.entries()
    with pytest.raises(Exception, match="no luck"):
        store.write({"a": spark.range(5), "b": spark.range(5).selectExpr("raise_error('no luck') AS x")})
    assert store.entries() == before and store.read("a").count() == 3
    assert len(list(pathlib.Path(store.root, "data", "a").iterdir())) == 1


def test_staged_files_go(spark, store):
    path, rows = store.stage(spark.range(7))
    assert rows == 7 and spark.read.parquet(path).count() == 7
    store.discard(path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    store.write({"a": spark.range(2)})
    store.discard(store.entries()["a"].path)
    assert store.read("a").count() == 2
    assert store.delete_old(utc_now()) == 0
