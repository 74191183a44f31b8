from types import SimpleNamespace

import pytest

from noteglass import session


def context(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_the_folder_of_the_session_is_used():
    assert session.checkpoint_folder(context("spark://host:7077", "hdfs:/shared/")) == "hdfs:/shared"


def test_a_local_folder_only_on_one_machine():
    own = context("local[2]")
    assert session.checkpoint_folder(own) == session.checkpoint_folder(own) != ""
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(context("spark://host:7077"))


def test_materialised_tables_are_equal(spark):
    rows = session.materialise(spark.range(5), "numbers")
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2, 3, 4]
