"""What the operators share: scratch space, batches and turns."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from tarnwell.llm import common


def session(master, setting=None, folder=None):
    context = SimpleNamespace(master=master, folder=folder)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda path: setattr(context, "folder", path)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: setting))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://x"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(session(master))
    assert common.scratch(session(master, "s3a://b/shared")) == "s3a://b/shared"
    assert common.scratch(session(master, folder="hdfs:/own")) == "hdfs:/own"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_a_local_session_gets_a_folder_once(master):
    local = session(master)
    assert common.scratch(local) == common.scratch(local)
    assert "tarnwell-" in common.scratch(local)


def test_turns_hold_every_text_once_and_not_much_more_than_asked():
    texts = ["a" * n for n in (0, 5, 3, 100, 1, 1, 1)] + [None, "", "b" * 7]
    for most in (1, 4, 10, 10_000):
        turns = list(common.in_turns(texts, most))
        assert [t for turn in turns for t in texts[turn]] == texts
        assert all(sum(len(t or "") + 1 for t in texts[turn][:-1]) < most for turn in turns)
    assert list(common.in_turns([], 5)) == []


def test_batches_are_small_unless_the_session_says_otherwise(spark, settings):
    docs = spark.range(1)
    spark.conf.unset(common.BATCH_BYTES)
    assert common.in_small_batches(docs) is docs
    assert spark.conf.get(common.BATCH_BYTES) == str(common.BATCH)
    settings(common.BATCH_BYTES, "123456")
    common.in_small_batches(docs)
    assert spark.conf.get(common.BATCH_BYTES) == "123456"


def test_only_a_large_table_is_sampled_and_alike_each_time(spark):
    rows = spark.range(5000)
    assert common.hash_sample(rows, "id", 5000, seed=1).count() == 5000
    first = {r.id for r in common.hash_sample(rows, "id", 500, seed=1).collect()}
    assert 350 < len(first) < 650 and first == {r.id for r in common.hash_sample(rows, "id", 500, seed=1).collect()}
