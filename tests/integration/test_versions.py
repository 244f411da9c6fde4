"""The versioned log: one of two writers wins, changed metadata is written, few files are read, stale holders are fenced."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import versions
from tidemark.streaming import ingest

SHAPE = "url string, content_hash string, metadata_hash string, n long"


def rows(spark, low, high, meta="m"):
    return spark.createDataFrame([(f"u{i}", f"h{i}", meta, i) for i in range(low, high)], SHAPE)


def test_log_writes_what_is_new_or_changed(spark, tmp_path):
    log = versions.Log(spark, str(tmp_path))
    assert log.read() is None and log.versions() == []
    assert log.append(rows(spark, 0, 50).union(rows(spark, 0, 10))) == versions.Commit(1, 50, 0, 0)
    assert log.append(rows(spark, 0, 50)).version == 1
    got = log.append(rows(spark, 45, 60).union(rows(spark, 3, 5, "other")))
    assert (got.version, got.new, got.changed) == (2, 10, 2)
    assert log.read(1).count() == 50 and log.read().count() == 62 and log.current().count() == 60
    assert {r.url for r in log.current().where("metadata_hash = 'other'").collect()} == {"u3", "u4"}
    nulls = spark.createDataFrame([(None, "h", None, 1), (None, "h", None, 1), ("u", None, None, 2)], SHAPE)
    assert log.append(nulls).new == 2 and log.append(nulls).new == 0
    assert log.append(rows(spark, 0, 0)).new == 0


def test_two_writers_one_wins_and_nothing_is_doubled(spark, tmp_path):
    one, two = versions.Log(spark, str(tmp_path)), versions.Log(spark, str(tmp_path))
    one.append(rows(spark, 0, 10))

    def cut_in(attempt):
        if attempt == 0:
            assert two.append(rows(spark, 8, 30)).version == 2

    got = one.append(rows(spark, 5, 40), meanwhile=cut_in)
    assert (got.version, got.new) == (3, 10)
    assert one.versions() == [1, 2, 3] and one.read().count() == 40 and one.current().count() == 40
    # what lost is not left behind
    assert sum(1 for _ in (tmp_path / "data").iterdir()) == 3 and not list((tmp_path / "aside").glob("[!.]*"))


def test_only_files_that_may_hold_a_key_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FILE_ROWS", 100)
    log = versions.Log(spark, str(tmp_path))
    for k in range(4):
        log.append(rows(spark, 1000 * k, 1000 * (k + 1)))
    files = spark.read.parquet(*[f"{tmp_path}/{m['stats']}" for m in log.manifests()])
    assert 36 <= files.count() <= 44 and files.agg(F.sum("rows")).first()[0] == 4000
    unseen = log.append(rows(spark, 9000, 9003))
    # three new keys, each in the range of a file of every commit: the filters leave next to none
    assert unseen.new == 3 and unseen.files_read <= 2
    seen = log.append(rows(spark, 2500, 2502, "later"))
    assert seen.changed == 2 and 1 <= seen.files_read <= 4
    # every stored key is found again, whatever file it is in
    assert log.append(rows(spark, 0, 4000).where("n not in (2500, 2501)")).version == seen.version


def test_a_stale_holder_cannot_commit(spark, tmp_path):
    log, now = versions.Log(spark, str(tmp_path)), datetime(2026, 9, 1, 8)
    first = log.acquire("one", now, 600)
    assert log.append(rows(spark, 0, 5), token=first).new == 5
    with pytest.raises(versions.Held):
        log.acquire("two", now + timedelta(seconds=599), 600)
    second = {}

    def expire(attempt):
        if attempt == 0:  # the first holder stalls between its write and its commit, beyond its time
            second["token"] = versions.Log(spark, str(tmp_path)).acquire("two", now + timedelta(seconds=601), 600)

    with pytest.raises(versions.Fenced):
        log.append(rows(spark, 5, 9), token=first, meanwhile=expire)
    assert log.read().count() == 5 and second["token"] > first
    assert log.append(rows(spark, 5, 9), token=second["token"]).new == 4
    log.release(first)
    with pytest.raises(versions.Held):
        log.acquire("three", now + timedelta(seconds=700), 600)
    log.release(second["token"])
    assert log.acquire("three", now + timedelta(seconds=700), 600) > second["token"]


def test_a_stream_into_the_log(spark, tmp_path):
    source, log = str(tmp_path / "in"), versions.Log(spark, str(tmp_path / "log"))
    rows(spark, 0, 20).write.parquet(source)
    for n, (low, high) in enumerate([(0, 0), (15, 30), (0, 0)]):
        rows(spark, low, high).write.mode("append").parquet(source)
        # a checkpoint that was lost replays everything
        versions.follow(log, ingest.follow(spark, source, SHAPE), str(tmp_path / f"c{n % 2}")).awaitTermination()
    assert log.current().count() == 30 and log.read().count() == 30
