import threading

import pytest
from pyspark.sql import functions as F

from plumbline.sources import versions as V
from plumbline.store import fresh_path


def jobs(spark):
    return spark.createDataFrame([(1, "queued", 10), (2, "processing", 20), (3, None, 30)], "id int, status string, started_at int")


def states(table, version=None):
    return {r["id"]: r["status"] for r in table.read(version).collect()}


def test_versions_are_whole_and_stay(spark):
    table = V.Versions(spark, fresh_path(spark, "jobs with space"))
    assert table.newest() == 0
    assert V.update_columns(table, jobs(spark).limit(0), "id") is None  # nothing to update yet
    assert V.create(table, jobs(spark)) and not V.create(table, jobs(spark))
    new = spark.createDataFrame([(2, "failed", 21), (4, "queued", 40)], "id int, status string, started_at int")
    assert V.upsert(table, new, "id") == 2
    assert V.update_columns(table, new.filter("id = 4").select("id", F.lit("succeeded").alias("status")), "id") == 3
    assert states(table, 1) == {1: "queued", 2: "processing", 3: None}
    assert states(table, 2) == {1: "queued", 2: "failed", 3: None, 4: "queued"}
    assert states(table) == {1: "queued", 2: "failed", 3: None, 4: "succeeded"}
    table.forget(keep=1)
    assert table.newest() == 3 and len(states(table)) == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        table.read(1)


def test_claims_need_state_and_token(spark):
    table = V.Versions(spark, fresh_path(spark, "jobs"))
    assert not V.claim(table, 1, "queued", "processing")  # no table yet
    V.create(table, jobs(spark))
    assert V.claim(table, 1, "queued", "processing")
    assert not V.claim(table, 1, "queued", "processing")
    assert not V.claim(table, 2, "processing", "succeeded", F.lit(19))
    assert V.claim(table, 2, "processing", "succeeded", F.lit(20))
    assert states(table) == {1: "processing", 2: "succeeded", 3: None} and table.newest() == 3


def test_one_of_several_writers_wins_a_claim(spark):
    path = fresh_path(spark, "jobs")
    V.create(V.Versions(spark, path), jobs(spark))
    together, won = threading.Barrier(4), []

    class Late(V.Versions):
        """All writers read the same version before any of them writes."""

        def read(self, version=None):
            found = super().read(version)
            if not getattr(self, "met", False):
                self.met = True
                together.wait(60)
            return found

    def write(i):
        if V.claim(Late(spark, path), 1, "queued", f"worker {i}"):
            won.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = V.Versions(spark, path)
    assert len(won) == 1 and states(table)[1] == f"worker {won[0]}" and table.newest() == 2


def test_no_update_of_writers_at_once_is_lost(spark):
    path = fresh_path(spark, "jobs")
    V.create(V.Versions(spark, path), jobs(spark))
    row = lambda i: spark.createDataFrame([(10 + i, "queued", i)], "id int, status string, started_at int")
    rows = [row(i) for i in range(4)]
    threads = [threading.Thread(target=lambda i=i: V.upsert(V.Versions(spark, path), rows[i], "id")) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = V.Versions(spark, path)
    assert set(states(table)) == {1, 2, 3, 10, 11, 12, 13} and table.newest() == 5


def test_conflicts_end(spark):
    table = V.Versions(spark, fresh_path(spark, "jobs"))
    other = V.Versions(spark, table.path)
    V.create(table, jobs(spark))

    def make(old):
        V.upsert(other, jobs(spark), "id")  # someone is always faster
        return old

    with pytest.raises(V.Conflict):
        table.change(make, tries=2)
