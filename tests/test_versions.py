"""Writers that race for a version, and readers meanwhile."""

import threading
import time

import pytest

from quillspan.operators import versions


def test_one_of_two_writers_wins_and_the_other_retries(spark, tmp_path):
    store = versions.VersionedTable(spark, str(tmp_path / "t"))
    assert store.version() == 0
    store.change(lambda _: spark.range(1))
    both, tried, seen, stop, errors = threading.Barrier(2), [], [], threading.Event(), []

    def writer(n):
        def more(old):
            tried.append(n)
            if tried.count(n) == 1:
                both.wait()  # both have read version 1
            return old.union(spark.range(n, n + 1))

        store.change(more)

    def reader():
        mine = versions.VersionedTable(spark, store.root)
        while not stop.is_set():
            try:
                seen.append(sorted(r.id for r in mine.read().collect()))
            except Exception as e:  # noqa: BLE001
                errors.append(e)
            time.sleep(0.05)

    threads = [threading.Thread(target=writer, args=(n,)) for n in (10, 20)]
    watch = threading.Thread(target=reader)
    for t in (watch, *threads):
        t.start()
    for t in threads:
        t.join()
    stop.set()
    watch.join()
    assert store.version() == 3 and sorted(r.id for r in store.read().collect()) == [0, 10, 20]
    assert len(tried) == 3 and not errors and all(x[0] == 0 for x in seen)
    # nothing of the lost attempt is left
    assert len(list((tmp_path / "t" / "data").iterdir())) == 3
    assert store.vacuum(keep=1) == 2 and sorted(r.id for r in store.read().collect()) == [0, 10, 20]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_a_prune_of_an_older_version_is_refused(spark, tmp_path):
    store = versions.VersionedTable(spark, str(tmp_path / "t"))
    seen = store.change(lambda _: spark.range(6))
    store.change(lambda old: old.union(spark.range(6, 8)))
    with pytest.raises(versions.Lost):
        versions.prune(store, seen, lambda df: df.where("id % 2 = 0"))
    assert versions.prune(store, store.version(), lambda df: df.where("id % 2 = 0")) == 3
    assert sorted(r.id for r in store.read().collect()) == [0, 2, 4, 6] and store.note(3)["pruned"]
    assert store.read(1).count() == 6


def test_put_once(spark, tmp_path):
    path = str(tmp_path / "a" / "b")
    wins = []
    threads = [threading.Thread(target=lambda k=k: wins.append(versions.put_once(spark, path, b"%d" % k))) for k in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert wins.count(True) == 1 and len(list((tmp_path / "a").iterdir())) == 1
