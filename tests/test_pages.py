"""The paged data source over landed pages: ends, quotas, filters, batches of keys, restarts."""

import json

import pytest

from quillspan.sources import pages


def lookups(options):
    """A service that answers keys; each batch's size is part of its answers."""
    return lambda keys: [{"key": k, "of": len(keys)} for k in keys if k % 7]


def counted(options):
    """landed(), noting each question in a file."""
    fetch = pages.landed(options)

    def ask(source, page):
        with open(f"{options['folder']}/asked", "a") as f:
            f.write(f"{source} {page}\n")
        return fetch(source, page)

    return ask


def land(folder, source, *sizes, total=None):
    (folder / source).mkdir(exist_ok=True)
    have = len(list((folder / source).iterdir()))
    for k, n in enumerate(sizes, have + 1):
        body = {"items": [{"id": f"{source}{k}{i}"} for i in range(n)]} | ({} if total is None else {"pages": total})
        (folder / source / f"{k}.json").write_text(json.dumps(body))


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(pages.PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    land(tmp_path, "a", 3, 2, 0, 5)
    land(tmp_path, "b", 2, 2, 2, total=2)
    land(tmp_path, "c", 4, 4, 4)
    return tmp_path


def load(spark, folder, service="quillspan.sources.pages:landed", **options):
    reader = spark.read.format("quillspan_pages").option("service", service).option("folder", str(folder)).option("sources", '["a", "b", "c", "d"]')
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def got(df):
    return {k: sorted((r.page, r.place) for r in df.collect() if r.source == k) for k in "abcd"}


def test_pages_until_empty_total_or_quota(spark, folder):
    all_of = lambda *sizes: [(p, i) for p, n in enumerate(sizes, 1) for i in range(n)]
    assert got(load(spark, folder)) == {"a": all_of(3, 2), "b": all_of(2, 2), "c": all_of(4, 4, 4), "d": []}
    assert got(load(spark, folder, quota=4)) == {"a": all_of(3, 2), "b": all_of(2, 2), "c": all_of(4), "d": []}
    each = load(spark, folder, pages=2)
    assert each.rdd.getNumPartitions() == 8 and got(each) == {"a": all_of(3, 2), "b": all_of(2, 2), "c": all_of(4, 4), "d": []}
    assert json.loads(load(spark, folder).where("source = 'a'").orderBy("page", "place").first().item) == {"id": "a10"}


def test_filters_reach_the_service(spark, folder):
    rows = load(spark, folder, service="tests.test_pages:counted").where("source IN ('a', 'c') AND page < 3")
    assert rows.count() == 13
    assert sorted(set((folder / "asked").read_text().splitlines())) == ["a 1", "a 2", "c 1", "c 2"]


def test_batches_of_keys(spark, folder):
    df = load(spark, folder, service="tests.test_pages:lookups", keys=json.dumps([*range(1100), 5, 6]), batch=10_000)
    rows = [json.loads(r.item) for r in df.collect()]
    assert df.rdd.getNumPartitions() == 3 and sorted(r["key"] for r in rows) == [k for k in range(1100) if k % 7]
    assert {r["of"] for r in rows} == {500, 100}


def test_a_stream_goes_on_where_it_stopped(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")

    def run():
        stream = spark.readStream.format("quillspan_pages").option("service", "tests.test_pages:counted").option("folder", str(folder)).option("sources", '["a", "c"]').load()
        q = stream.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "offsets")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        rows = spark.read.parquet(str(out / "rows")).collect()
        assert len({(r.source, r.page, r.place) for r in rows}) == len(rows)
        return len(rows)

    assert run() == 17
    land(folder, "c", 1, 6)
    (folder / "asked").unlink()
    assert run() == 24
    asked = (folder / "asked").read_text().splitlines()
    assert "c 4" in asked and "c 5" in asked
