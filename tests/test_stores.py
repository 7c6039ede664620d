"""Files, stores, steps and resolution by hand."""

import json
import os
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import text
from quillspan.operators import audit, match, metrics, publish, select, state
from quillspan.sources import io


def test_json_lines_written_sorted_and_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(2, "b"), (1, None), (1, "a")], "n int, t string")
    io.write_json_lines(df, path)
    schema = df.schema
    io.write_sorted(io.json_rows(spark, path, schema), path, "n")  # reads what it replaces
    lines = [x for f in sorted((tmp_path / "log").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == ['{"n":1,"t":"a"}', '{"n":1,"t":null}', '{"n":2,"t":"b"}']
    io.append_json_lines(df.limit(1), path)
    assert io.json_lines(spark, path, schema).count() == 4
    assert io.json_lines(spark, str(tmp_path / "none"), schema).count() == 0


def test_vector_files(spark, tmp_path):
    v = np.arange(12, dtype="<f2").reshape(3, 4)
    (tmp_path / "v.bin").write_bytes(v.tobytes())
    rows = io.vector_file(spark, str(tmp_path / "v.bin"), 4).orderBy("row").collect()
    assert [list(r.vector) for r in rows] == v.tolist()
    with pytest.raises(ValueError):
        io.vector_file(spark, str(tmp_path / "v.bin"), 5)
    odd = spark.createDataFrame([(b"\x00",), (np.array([np.inf], "<f2").tobytes(),), (None,), (b"",)], "b binary").select(io.decode_half("b").alias("v")).collect()
    assert [r.v for r in odd] == [None, None, None, []]
    big = spark.createDataFrame([([1.0, 1e9],), ([1.0, None],), ([0.1],)], "v array<double>").select(io.encode_half("v").alias("b")).collect()
    assert [r.b and bytes(r.b) for r in big] == [None, None, np.array([0.1], "<f2").tobytes()]


def test_pickles_hold_plain_things_only(spark):
    names, palettes = pickle.dumps([["sea", "green"], "x", " "]), pickle.dumps([np.full((6, 3), 0.5), [[1, 2, 3]] * 4, np.ones((5, 3))])
    pairs = io.pickled_palettes(names, palettes)
    rows = io.palette_rows(spark.createDataFrame(pairs, "phrase string, colors array<array<double>>")).collect()
    assert [(r.phrase, r.rgb) for r in rows] == [("sea green", [[128] * 3] * 5)]

    class Bad:
        def __reduce__(self):
            return (print, ("no",))

    with pytest.raises(pickle.UnpicklingError):
        io.pickled_palettes(pickle.dumps([Bad()]), palettes)


def test_documents_and_swaps(spark, tmp_path):
    path = str(tmp_path / "m.json")
    publish.write_document(spark, path, {"b": 1, "a": "é"})
    publish.write_document(spark, path, {"a": 2})
    assert publish.read_document(spark, path) == {"a": 2}
    for k in range(2):
        (tmp_path / "new").mkdir()
        (tmp_path / "new" / "f").write_text(str(k))
        publish.swapped_in(spark, str(tmp_path / "new"), str(tmp_path / "target"))
        assert (tmp_path / "target" / "f").read_text() == str(k)
    with pytest.raises(OSError):
        publish.swapped_in(spark, str(tmp_path / "absent"), str(tmp_path / "target"))
    assert (tmp_path / "target" / "f").read_text() == "1"


def test_bundle_version_follows_contents_only(spark, tmp_path):
    df = spark.createDataFrame([(i, f"x{i}") for i in range(50)], "id int, t string")
    one = publish.write_bundle({"items": df}, "id", str(tmp_path / "a"))
    two = publish.write_bundle({"items": df.repartition(5)}, "id", str(tmp_path / "b"))
    other = publish.write_bundle({"items": df.withColumn("t", F.upper("t"))}, "id", str(tmp_path / "a"))
    assert one == two and one["version"] != other["version"] and spark.read.parquet(str(tmp_path / "a/items")).where("t = 'X3'").count() == 1
    with pytest.raises(ValueError):
        publish.write_bundle({"items": df}, "id", str(tmp_path / "a"), df.limit(1))
    with pytest.raises(ValueError):
        publish.write_rooms(spark.createDataFrame([("c", "x"), ("c", "y")], "code string, text string"), str(tmp_path / "r"))


def test_steps_run_what_is_not_current():
    log, config = [], {"n": 1}
    step = lambda name, state_, *needs: state.Step(name, "go", state_, lambda: log.append(name), needs)
    steps = [step("a", lambda: {"inputs": {"f": "1"}}), step("b", lambda: {"config": dict(config)}, "a"), step("c", lambda: {"inputs": {"gone": None}}, "b")]
    stamps = state.Stamps()
    assert [n for n, why in state.dry_run(steps, stamps, "go") if why] == ["a", "b", "c"]
    state.run_steps(steps, stamps, "go")
    assert state.run_steps(steps, stamps, "go") == [("a", "up to date"), ("b", "up to date"), ("c", "done")]
    config["n"] = 2
    assert state.dry_run(steps, stamps, "go")[1:] == [("b", ["config.n changed"]), ("c", ["missing inputs.gone", "b will run"])]
    assert state.dry_run(steps, stamps, "other") == [] and log == ["a", "b", "c", "c"]
    assert json.loads(state.provenance(stamps, {"spark": "4"}, {"seed": 1}))["steps"]["a"] == {"inputs": {"f": "1"}}


def test_projection_and_prune_refuse(spark):
    records = spark.createDataFrame([("a", 1)], "key string, ordinal long")
    with pytest.raises(RuntimeError):
        state.projected(records, spark.createDataFrame([("a",), ("b",)], "key string"))
    seen = state.table_digest(records)
    assert seen == state.table_digest(records.repartition(3))
    with pytest.raises(RuntimeError):
        state.pruned(records.withColumn("ordinal", F.lit(2)), seen, records)


def test_preferred_track_cascade(spark):
    m = "id long, tid long, exact boolean, album string, record_type string, album_artist string, release_date string, readable boolean, preview boolean"
    rows = [(1, 10, True, "Best Of", "compile", "A", "1990", True, True), (1, 11, False, "Steel (Deluxe Edition)", "album", "A", "2001", True, True), (1, 12, True, "Steel", "album", "A", "2000", False, True), (1, 13, True, "One", "single", "A", "1980", True, True),
            (2, 20, True, "Hits", "album", "B", "1970", True, True), (2, 21, True, "Studio", "album", "B", None, True, True), (2, 22, False, "Other", "album", "B", "1999", True, True), (2, 23, True, "Single", "single", "B", "1960", True, True),
            (3, 30, True, "Greatest Hits", "compile", "C", "1970", True, True), (3, 31, True, "Live at Home", "album", "C", "1970", True, True), (3, 32, False, "", "", "C", "1990", True, True)]
    g = "id long, gid long, gtitle string, release_titles array<string>, primary string, secondary array<string>, date string"
    groups = [(1, 1, "One", None, "Single", [], "1979"), (1, 2, "The Steel", None, "Album", [], "2000"), (1, 3, "Best Of", None, "Album", ["Compilation"], "1970"), (2, 4, "Absent", None, "Single", [], "1960"), (3, 5, "Nothing", None, "Album", [], "1990")]
    all_ = spark.createDataFrame(rows, m)
    got = {r.id: (r.tid, r.tier) for r in match.preferred_tracks(all_.select("id", "tid", "exact"), all_.drop("id", "exact"), spark.createDataFrame(groups, g)).collect()}
    assert got == {1: (11, 1), 2: (22, 2), 3: (32, 3)}


def test_chance_of_a_rise_is_exact(spark):
    import math

    rng = random.Random(2)
    rows = [(40, 40, 3, 0), (40, 40, 0, 0), (5, 3, 5, 3), (1, 1, 1, 0)] + [(n, m, rng.randint(0, n), rng.randint(0, m)) for n, m in ((rng.randint(1, 60), rng.randint(1, 60)) for _ in range(60))]
    got = [r.p for r in spark.createDataFrame(rows, "n long, m long, a long, b long").coalesce(1).select(audit.rise_by_chance("n", "m", "a", "b").alias("p")).collect()]
    for (n, m, a, b), p in zip(rows, got, strict=True):
        t = a + b
        want = sum(math.comb(n, k) * math.comb(m, t - k) for k in range(a, min(n, t) + 1)) / math.comb(n + m, t)
        assert abs(p - want) < 1e-9
    assert abs(got[0] - 0.1203) < 1e-4


def test_shared_ranks_and_places(spark):
    rng = random.Random(7)
    x, y = [rng.randint(0, 20) / 2 for _ in range(300)], [rng.random() for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(zip(x, y, strict=True))), "i int, p struct<x: double, y: double>").select("i", "p.x", "p.y")
    ranks = {r.x: r.k for r in metrics.shared_ranks(df, "x", "k").collect()}
    for v in set(x):
        assert ranks[v] == sum(u < v for u in x) + (sum(u == v for u in x) + 1) / 2
    rank = lambda s: np.array([sum(u < v for u in s) + (sum(u == v for u in s) + 1) / 2 for v in s])
    assert abs(metrics.spearman(df, "x", "y").first().rho - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-9
    assert [r.k for r in metrics.ordinal(df, "i", "k").orderBy("i").collect()] == list(range(1, 301))
    odd = df.withColumn("g", F.lit(1)).withColumn("y", F.when(F.col("i") == 5, float("nan")).otherwise(F.col("y")))
    r = metrics.objective(odd, "g", "x", "y").first()
    assert r.objective == float("-inf") and np.isnan(r.auc)


def test_ship_gate_reasons(spark):
    gate = lambda *x: tuple(spark.range(1).select(metrics.ship_gate(*[None if v is None else F.lit(v) for v in x]).alias("g")).first().g)
    assert gate(0.6, 0.5) == (True, "") and gate(0.54, 0.5) == (False, "lead") and gate(float("nan"), 0.5) == (False, "lead")
    assert gate(0.6, 0.5, 0.6, 0.605) == (True, "") and gate(0.6, 0.5, 0.6, 0.62) == (False, "installed") and gate(0.5, 0.5, float("nan"), 0.1) == (False, "lead,installed")


def test_titles_and_feelings(spark):
    one = spark.createDataFrame([("Straße", "ﬁne  CAFÉ & Co", "  “Hello, World!” …", "﻿\xa0 hi ")], "a string, b string, c string, d string")
    r = one.select(text.name_key(F.col("a")).alias("k"), text.letters_only("b").alias("l"), text.normalize_feeling(F.col("c")).alias("f"), text.browser_trim(F.col("d")).alias("t"), text.utf16_length(F.lit("a𝄞b")).alias("u"),
                   text.plain_excerpt(F.lit("<p>a &lt;b&gt; &eacute;&nbsp;c, ddd</p>"), 9).alias("x")).first()
    assert (r.k, r.l, r.f, r.t, r.u, r.x) == ("strasse", "finecafeandco", "hello, world", "hi", 4, "a <b> é ...")
    assert text._hurried("I don't know what to do", "1") == text._hurried("I don't know what to do", "1")
    variants = {text._hurried("because you want to know, right now", str(k)) for k in range(30)}
    assert len(variants) > 10 and any("bc" in v for v in variants)
    assert text._slip("", random.Random(1)) == "" and text._slip("123", random.Random(1)) == "123"


def test_class_targets_and_eras(spark):
    rows = {r.grp: r.target for r in select.class_targets(spark, 1200, {"a": 0.4, "b": 0.2, "c": 0.2, "d": 0.2}, {"x": 5}).collect()}
    assert rows == {"a": 480, "b": 240, "c": 240, "d": 240, "x": 5}
    assert [r.era for r in select.eras(spark, [(-5000, 1949, 1), (1950, 1999, 1)]).collect()] == ["before-1950", "1950-1999"]


def test_edges_of_paths(spark):
    rows = spark.createDataFrame([(1, [("a", None)], "x"), (2, None, "y"), (3, [], None)], "k int, near array<struct<src: string, alt: string>>, src string")
    rec = rows.select("k", F.struct(F.col("near"), F.col("src")).alias("r"))
    urls = spark.createDataFrame([("a", "A"), ("x", "X")], "src string, url string")
    got = publish.repointed(rec, "r", ["src", "near[].src"], urls).orderBy("k").collect()
    assert [(r.r.src, r.r.near and [n.src for n in r.r.near]) for r in got] == [("X", ["A"]), ("y", None), (None, [])]


def test_job_takes_up_what_was_refused(spark):
    from quillspan.operators import jobs

    def parse(keys, answer):
        if answer == "broken":
            raise ValueError("no answer")
        return {k: {"v": answer} for k in keys if k != "3" or answer == "second"}

    asked = lambda p: "broken" if "x" in p else "second" if "refused" in p else "first"
    job = jobs.Job(lambda rows: "|".join(r["t"] for r in rows), parse, ("t",), 2)
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d"), ("5", "x")], "key string, t string")
    requests = job.requests(rows)
    assert sorted(r.prompt for r in requests.collect()) == ["a|b", "c|d", "x"]
    got = {r.key: (r.record, r.error) for r in job.records(requests, asked).collect()}
    assert got["1"] == ('{"v": "first"}', None) and got["3"][0] == '{"v": "second"}' and got["4"][0] == '{"v": "first"}' and got["5"] == (None, "no answer")


def test_encoder_shrinks_its_batches(spark):
    from quillspan.operators import jobs

    def encode(texts):
        if len(texts) > 3:
            raise MemoryError
        return np.array([[len(t)] for t in texts])

    df = spark.createDataFrame([(i, "a" * (i % 9) if i else None) for i in range(50)], "i int, t string").coalesce(1)
    assert {r.i: list(r.vector) for r in jobs.encoded(df, "t", encode, 10_000).collect()} == {i: [float(i % 9)] for i in range(50)}
    assert jobs.encoded(df.limit(0), "t", encode).count() == 0
    with pytest.raises(ValueError):
        jobs.seed_grid(spark.createDataFrame([("a",)], "s string"), "s", ["b"], 30, 10)


def test_encoder_pads_little_over_the_whole_table(spark, tmp_path):
    from quillspan.operators import jobs

    def encode(texts):
        with open(f"{tmp_path}/{os.getpid()}", "a") as f:
            f.write(f"{len(texts) * max(1, *map(len, texts))} {sum(map(len, texts))}\n")
        return np.array([[len(t)] for t in texts])

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "left(text, 2000) AS text", "1 AS length")
    out = jobs.encoded(docs.repartition(9), "text", encode, 60_000)
    assert out.columns == ["doc_id", "text", "length", "vector"] and {r.doc_id: len(r.text or "") for r in docs.collect()} == {r.doc_id: int(r.vector[0]) for r in out.collect()}
    room, used = map(sum, zip(*[map(int, line.split()) for p in tmp_path.iterdir() for line in p.read_text().splitlines()], strict=True))
    assert (room - used) / room < 0.1


def test_command_line_shows_rows(spark, capfd):
    from quillspan.__main__ import main

    assert main([]) == 2 and main(["content_version", "/root/testdata/sf0.001", "1"]) == 0
    assert "version" in capfd.readouterr().out
