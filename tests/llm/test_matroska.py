"""Matroska files written and read back, hand-made ones, and damaged ones."""

import hashlib
import random
import struct
import zlib

import pytest

from quillspan.llm import matroska as m

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, media string, packets string, n_bytes long, feature string"


def payload(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "a", "é" * 288, "é" * 289, "x" * 4608, "line one\nline two", "long " * 60_000, "same", "same"]
    extra = [(i, t, "m", "p", 1, "f") for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None), (3, "é" * 288, "m", "p", 1, "f")]
    own = spark.createDataFrame(extra, SCHEMA)
    return own.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)


def test_stored_texts_equal_plain_digests(spark, docs):
    got = sorted((tuple(r) for r in m.stored_texts(docs).drop("media_bytes", "media_sha256", "feature").collect()), key=repr)
    want = []
    for r in docs.select("doc_id", "text").collect():
        p = payload(r.text)
        want.append((r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(want, key=repr)
    assert m.stored_texts(docs.limit(0)).count() == 0


def test_equal_texts_equal_values(spark, docs):
    one, two = (r[1:] for r in m.stored_texts(docs.where("text = 'same'")).collect())
    assert one == two


def test_stored_form_and_feature(spark, docs):
    files = m.store(docs.select("doc_id", "text")).collect()
    want = sorted((len(f.media), hashlib.sha256(f.media).hexdigest()) for f in files)
    rows = m.stored_texts(docs).collect()
    assert sorted((r.media_bytes, r.media_sha256) for r in rows) == want
    for r in rows:
        facts = dict(x.split("=", 1) for x in r.feature.split(" "))
        found, cues = facts["cues"].split("/")
        assert found == cues == facts["clusters"] and facts["problem"] == "-" and facts["codec"] == "A_PCM/INT/LIT"
        assert int(facts["ms"]) == r.payload_bytes // 8


def test_packet_table_holds_the_payload(spark, docs):
    files = m.store(docs.select("doc_id", "text").where("doc_id >= 0").dropDuplicates(["doc_id"])).cache()
    table = m.packet_table(m.demux(files, keep=("doc_id",)), "doc_id").join(files, "doc_id").selectExpr("doc_id", "time_ns", "duration_ns", "track", "offset", "substring(media, cast(offset AS int) + 1, cast(length AS int)) AS bytes").orderBy("doc_id", "offset").collect()
    parts, times = {}, {}
    for r in table:
        assert r.time_ns == times.get(r.doc_id, 0) and r.track == 1  # packets follow each other without gaps
        times[r.doc_id] = r.time_ns + r.duration_ns
        parts[r.doc_id] = parts.get(r.doc_id, b"") + r.bytes
    texts = {r.doc_id: r.text for r in docs.dropDuplicates(["doc_id"]).collect() if r.doc_id is not None}
    assert parts == {i: payload(t) for i, t in texts.items()}
    cues = m.cue_table(m.demux(files, keep=("doc_id",)), "doc_id").collect()
    assert len(cues) > len(texts) and all(c.found for c in cues)
    files.unpersist()


def track(number, codec, *more):
    return m.element(m.TRACK_ENTRY, m.unsigned(m.TRACK_NUMBER, number) + m.unsigned(m.TRACK_TYPE, 1) + m.element(m.CODEC_ID, codec) + b"".join(more))


def unknown(number, body):
    """An element whose size isn't told."""
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + b"\x01" + b"\xff" * 7 + body


HEAD = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm"))


def test_hand_made_file():
    """Two tracks, unknown sizes, voids, groups with durations and references, every lacing, a cue that leads nowhere."""
    frames = [b"a" * 300, b"b" * 255, b"c" * 700, b"", b"e" * 3]
    tracks = m.element(m.TRACKS, m.element(0xEC, b"\0" * 9) + track(1, b"V_VP9", m.unsigned(m.DEFAULT_DURATION, 40_000_000)) + track(300, b"S_TEXT/UTF8"))
    group = m.element(m.BLOCK_GROUP, m.unsigned(m.BLOCK_DURATION, 10) + m.element(m.BLOCK, m.block(1, -5, frames, "ebml")) + m.element(m.REFERENCE_BLOCK, b"\xff"))
    wide_track = m.element(m.SIMPLE_BLOCK, b"\x41\x2c" + (7).to_bytes(2, "big", signed=True) + b"\x00" + b"text")
    one = unknown(m.CLUSTER, m.unsigned(m.TIMESTAMP, 1000) + m.element(m.SIMPLE_BLOCK, m.block(1, 20, frames, "xiph")) + group + wide_track)
    two = m.element(m.CLUSTER, m.unsigned(m.TIMESTAMP, 2000) + m.element(0xBF, b"1234") + m.element(m.SIMPLE_BLOCK, m.block(1, 0, [b"xy", b"zw", b"uv"], "fixed", keyframe=False)))
    cues = m.element(m.CUES, m.element(m.CUE_POINT, m.unsigned(m.CUE_TIME, 2000) + m.element(m.CUE_POSITIONS, m.unsigned(m.CUE_TRACK, 1) + m.unsigned(m.CUE_CLUSTER, 99))))
    info = m.element(m.INFO, m.unsigned(m.TIMESTAMP_SCALE, 100_000))
    data = HEAD + unknown(m.SEGMENT, info + tracks + one + two + cues)
    found = m.parse(data)
    rows = list(m.packets(found))
    assert found.problems == [] and [t["track"] for t in found.tracks] == [1, 300]
    assert [data[r[9] : r[9] + r[10]] for r in rows] == [*frames, *frames, b"text", b"xy", b"zw", b"uv"]
    assert [r[1] for r in rows[:5]] == [102_000_000 + 40_000_000 * k for k in range(5)]  # the track's default
    assert [(r[1], r[2], r[3]) for r in rows[5:10]] == [(99_500_000 + 200_000 * k, 200_000, False) for k in range(5)]  # a fifth of the group's
    assert (rows[10][0], rows[10][1], rows[10][2], rows[10][3]) == (300, 100_700_000, None, False)
    assert [r[4] for r in rows] == ["xiph"] * 5 + ["ebml"] * 5 + ["none"] + ["fixed"] * 3 and rows[11][1] == 200_000_000
    assert [c["cluster_at"] for c in found.cues] == [99]


def test_lacings_round_trip():
    rng = random.Random(2)
    for _ in range(300):
        frames = [bytes([k]) * rng.choice([0, 1, 63, 64, 127, 128, 254, 255, 256, 510, 8000, 20_000]) for k in range(rng.randint(1, 9))]
        for kind in ("xiph", "ebml"):
            body = m.block(1, 0, frames, kind)
            _, _, flags, places = m._block(body, 0, len(body))
            assert [body[a:b] for a, b in places] == frames and m.LACING[flags & 6] == kind


def test_damaged_files_never_fail(spark):
    """Cut anywhere, bytes changed anywhere, or no file at all: a problem or other rows, no error."""
    rng = random.Random(8)
    whole = m.mux(m.padded(b"some text " * 1200))
    bad = [None, b"", b"\x00", b"text", b"\x1a\x45\xdf\xa3", m.element(m.EBML, m.element(m.DOC_TYPE, b"other"))]
    bad += [whole[: rng.randrange(len(whole))] for _ in range(40)]
    for _ in range(300):
        x = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            x[rng.choice([rng.randrange(len(x)), rng.randrange(260)])] = rng.randrange(256)
        bad.append(bytes(x))
    bad += [HEAD + m.element(m.SEGMENT, m.element(m.TRACKS, track(1, b"A_PCM", m.element(m.AUDIO, m.element(m.SAMPLING_FREQUENCY, struct.pack(">d", x)) + m.unsigned(m.BIT_DEPTH, 2**64 - 1)))) + m.element(m.CLUSTER, m.unsigned(m.TIMESTAMP, 2**64 - 1) + m.element(m.SIMPLE_BLOCK, m.block(1, 1, [b"x"], "none")))) for x in (float("nan"), 1e-320, 1e308)]
    df = spark.createDataFrame(list(enumerate(bad)), "k int, media binary")
    got = {r.k: r for r in m.feature(m.demux(df, keep=("k",), payload=True)).collect()}
    assert len(got) == len(bad)
    assert got[0].problem == "no file" and got[0].packets is None
    assert all(got[k].problem for k in range(46))  # a cut is always seen
    assert all(p.offset + p.length <= len(bad[k]) and p.length >= 0 for k, r in got.items() for p in r.packets or [])
