"""WARC archives of captures, and an external merge of their index.

Captures are written as WARC files by Spark's text sink: a record is a string, records
end with two line breaks, which is the sink's line separator, and files are compressed.
Of records with equal payloads of `min_revisit` bytes or more, the one with the largest
page_id keeps its payload and the others become revisit records that refer to it.

Files are rolled after so many records that they hold about `FILE_BYTES` of payload on
average. Reading streams through each file, a record at a time: one capture run, whose
index entries are sorted locally by URL key, time and page, and numbered. Runs are then
cut at common key ranges; a range fetches each run's part in the order of its numbers
(no second sort by key) and merges the parts by a loser tree, so captures come out in
global order. A frequent payload or host never gathers: digests are pre-aggregated, and
ranges are cut on the whole key (URL key, time, page).

Defined results. Null html is an empty payload; a null url has the URL key "" and sorts
first. A null page_id is written as a record named "null", at the time of page 0; it
sorts before other pages of its key and time, and only a page with an id is referred to,
so equal payloads that all lack one are all responses. Rows that repeat a page_id are
written and returned each; equal rows may change places. An empty table gives no rows.
Only page_id, url and html are read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import discard, keyed, lean, materialize, scratch_path

MIN_REVISIT = 1000
FILE_BYTES = 64 << 20  # of payload in a file, about
_EOL = "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, warc_date string, run string, seq long"


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, then the path; no scheme, port or fragment."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "^[a-zA-Z]+://|#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^([^/:?]*)", 1))
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def capture_date(page_id: Column) -> Column:
    """The pages table has no time: one second a page from a fixed start."""
    return F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(page_id, F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id and the record (header, and payload if it is a response) of each capture."""
    rows = keyed(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha1(F.encode("html", "UTF-8"))})
    keepers = rows.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("k")).where("k > 1 AND keeper IS NOT NULL").select("digest", "keeper")
    rows = rows.join(materialize(keepers, "keepers"), "digest", "left")
    revisit = (F.col("n") >= min_revisit) & F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    line = lambda name, v: F.concat(F.lit(f"{name}: "), v, F.lit(_EOL))
    name = lambda v: F.concat(F.lit("<urn:page:"), F.coalesce(v.cast("string"), F.lit("null")), F.lit(">"))
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    head = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Target-URI", target),
        line("X-URL-Key", url_key(target)),
        line("WARC-Date", capture_date(F.col("page_id"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("keeper"))), line("WARC-Profile", F.lit(_REVISIT)))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(payload).cast("string")),
        F.lit(_EOL),
    )
    return rows.select("page_id", F.concat(head, payload).alias("record"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """WARC files below path, of about file_bytes payload each. Each is one capture run."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    each = max(1, int(file_bytes / (mean + 500)))  # a header has some 500 bytes
    out = records(pages, min_revisit).select("record").write.option("lineSep", _EOL * 2).option("compression", "gzip")
    out.option("maxRecordsPerFile", each).text(path)


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record of an uncompressed WARC stream."""
    while first := stream.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {first[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("the last header has no end")
            name, value = line.decode().rstrip(_EOL).split(": ", 1)
            head[name] = value
        size = int(head["Content-Length"])
        body = stream.read(size)
        if len(body) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record of {head['WARC-Record-ID']} doesn't end after {size} bytes")
        yield head, body


def _page(name: str) -> int | None:
    """The page of a record's name <urn:page:N>."""
    return None if name == "<urn:page:null>" else int(name[10:-1])


def _order(row: tuple) -> tuple:
    """The global order of index entries, as their first seven fields give it."""
    page, n, digest, kind, refers, key, date = row[:7]
    return key, date, page is not None, page or 0, n, digest, kind, refers or 0


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of every record, sorted and numbered (seq) within its run. A
    response's digest and length come from its payload and must agree with its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for head, body in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 18)):
                    digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    page = _page(head["WARC-Record-ID"])
                    if head["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest(), len(body)) != (digest, n):
                        raise ValueError(f"payload of page {page} differs from its digest")
                    refers = _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                    rows.append((page, n, digest, head["WARC-Type"], refers, head["X-URL-Key"], head["WARC-Date"], name.rsplit("/", 1)[-1]))
                rows.sort(key=_order)
                for at in range(0, len(rows), 10_000):
                    cols = [list(c) for c in zip(*rows[at : at + 10_000], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, range(at, at + len(cols[0]))], _ARROW, strict=True)], schema=_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(lean(run), INDEX)


_FIELDS = [x.split()[0] for x in INDEX.split(", ")]
_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in INDEX.split(", "))])
_MERGED = pa.schema([*(f for f in _ARROW if f.name != "seq"), ("part", pa.int32()), ("local", pa.int64())])


class LoserTree:
    """k-way merge of sorted runs: log2(k) comparisons for each row that comes out."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.k = len(runs)
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._sift(i)

    def _key(self, i: int):
        """The head of run i; a run that is over loses to all."""
        return (0, self.runs[i][self.at[i]], i) if self.at[i] < len(self.runs[i]) else (1, i)

    def _sift(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:
                self.losers[node] = i
                return
            if self._key(other) < self._key(i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.at[self.losers[0]] < len(self.runs[self.losers[0]]):
            i = self.losers[0]
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self._sift(i)


def merge_index(runs: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """The runs' entries in global order (by range, and in order within it), with
    position: the place in that order, from 1."""
    runs = materialize(runs, "runs")
    ranges = max(8, -(-runs.count() // rows_per_range))
    fields = [f for f in _FIELDS if f != "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        for b in batches:
            for row in zip(*(b.column(f).to_pylist() for f in [*fields, "part"]), strict=True):
                parts.setdefault(row[7], []).append((_order(row), row))
        merged = LoserTree([parts[k] for k in sorted(parts)])
        at, before = 0, None
        while rows := list(itertools.islice(merged, 10_000)):
            if before is not None and rows[0][0] < before or any(x[0] > y[0] for x, y in itertools.pairwise(rows)):
                raise ValueError("a run is not sorted")
            before = rows[-1][0]
            cols = [*zip(*(r for _, r in rows), strict=True), range(at + 1, at + 1 + len(rows))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _MERGED.types, strict=True)], schema=_MERGED)
            at += len(rows)

    # a run's part of a range comes in the order of its numbers: grouped by run, not sorted by key
    dealt = runs.repartitionByRange(ranges, "url_key", "warc_date", "page_id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("run", "seq")
    merged = materialize(dealt.mapInArrow(lean(run), ", ".join(x for x in INDEX.split(", ") if not x.startswith("seq")) + ", part int, local long"), "merged")
    discard(runs)
    # one row a range
    counts = merged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return merged.join(materialize(counts.drop("n"), "ranges"), "part").select(*fields, (F.col("before") + F.col("local")).alias("position"))


def archive_pages(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write pages as WARC files in the shared folder, read them back, merge the index."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit)
    return merge_index(read_archives(pages.sparkSession, path)).drop("run")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(u, '^[a-zA-Z]+://', ''), '#.*$', '') AS bare, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper,
             CASE WHEN bare = '' THEN '' ELSE array_to_string(list_reverse(string_split(lower(regexp_extract(bare, '^([^/:?]*)', 1)), '.')), ',') || ')' || regexp_replace(bare, '^[^/?]*', '') END AS url_key,
             strftime(to_timestamp(1700000000 + coalesce(page_id, 0)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS warc_date FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to,
       url_key, warc_date, row_number() OVER (ORDER BY url_key, warc_date, page_id NULLS FIRST, payload_bytes, payload_digest) AS position
FROM k
"""
