"""Pages as WARC archives, and an index of captures in order of address and time.

Archives are text files whose records end as the format asks, so Spark's own writer commits them.
Reading goes by the length that each record states.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import keep, new_path

LEAST_REVISIT = 1000
RECORDS_PER_FILE = 500
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURES = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, url_key string, captured string, archive string, offset bigint"


def _record_id(page_id: Column) -> Column:
    """Record name of a page; without an id the name of all zeros with a leading f."""
    digits = F.lpad(F.lower(F.hex(page_id)), 16, "0")
    name = F.concat(F.lit("00000000-0000-0000-"), F.substring(digits, F.lit(1), F.lit(4)), F.lit("-"), F.substring(digits, F.lit(5), F.lit(12)))
    return F.concat(F.lit("<urn:uuid:"), F.coalesce(name, F.lit("f0000000-0000-0000-0000-000000000000")), F.lit(">"))


def _roles(own: DataFrame) -> DataFrame:
    """Page, digest and the page it revisits, one row per distinct page and digest.

    Pages and payloads meet by digest in rows without the payload, so a payload that a third of the
    pages share moves no text.
    """
    short = own.select("page_id", "digest", "n").where("page_id IS NOT NULL").distinct()
    last = short.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("last"))
    return short.join(last, "digest", "left").select("page_id", "digest", F.when(F.col("last") != F.col("page_id"), F.col("last")).alias("refers"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per row of ``pages`` to gzip files under ``path``; other columns are ignored.

    The payload is the html in UTF-8, a null one empty. Of equal payloads of at least 1000 bytes the page
    with the largest id is a response and the others revisit it. A row with a null id is a response by
    itself. Rows that repeat an id and a payload are written each. Pages carry no time of capture, so the
    date of a record is derived from its id. Line breaks in an address are escaped.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    own = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.replace(F.replace(F.coalesce(F.col(url), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    placed = own.join(_roles(own), ["page_id", "digest"], "left")
    date = lambda c: F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(c, F.lit(0)), F.lit(1 << 28))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit(_END))
    revisit = F.col("refers").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Date: "), date(F.col("page_id"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    record = placed.select(F.concat(header, F.lit(_END), block).alias("value"))
    record.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _page(name: str) -> int | None:
    digits = name.removeprefix("<urn:uuid:").rstrip(">").replace("-", "")
    if digits.startswith("f"):
        return None
    value = int(digits[16:], 16)
    return value - (1 << 64) if value >> 63 else value


def url_key(url: str) -> str:
    """Sort key of an address: host parts from the right, then the rest."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    tail = parts.path + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + (tail or "/").lower()


def records(data: bytes, archive: str = "") -> Iterator[tuple]:
    """Captures of one archive, plain or compressed as one or several members. A record that breaks off is an error."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:
            member = zlib.decompressobj(31)
            plain.append(member.decompress(data) + member.flush())
            data = member.unused_data
        data = b"".join(plain)
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        if lines[0] != "WARC/1.1" or len(block) != size or data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"{archive}: no whole record at {at}")
        head, _, payload = block.partition(b"\r\n\r\n")
        length = int(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])["Content-Length"])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{archive}: payload at {at} is not what its digest says")
        refers = _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
        url = fields["WARC-Target-URI"]
        yield _page(fields["WARC-Record-ID"]), length, digest, kind, refers, url, url_key(url), fields["WARC-Date"], archive, at
        at = stop + 8 + size


def _order(capture: tuple) -> tuple:
    """Address key, time, then what else tells captures apart."""
    page = capture[0]
    return capture[6], capture[7], (page is not None, page or 0), capture[8], capture[9]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under ``path``; those of one archive form a run in order of address and time."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("url_key", pa.string()), ("captured", pa.string()), ("archive", pa.string()), ("offset", pa.int64())])

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                run = sorted(records(content.as_py(), name.as_py().rsplit("/", 1)[-1]), key=_order)
                columns = list(zip(*run)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(captures, _CAPTURES)


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of their matches, so each step replays one path."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = runs, key
        self.size = max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))]
        self.losers = [-1] * self.size
        for i in range(len(runs)):
            self._replay(i)

    def _next(self, i: int):
        head = next(self.runs[i], None)
        return None if head is None else (self.key(head), i, head)

    def _wins(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None
        return self.heads[a][:2] < self.heads[b][:2]

    def _replay(self, i: int) -> None:
        node, winner = (i + self.size) // 2, i
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if not self._wins(winner, other):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner][2]
            self.heads[winner] = self._next(winner)
            self._replay(winner)


def merge_index(captures: DataFrame, parts: int | None = None) -> DataFrame:
    """Captures in order of address and time, with ``part`` and ``place``: sorted by both they are the whole order.

    Ranges of (address, time, page) are dealt to tasks, so a single address with very many captures is
    spread too. In a task the runs of the archives are merged by a loser tree.
    """
    count = parts or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(count, "url_key", "captured", "page_id").withColumn("part", F.spark_partition_id())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        schema = part = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                part = row[-1]
                runs.setdefault(row[8], []).append(row)
        if schema is None:
            return
        # A run arrives in its order unless the network mixed its blocks; sorting an ordered run is one pass.
        tree = LoserTree([iter(sorted(run, key=_order)) for _, run in sorted(runs.items())], _order)
        block: list[tuple] = []
        place = 0
        for row in tree:
            block.append((*row, place))
            place += 1
            if len(block) == 10_000:
                yield _batch(block, schema)
                block = []
        if block:
            yield _batch(block, schema)

    return ranged.mapInArrow(merged, _CAPTURES + ", part int, place bigint")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    whole = schema.append(pa.field("place", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), whole)], schema=whole)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and merge their index.

    One row per row of ``pages``: the columns of the captures, part and place.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, page_id, url, html)
    return keep(merge_index(read(spark, path)), "captures")
