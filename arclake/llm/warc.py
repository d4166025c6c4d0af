"""WARC archives and their capture index, merged from locally sorted runs.

Writing: every page is one record, in its own gzip member; of equal payloads one page is the response and the others
revisit it.  Files are bounded in size, each sorted by URL key and time.  Reading: files are streamed, records parsed and
digests verified, and every file yields a sorted run of index entries.  The runs are dealt to ranges of (URL key, time,
page, file, place) of bounded size, and within a range a loser tree merges them k ways into globally ordered capture
histories.

Tasks report the files they finished, and only reported files are read, so files of lost or repeated attempts never
count.

Edge cases: a null payload is an empty one; a null url is written without a target and sorts first; a null page_id
is written as such, may revisit others and is a response where no known page has its payload; rows that repeat the
largest page_id of a payload are all responses; an empty table writes nothing and reads as no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arclake.llm.common import as_bytes, materialize, shared_dir, tidied
from arclake.operators import staging

FILE_BYTES = 16 << 20
#: Entries of a batch, and of a range of the merge.
ROWS, RANGE = 10_000, 100_000
#: Names of the record headers.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, url_key string, captured long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, place long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, in lower case: captures of a host sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.lower()
    return f"{host}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:arclake:page:{'null' if page is None else page}>"


def _page(name: str) -> int | None:
    last = name.rpartition(":")[2].rstrip(">")
    return None if last == "null" else int(last)


def record(page: int | None, url: str | None, captured: int, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, as a gzip member."""
    length, sha1 = len(payload), digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {datetime.fromtimestamp(captured, UTC):%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Payload-Length: {length}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


#: Printable ASCII but the blank: only other characters of a URL are escaped.
_URL_SAFE = "".join(chr(c) for c in range(33, 127))


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive of gzip members, which come in chunks; one record is held at a time."""
    member, raw = zlib.decompressobj(31), bytearray()
    for chunk in chunks:
        while chunk:
            raw += member.decompress(chunk)
            chunk = member.unused_data
            if member.eof:
                yield _parsed(bytes(raw))
                member, raw = zlib.decompressobj(31), bytearray()
    if raw:
        raise ValueError("an archive ends inside a record")


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return headers, rest[: int(headers["content-length"])]


def _writer(folder: str):
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        held: list[tuple[tuple, bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            """Store what is held as one file, sorted."""
            nonlocal held, size
            name = f"{path}/{uuid.uuid4().hex}.warc.gz"
            held.sort(key=lambda x: x[0])
            with store.open_output_stream(name, compression=None) as out:
                for _, data in held:
                    out.write(data)
            count, held, size = len(held), [], 0
            return pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([count], pa.int64())], ["file", "n"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "captured", "refers_to", "revisit")]
            for page, url, captured, refers_to, revisit, payload in zip(*columns, as_bytes(batch.column("payload")), strict=True):
                data = record(page, url, captured, payload, refers_to, revisit)
                held.append(((url_key(url), captured, page is not None, page or 0), data))
                size += len(data)
                if size >= FILE_BYTES:
                    yield close()
        if held:
            yield close()

    return run


def write_warc(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None, least_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write one record per page; returns the folder and the files that count (file, n).

    ``captured`` is the time of capture in seconds, 0 by default.  Payloads under ``least_bytes`` never revisit.
    """
    folder = folder or staging.to_release(f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    payload = F.coalesce(F.col(html), F.lit(""))
    plain = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("print"), F.coalesce((F.lit(0) if captured is None else captured).cast("long"), F.lit(0)).alias("captured"))
    equal = plain.select("print", "page_id").groupBy("print").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("print", "best")
    joined = plain.join(materialize(equal), "print", "left")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")) & (F.octet_length("payload") >= least_bytes)
    rows = joined.select("page_id", "url", "captured", F.when(revisit, F.col("best")).alias("refers_to"), revisit.alias("revisit"), "payload")
    return folder, materialize(rows.mapInArrow(_writer(folder), "file string, n long"))


_KINDS = {"long": pa.int64(), "string": pa.string()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in INDEX.split(", ")])


def _entries(folder: str):
    """Index entries of each file, in the file's own order."""

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(f"{path}/{file}", compression=None) as source:
                    for place, (headers, block) in enumerate(records(iter(lambda source=source: source.read(1 << 20), b""))):
                        rows.append(_entry(headers, block, file, place))
                        if len(rows) == ROWS:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


def _entry(headers: dict[str, str], block: bytes, file: str, place: int) -> tuple:
    kind, sha1 = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    length = int(headers["warc-payload-length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (len(payload), digest(payload)) != (length, sha1):
            raise ValueError(f"{file}: record {place} is damaged")
    url = headers.get("warc-target-uri")
    captured = int(datetime.strptime(headers["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
    refers_to = _page(headers["warc-refers-to"]) if kind == "revisit" else None
    return _page(headers["warc-record-id"]), url, url_key(url), captured, length, sha1, kind, refers_to, file, place


class LoserTree:
    """Merge of sorted sequences: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.heads: list[tuple | None] = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else x < y or (x == y and a < b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:  # its other side has not played yet
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.winner = winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.k:
            return
        while (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._replay(self.winner)


@tidied
def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ascending runs of each file's entries, as they come, merged.  A range holds about ``RANGE`` entries."""
    last: dict[str, list] = {}
    runs: list[list] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page, _, key, captured, *_, file, place = row
            order = (key, captured, page is not None, page or 0, file, place)
            run = last.get(file)
            if run is None or run[-1][0] > order:
                run = last[file] = []
                runs.append(run)
            run.append((order, row))
    block: list[tuple] = []
    for _, row in LoserTree([iter(r) for r in runs]):
        block.append(row)
        if len(block) == ROWS:
            yield _batch(block)
            block = []
    if block:
        yield _batch(block)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def read_warc(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """Index entries of the archives in a folder (or of ``files`` there), one sorted run a file.

    Only names go to the tasks, a file each; a task streams its file and holds one record and ``ROWS`` entries of it.
    """
    if files is None:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
        files = materialize(listed.select(F.substring_index("path", "/", -1).alias("file")))
    names = files.select("file")
    return names.repartition(max(1, names.count())).mapInArrow(_entries(folder), INDEX)


def capture_histories(index: DataFrame) -> DataFrame:
    """Globally ordered captures: range by range, each merged from its runs by a loser tree.

    There are as many ranges as hold ``RANGE`` entries each; file and place tell captures of equal key and time apart, so
    no group of them is one range.
    """
    index = materialize(index)
    ranges = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // RANGE))
    return index.repartitionByRange(ranges, "url_key", "captured", "page_id", "file", "place").mapInArrow(_merge, INDEX)


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, octet_length(encode(html)) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to,
  lower(array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1), '.')), ',') || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/:?#]*(:[0-9]+)', 1), ''), '') || ')'
    || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(url, '^[^?#]*([?][^#]*)', 1)) AS url_key,
  page_id % 1000000000 AS captured
FROM d
"""
