"""WARC archives: written with an index, read back by coalesced byte ranges.

Writers roll archives of ``roll`` bytes, one gzip member per record, and return an index row per
record: file, offset, length, URL and digest. Names carry the task attempt, so files of a lost
or repeated attempt are never referred to. Readers take the selected index rows sorted by file
and offset and join neighbouring ranges into one read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import _tokens as K
from sextant.llm._shared import cut, keyed, shared_folder

INDEX = "page_id long, file string, offset long, length long, url string, digest string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_URN = "urn:page:"
TASK = 64 << 20
#: copies of a response over which its revisits are dealt
SALTS = 16


def _b32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """One WARC record as a gzip member, and the payload's digest. A revisit has the HTTP header
    alone, whose Content-Length still tells the full payload's size."""
    digest = _b32(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 1, mtime=0), digest


def parse(member: bytes) -> dict:
    """The fields of RECORD, and the payload (None for a revisit) with its digest checked."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block, tail = rest[: int(field["Content-Length"])], rest[int(field["Content-Length"]) :]
    if tail != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(field[name].strip("<>").removeprefix(_URN)) if name in field else None
    whole = field["WARC-Type"] == "response"
    if whole and (len(payload) != size or _b32(payload) != digest):
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": number("WARC-Record-ID"), "url": field.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": field["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload if whole else None,
    }


class _Archive:
    def __init__(self, folder: str):
        self.fs, path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        self.name, self.count, self.out, self.at = f"{path}/part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, None, 0

    def add(self, data: bytes, roll: int) -> tuple[str, int]:
        if self.out is not None and self.at + len(data) > roll:
            self.close()
        if self.out is None:
            self.file, self.at = f"{self.name}-{self.count}.warc.gz", 0
            self.out, self.count = self.fs.open_output_stream(self.file, compression=None), self.count + 1
        self.out.write(data)
        self.at += len(data)
        return self.file, self.at - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _writer(folder: str, roll: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for part in K.slices(batches, "html"):
            archive = archive or _Archive(folder)
            columns = {n: [] for n in ("page_id", "file", "offset", "length", "url", "digest")}
            for page_id, url, html, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                data, digest = record(page_id, url, (html or "").encode(), refers_to)
                file, offset = archive.add(data, roll)
                for name, value in zip(columns, (page_id, file, offset, len(data), url, digest), strict=True):
                    columns[name].append(value)
            types = {"file": pa.string(), "url": pa.string(), "digest": pa.string()}
            yield K.as_batch(**{n: pa.array(v, types.get(n, pa.int64())) for n, v in columns.items()})
        if archive:
            archive.close()

    return rows


def write_archives(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, roll: int = 32 << 20) -> tuple[DataFrame, str]:
    """Writes a record per page and returns the index and the folder. Of the pages whose payloads
    are equal and have at least ``min_bytes`` bytes, that with the largest page_id is the
    response and the others revisit it.

    A null html is an empty payload and a null url has no target; rows with a null page_id are
    left out; of rows that share a page_id the one with the greatest (url, html) stays; other
    columns are not read.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}-warc"
    rows = keyed(pages, "page_id", "url", "html")
    body = F.coalesce("html", F.lit(""))
    prints = rows.select("page_id", F.sha1(body.cast("binary")).alias("print"), F.octet_length(body).alias("size"))
    top = prints.filter(F.col("size") >= min_bytes).groupBy("print", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("many"))
    # a third of all pages may have one payload: they are dealt out over copies of its row
    top = top.filter("many > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = prints.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    targets = dealt.join(top, ["print", "size", "salt"]).filter("page_id <> top").select("page_id", F.col("top").alias("refers_to"))
    todo = rows.join(targets, "page_id", "left").select("page_id", "url", "html", "refers_to")
    return cut(todo.mapInArrow(_writer(folder, roll), INDEX)), folder


def _reader(folder: str, gap: int, most: int, payload: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        if payload:
            schema = schema.append(pa.field("payload", pa.string()))
        name, source = None, None
        for batch in batches:
            todo = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            at = 0
            while at < len(todo):
                file, begin, length = todo[at]
                to, end = at + 1, begin + length
                while to < len(todo) and todo[to][0] == file and todo[to][1] - end <= gap and todo[to][1] + todo[to][2] - begin <= most:
                    end = todo[to][1] + todo[to][2]
                    to += 1
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, files.open_input_file(file)
                data = source.read_at(end - begin, begin)
                found = [parse(data[o - begin : o - begin + n]) for _, o, n in todo[at:to]]
                for x in found:
                    x["payload"] = x["payload"].decode() if payload and x["payload"] is not None else None
                yield pa.RecordBatch.from_pylist([{k: x[k] for k in schema.names} for x in found], schema)
                at = to
        if source is not None:
            source.close()

    return rows


def read_archives(index: DataFrame, folder: str, gap: int = 1 << 16, most: int = 4 << 20, payload: bool = False) -> DataFrame:
    """The records that ``index`` (all of it, or a selection) names. Ranges at most ``gap`` bytes
    apart are read at once, up to ``most`` bytes. ``payload`` adds the text (null for revisits).
    Each task reads about ``TASK`` bytes of archives, whatever the size of the index."""
    size = index.agg(F.sum("length")).first()[0] or 0
    wanted = index.select("file", "offset", "length").repartition(max(1, -(-size // TASK)), "file").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(_reader(folder, gap, most, payload), RECORD + ", payload string" * payload)


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, CAST(CAST(unhex(sha1(b)) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST(16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
           + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM q
"""
