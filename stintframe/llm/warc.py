"""Deterministic sharded WARC files: records range-sorted by page, files rolled by compressed size.

Headers and digests are made anew from the data.  Of equal payloads of at least ``least_bytes`` the page with the largest id
is written as the response, the others as revisits that refer to it.  Files are gzip, one member a record, named by shard
and number; they appear by renaming, and the manifest, written last, names those that count.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .shards import MOST_TASKS, Output, by_shard, file_system, place, read_manifest, with_shard, write_manifest

# Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_SPACE = uuid.UUID("00000000-0000-0000-0000-000000000000")
DATE = "2000-01-01T00:00:00Z"
SUMMARY = "file string, shard int, bytes long, records long, sha1 string"


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, name: str, headers: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    """One record as a gzip member; its id depends on ``name`` alone."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", date), *headers]
    lines += [("WARC-Block-Digest", sha1_base32(block)), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header without a time
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int, date: str) -> bytes:
    clean = " ".join((url or "").split())
    headers = [("WARC-Target-URI", clean), ("WARC-Payload-Digest", sha1_base32(payload)), ("Content-Type", "application/http; msgtype=response")]
    if page is not None:
        headers.append(("X-Page-ID", str(page)))
    http = _HTTP.format(len(payload)).encode()
    name = f"page {page} {digest} {copy}"
    if refers_to is None:
        return record("response", name, headers, http + payload, date)
    target = uuid.uuid5(_SPACE, f"page {refers_to} {digest} 0")
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:uuid:{target}>"), ("X-Refers-To-Page-ID", str(refers_to))]
    return record("revisit", name, headers, http, date)


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``page_id``, ``digest``, ``refers_to`` of pages whose payload another page carries.

    Payloads are compared by digest and length.  Counts are pre-aggregated and written before the join, so that narrow rows,
    without the payload, are shuffled for the join alone, and the adaptive skew join may split a payload that many pages share.
    """
    narrow = pages.filter(F.col("size") >= least_bytes).select("page_id", "digest", "size")
    same = cut(narrow.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null"))
    return narrow.join(same, ["digest", "size"]).select("page_id", "digest", "refers_to").distinct()


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 1000,
    shard_bytes: int = 128 << 20,
    roll_bytes: int = 64 << 20,
    prefix: str = "pages",
    date: str = DATE,
) -> None:
    """Write all rows.  Null html: an empty payload; null url: an empty one; white space within a URL becomes single spaces, since
    a header is one line.  A page without id is never referred to: it revisits a page with one, and without such a page is a
    response.  Repeated rows: the first of a page's equal payloads is the response, the others revisit it if they are long
    enough.  Other columns are not read, whatever their names.  A payload of any length is one record, held by its task.  An
    empty table gives an archive without files.  The list of files is a Parquet table beside them, which the manifest names."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")})
    marks = revisits(rows, least_bytes).withColumn("mark", F.lit(0))
    both = rows.drop("size").withColumn("mark", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    # the records of one page and payload stay together, so that one of them is its response
    a, b = place(F.col("page_id"), F.col("digest"))
    both = both.select("*", a.alias("a"), b.alias("b"), b.alias("hash"))
    weighed = rows.select(a.alias("a"), b.alias("b"), (F.col("size") + 400).alias("weight"))
    dealt, n = with_shard(both, weighed, shard_bytes)
    dealt = by_shard(dealt, n).sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "hash", "digest", "mark", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, number, count, sha = None, None, 0, 0, None
        page, digest, refers, same = None, None, None, 0

        def close() -> pa.RecordBatch:
            out.commit()
            row = {"file": f"{prefix}-{shard:07d}-{number:05d}.warc.gz", "shard": shard, "bytes": out.size, "records": count, "sha1": sha.hexdigest()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), ("shard", pa.int32()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha1", pa.string())]))

        def put(data: bytes) -> None:
            out.write(data)
            sha.update(data)

        try:
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "html", "digest", "mark", "refers_to"))
                for s, p, url, html, d, mark, target in zip(*columns, strict=True):
                    if (p, d) != (page, digest):
                        page, digest, refers, same = p, d, None, 0
                    if mark == 0:
                        refers = target
                        continue
                    if out and (s != shard or out.size >= roll_bytes):
                        yield close()
                        out, number = None, number + 1
                    if not out:
                        number = number if s == shard else 0
                        shard, count, sha = s, 0, hashlib.sha1()
                        file = f"{prefix}-{shard:07d}-{number:05d}.warc.gz"
                        out = Output(path, file)
                        put(record("warcinfo", file, [("WARC-Filename", file), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", date))
                    to = refers if refers != p or same else None
                    put(page_record(p, url, html, d, to, same, date))
                    same, count = same + 1, count + 1
            if out:
                yield close()
        except BaseException:
            if out:
                out.discard()
            raise

    files = dealt.select("shard", "page_id", "url", "html", "digest", "mark", "refers_to").mapInArrow(run, SUMMARY)
    listed = f"files-{uuid.uuid4().hex}.parquet"
    files.write.parquet(f"{path}/{listed}")
    write_manifest(path, {"files": listed})


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    left = b""
    while left or (left := stream.read(chunk)):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not left and not (left := stream.read(chunk)):
                raise ValueError("the archive ends within a record")
            parts.append(unpack.decompress(left))
            left = unpack.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the block's length and digest are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != sha1_base32(block):
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per page record in the files of the manifest's list: ``page_id``, ``payload_bytes``, ``payload_digest`` (hex),
    ``record_type``, ``refers_to``, ``url``, ``file``, and the ``payload`` if asked for (null for revisits)."""
    files = spark.read.schema(SUMMARY).parquet(f"{path}/{read_manifest(path)['files']}").select("file")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, root = file_system(path)
                rows, held = [], 0
                with system.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for headers, block in map(parse, members(stream)):
                        kind = headers["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.decode().rsplit("Content-Length: ", 1)[1])
                        digest = headers["WARC-Payload-Digest"]
                        if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
                            raise ValueError(f"damaged payload in {headers['WARC-Record-ID']}")
                        page, to = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                        values = [page and int(page), size, base64.b32decode(digest[5:]).hex(), kind, to and int(to), headers["WARC-Target-URI"], file]
                        rows.append(dict(zip(names, [*values, payload if kind == "response" else None], strict=False)))
                        held += len(payload) if with_payload else 100
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, types)

    n = max(1, min(files.count(), MOST_TASKS))
    return files.repartition(n).mapInArrow(run, schema)
