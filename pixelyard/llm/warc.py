"""WARC archives as a Spark data source, and pages written with revisit records for repeated payloads."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from pixelyard.llm.common import Scratch

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, headers map<string,string>, payload binary, payload_bytes bigint"
#: Columns that are headers: filters on them are decided before a payload is read.
HEADER_OF = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
LENGTH = "X-Payload-Length"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str):
    """The file system of a path and the path in it; schemes that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _local_uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _member(record: bytes) -> bytes:
    """One gzip member with its own length in an ``sl`` extra field, so that readers can skip it unread."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + total.to_bytes(4, "little") + len(record).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra
    return head + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


def _record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    """A header value: line breaks would end it."""
    return " ".join(value.split("\n")).replace("\r", " ")


class _Writer(DataSourceWriter):
    """One archive per task (a new one beyond ``rollover`` bytes), renamed into place when all have ended."""

    def __init__(self, path: str, rollover: int):
        self.path, self.rollover = _local_uri(path), rollover

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import uuid

        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for row in rows:
            if out is None or size >= self.rollover:
                if out:
                    out.close()
                names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = fs.open_output_stream(f"{root}/.{names[-1]}.tmp", compression=None), 0
            headers = {HEADER_OF[c]: _one_line(row[c]) for c in HEADER_OF if row[c] is not None}
            if row["record_type"] == "revisit":
                headers |= {"WARC-Profile": _REVISIT}
            elif row["record_type"] == "response":
                headers |= {"Content-Type": "application/http; msgtype=response"}
            headers |= {LENGTH: str(row["payload_bytes"]), **{k: _one_line(v) for k, v in (row["headers"] or {}).items()}}
            payload = bytes(row["payload"] or b"")
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            member = _member(_record(headers, http + payload if row["record_type"] == "response" else payload))
            out.write(member)
            size += len(member)
        if out:
            out.close()
        message = WriterCommitMessage()
        message.names = names
        return message

    def commit(self, messages: Sequence) -> None:
        fs, root = _filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{root}/.{name}.tmp", f"{root}/{name}")

    def abort(self, messages: Sequence) -> None:
        fs, root = _filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/.{name}.tmp")


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def parse_headers(head: bytes) -> dict[str, str]:
    """Header lines after the version line; folded lines are joined, names keep their case."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            out[last] = value.strip()
    return out


class _Members:
    """Records of a compressed or plain archive: headers first; a block is read, skipped or seeked over."""

    def __init__(self, file, piece: int = 1 << 16):
        self.file, self.piece = file, piece

    def _need(self, buffer: bytes, n: int) -> bytes:
        while len(buffer) < n and (more := self.file.read(max(self.piece, n - len(buffer)))):
            buffer += more
        return buffer

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        start = self.file.read(2)
        self.file.seek(0)
        yield from self._compressed(wanted) if start == b"\x1f\x8b" else self._plain(wanted)

    def _compressed(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        at = 0
        while True:
            self.file.seek(at)
            raw = self._need(b"", 24)
            if not raw:
                return
            known = None
            if raw[3] & 4 and raw[12:14] == b"sl":
                known = int.from_bytes(raw[16:20], "little")
            unpack, out, used = zlib.decompressobj(31), b"", 0
            feed = raw
            while b"\r\n\r\n" not in out and feed and not unpack.eof:
                out += unpack.decompress(feed)
                used += len(feed)
                if b"\r\n\r\n" not in out and not unpack.eof:
                    feed = self.file.read(self.piece)
            head, _, rest = out.partition(b"\r\n\r\n")
            headers = parse_headers(head)
            take = wanted(headers)
            if not take and known:
                at += known  # neither inflated nor read
                yield headers, None
                continue
            length, parts, got = int(headers.get("Content-Length", 0)), [rest] if take else [], len(rest)
            while not unpack.eof and (feed := self.file.read(self.piece)):
                used += len(feed)
                more = unpack.decompress(feed)
                got += len(more)
                if take:
                    parts.append(more)
            at += used - len(unpack.unused_data)
            yield headers, b"".join(parts)[:length] if take else None

    def _plain(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        at = 0
        while True:
            self.file.seek(at)
            raw = self._need(b"", 4096)
            while b"\r\n\r\n" not in raw:
                longer = self._need(raw, len(raw) + self.piece)
                if len(longer) == len(raw):
                    return
                raw = longer
            lead = len(raw) - len(raw.lstrip(b"\r\n"))
            end = raw.index(b"\r\n\r\n", lead)
            headers = parse_headers(raw[lead:end])
            begin, length = end + 4, int(headers.get("Content-Length", 0))
            block = self._need(raw, begin + length)[begin : begin + length] if wanted(headers) else None
            at += begin + length + 4
            yield headers, block


class _Reader(DataSourceReader):
    """Plans files into partitions, keeps filters on header columns, and reads blocks only where asked."""

    def __init__(self, path: str, per_partition: int, payload: bool):
        self.path, self.per_partition, self.payload, self.tests = _local_uri(path), per_partition, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tests.append((HEADER_OF[f.attribute[0]], values - {None}))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs as pafs

        fs, root = _filesystem(self.path)
        found = [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and not x.base_name.startswith((".", "_"))]
        groups, size = [[]], 0
        for x in sorted(found, key=lambda x: x.path):
            if groups[-1] and size + x.size > self.per_partition:
                groups.append([])
                size = 0
            groups[-1].append(x.path)
            size += x.size
        return [_Files(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = _filesystem(self.path)
        matches = lambda h: all(h.get(name) in values for name, values in self.tests)
        for path in partition.files:
            with fs.open_input_file(path) as file:
                for headers, block in _Members(file).records(lambda h: self.payload and matches(h) and h.get("WARC-Type") != "revisit"):
                    if not matches(headers):
                        continue
                    payload = block
                    if block is not None and headers.get("Content-Type", "").startswith("application/http"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    size = len(payload) if payload is not None else int(headers[LENGTH]) if LENGTH in headers else None
                    yield (*(headers.get(name) for name in HEADER_OF.values()), headers, payload, size)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").mode("append").save(folder)``.

    Options: ``payload`` ("false": blocks are never decoded), ``partitionBytes``, ``rolloverBytes``. Equality and
    IN filters on header columns are pushed down when ``spark.sql.python.filterPushdown.enabled`` is on:
    a record is then told by its headers, and the block of an unwanted one is skipped (by the length in
    its gzip header, or by seeking in a plain archive). The payload of an HTTP response is its body.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], int(o.get("partitionBytes", 64 << 20)), o.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("rolloverBytes", 1 << 30)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _sha1(batches):
    import pyarrow as pa

    for batch in batches:
        codes = [base64.b32encode(hashlib.sha1(x.as_buffer()).digest()).decode() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(codes, pa.string()), pa.array([len(x.as_buffer()) for x in batch.column(2)], pa.int64())], names=["id", "url", "payload", "digest", "size"])


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Records of the source's schema, one for each page.

    The payload is the page in UTF-8 (null: empty). Of equal payloads of at least ``min_bytes`` bytes the one
    of the largest id is a response and the others revisit it, without a block; smaller payloads are
    all responses. Rows with a null id are responses of their own. Rows that repeat the largest id of a
    payload are all responses. Payloads are told by SHA-1 and SHA-256 together.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.mapInArrow(_sha1, "id long, url string, payload binary, digest string, size long").withColumn("same", F.sha2("payload", 256))
    last = rows.where(F.col("size") >= min_bytes).groupBy("digest", "same").agg(F.max("id").alias("last"))
    # Written, so that the join shuffles both sides itself and can split a hot payload's rows.
    last = Scratch(pages.sparkSession, "payloads").write("last", last)
    joined = rows.join(last, ["digest", "same"], "left")
    revisit = F.coalesce(F.col("id") < F.col("last"), F.lit(False))
    record_id = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    return joined.select(
        F.coalesce(record_id(F.col("id").cast("string")), F.concat(F.lit("<urn:page:null:"), F.substring("same", 1, 16), F.lit(">"))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("2020-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(revisit, record_id(F.col("last").cast("string"))).alias("refers_to"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        F.col("size").alias("payload_bytes"),
    )


def page_of(record_id: str) -> Column:
    """The page id in a record id of ``records``."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written as archives to the shared folder and read back: what the archives say of each page.
    A response's digest and length are computed again from the payload that was read."""
    spark = pages.sparkSession
    register(spark)
    folder = Scratch(spark, "warc").root
    records(pages, min_bytes=min_bytes).write.format("warc").mode("append").save(folder)
    # By record type, which the source takes as a predicate: revisits are told by their headers alone. Each
    # is a reading of its own, because a source keeps what was pushed to it.
    responses, revisits = (spark.read.format("warc").load(folder).where(F.col("record_type") == kind) for kind in ("response", "revisit"))

    def digests(batches):
        import pyarrow as pa

        for batch in batches:
            said, read = batch.column(3).to_pylist(), [None if x is None else x.as_buffer() for x in map(lambda v: v if v.is_valid else None, batch.column(5))]
            found = [f"sha1:{base64.b32encode(hashlib.sha1(x).digest()).decode()}" if x is not None else s for s, x in zip(said, read, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.string()), batch.column(4)], names=["record_id", "record_type", "refers_to", "payload_digest", "payload_bytes"])

    names = ["record_id", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    out = responses.select(*names, "payload").mapInArrow(digests, "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long")
    out = out.unionByName(revisits.select(*names))
    return out.select(page_of("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"))

