"""WARC records in ZIP-packaged archives: a writer, and a reader that takes byte ranges and extracts nothing.

An archive is a ZIP file with stored members: ``archive/data.warc.gz``, whose records are gzip members of their own, and
``indexes/index.cdxj``, a line for each record with its place in the archive member. Each task writes one archive to the
shared folder, under a name of its own for each attempt, and only archives of attempts that succeeded are listed. The
reader looks for the end-of-central-directory record (and its ZIP64 form) in the file's tail, parses the central
directory, locates the stored members through their local headers, reads the index, and fetches records in ranges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import join_checked, new_path, ship, write

#: Payloads with fewer bytes are stored each time.
MIN_REVISIT = 1000
#: Bytes of neighbouring records that are read at once.
READ_AHEAD = 4 << 20
_DATA, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_SPACE = uuid.UUID("6f1d7c52-2f4e-4f5e-9a53-0c6f6e1f2a11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}/{digest}')}>"


def make_record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 response record, or a revisit record (without the payload) if it refers to another. digest: hex SHA-1."""
    clean = "".join(c for c in url or "" if c not in "\r\n")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(key, digest)}", f"WARC-Target-URI: {clean}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if key is not None:
        head.append(f"Row-Key: {key}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Key: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Key, URL, type, payload (None for a revisit), its size and hex SHA-1, and the key that a revisit refers to."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    written = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    digest = written if revisit else hashlib.sha1(payload).hexdigest()
    if digest != written or not revisit and len(payload) != size:
        raise ValueError(f"record {fields.get('warc-record-id')} is damaged")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"key": number("row-key"), "url": fields["warc-target-uri"] or None, "type": fields["warc-type"], "payload": None if revisit else payload, "bytes": size, "digest": digest, "refers_to": number("refers-to-key")}


class ArchiveWriter:
    """Writes records to a ZIP file as they come; the index follows at the end."""

    def __init__(self, sink, date: str):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(_DATA), "w", force_zip64=True)
        self.index, self.at, self.date = io.StringIO(), 0, date

    def add(self, key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        packed = gzip.compress(make_record(key, url, payload, digest, refers_to, self.date), 6, mtime=0)
        entry = {"url": url, "filename": _DATA, "offset": self.at, "length": len(packed), "digest": digest}
        self.index.write(f"{digest} {''.join(c for c in self.date if c.isdigit())} {json.dumps(entry)}\n")
        self.data.write(packed)
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(_INDEX), self.index.getvalue())
        self.zip.close()


class ArchiveReader:
    """Members of a ZIP file that is read by ranges. read(offset, length) gives bytes of the file."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 66_000)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        locator = tail_at + end - 20
        if locator >= 0 and (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
            mark, _, at, _ = struct.unpack("<4sIQI", read(locator, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record = read(at, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members = self._directory(read(start, length), count)

    @staticmethod
    def _directory(data: bytes, count: int) -> dict[str, tuple[int, int, int]]:
        """Name -> (local header's offset, size, method)."""
        members, at = {}, 0
        for _ in range(count):
            mark, flags, method, packed, size, n_name, n_extra, n_comment, offset = struct.unpack_from("<4s4xHH8xIIHHH8xI", data, at)
            if mark != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            at += 46 + n_name + n_extra + n_comment
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # ZIP64: only the values that don't fit above, in this order
                    values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = next(values) if size == 0xFFFFFFFF else size
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    offset = next(values) if offset == 0xFFFFFFFF else offset
                extra = extra[4 + n :]
            members[name] = (offset, packed, method)
        return members

    def place(self, name: str) -> tuple[int, int]:
        """(offset, size) of a stored member's bytes in the file."""
        offset, size, method = self.members[name]
        if method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is not stored")
        head = self.read(offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("damaged local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return offset + 30 + n_name + n_extra, size

    def entries(self) -> Iterator[tuple[str, int, int]]:
        """(member, offset, length) of every record that the indexes list."""
        for name in sorted(self.members):
            if name.startswith("indexes/"):
                at, size = self.place(name)
                for line in self.read(at, size).decode().splitlines():
                    e = json.loads(line.split(" ", 2)[2])
                    yield e["filename"], e["offset"], e["length"]

    def records(self) -> Iterator[dict]:
        """The records, neighbours being fetched together."""
        run: list[tuple[str, int, int]] = []

        def fetch():
            name, first, _ = run[0]
            start, size = self.place(name)
            length = run[-1][1] + run[-1][2] - first
            if first + length > size:
                raise ValueError(f"index leads beyond {name}")
            data = self.read(start + first, length)
            for _, offset, n in run:
                yield parse_record(gzip.decompress(data[offset - first : offset - first + n]))

        for e in self.entries():
            if run and (e[0] != run[0][0] or e[1] != run[-1][1] + run[-1][2] or e[1] + e[2] - run[0][1] > READ_AHEAD):
                yield from fetch()
                run = []
            run.append(e)
        if run:
            yield from fetch()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2020-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT, folder: str | None = None) -> DataFrame:
    """Write a record per row; (path, records) of the archives, as a written table.

    A null payload is empty. Of rows with equal payloads of min_revisit bytes or more, those with the largest id are
    responses and the others revisits of it; rows with a null id are never referred to, and are revisits only of rows with
    one. Repeated rows give a record each. An empty table gives no archives; other columns are not read. Executors write
    to ``folder`` (a new one in the shared folder unless given) through the file system that its URI names.
    """
    spark = pages.sparkSession
    ship(spark)
    target = folder or new_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    size = F.octet_length("payload")
    same = write(rows.filter(size >= min_revisit).groupBy("digest").agg(F.max("key").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null").select("digest", "keeper"), "payloads")
    marked = join_checked(rows, same.df, ["digest"], "left", same.df.count())
    refers = F.when(~F.col("key").eqNullSafe(F.col("keeper")), F.col("keeper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out, sink, n, path = TaskContext.get(), None, None, 0, ""
        for batch in batches:
            for key, url, payload, digest, refers_to in zip(*(batch.column(c) for c in ("key", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    path = f"{target}/part-{task.partitionId():05d}-{task.taskAttemptId()}.zip"
                    system, name = fs.FileSystem.from_uri(path)
                    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    sink = system.open_output_stream(name)
                    out = ArchiveWriter(sink, date)
                out.add(key.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())
                n += 1
        if out:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return write(marked.select("key", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(run, "path string, records long"), "archives").df


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(key, url, record_type, payload, payload_bytes, payload_digest, refers_to) of every record of the archives (path).

    The digest of a response is computed from its payload and compared with the record's. payload is null for revisits,
    and for all records if payloads is False.
    """
    spark = archives.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "url", "type", "payload", "bytes", "digest", "refers_to")
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            for path in batch.column("path"):
                system, name = fs.FileSystem.from_uri(path.as_py())
                with system.open_input_file(name) as f:
                    held: list[dict] = []
                    size = 0
                    for r in ArchiveReader(lambda at, n, f=f: f.read_at(n, at), f.size()).records():
                        if not payloads:
                            r["payload"] = None
                        held.append(r)
                        size += len(r["payload"] or b"") + 100
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in held], k) for c, k in zip(names, kinds, strict=True)], names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in held], k) for c, k in zip(names, kinds, strict=True)], names)

    n = max(1, archives.count())
    found = archives.select("path").repartition(min(n, 4096)).mapInArrow(run, "key long, url string, type string, payload binary, bytes long, digest string, refers_to long")
    return found.select("key", "url", F.col("type").alias("record_type"), "payload", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "refers_to")
