"""WARC archives by way of a chunked record table.

Payloads become rows of (record id, chunk number, bytes) of at most `CHUNK` bytes.
Writers stream those rows into archives, one per task, and readers stream the
archives back into the same kind of rows, each with the bytes and the digest so
far; neither ever builds a whole record.  A payload of at least `LEAST` bytes that
others equal is written once, as the response of the smallest page id; the others
become revisit records that name it.

Archives are WARC/1.1, each record a gzip member.  A task writes under a name of its own try, and only
the names that finished tasks report are read, so lost executors and repeated
tasks leave nothing behind that counts.

Payloads are never dealt out by what they hold: digests and ids alone are grouped,
and the verdicts on the rows that are no plain response come back by id and digest.

The reader takes archives of other writers too, packed or not: records of other
types are passed over, and a record without our own fields has a null page.

Defined results: a null payload is empty; a null url leaves the target out; a
page with a null id is a record without a page number, never refers to itself by
number and never is what others refer to; rows with equal ids and payloads are
all responses, each with a record id of its own; columns other than id, url and
payload are not read, whatever their names; an empty table gives no archive and
no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, settled

CHUNK, LEAST = 64 * 1024, 100
#: So many verdicts (of about 100 bytes) are sent to all tasks at most; beyond that rows are dealt out by id to meet them.
BROADCAST_VERDICTS = 100_000
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_ROWS = "page_id long, chunk long, chunk_bytes long, payload_bytes long, payload_digest string, record_type string, refers_to long, last boolean"


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder by the name that Spark knows it by, and the folder's path in it."""
    scheme, _, rest = uri.partition("://")
    if scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def records(pages: DataFrame, page: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(id, url, payload, digest, refers_to, several, named): what each page's record holds.

    `several` says that rows of the same id and payload exist, `named` that the
    record referred to is the only one of its page and payload.
    """
    rows = pages.select(F.col(page).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    each = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.octet_length("payload")).alias("bytes"))
    each = settled(each.select("digest", "id", "rows", (F.col("bytes") >= LEAST).alias("long")), f"{scratch(pages.sparkSession)}/digests")
    first = each.where("long").groupBy("digest").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "rows"))).alias("first"), F.count(F.lit(1)).alias("ids")).where("ids > 1 and first is not null").select("digest", "first")
    verdicts = each.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("id").isNull() | (F.col("first.id") < F.col("id")), F.col("first.id")))
    verdicts = verdicts.where("refers_to is not null or rows > 1 or id is null").select(F.col("id").alias("vid"), F.col("digest").alias("vdigest"), "refers_to", F.col("rows").alias("vrows"), (F.col("first.rows") == 1).alias("vnamed"))
    verdicts = settled(verdicts, f"{scratch(pages.sparkSession)}/verdicts")
    small = verdicts.limit(BROADCAST_VERDICTS + 1).count() <= BROADCAST_VERDICTS
    met = rows.join(F.broadcast(verdicts) if small else verdicts, rows["id"].eqNullSafe(F.col("vid")) & (rows["digest"] == F.col("vdigest")), "left")
    return met.select("id", "url", "payload", "digest", "refers_to", (F.col("id").isNull() | (F.coalesce("vrows", F.lit(1)) > 1)).alias("several"), F.coalesce("vnamed", F.lit(False)).alias("named"))


def chunks(recorded: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per chunk of a record that has a payload, one row for a revisit."""
    n = F.octet_length("payload")
    count = F.when(F.col("refers_to").isNotNull(), 1).otherwise(F.greatest(F.ceil(n / size), F.lit(1))).cast("int")
    data = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk") * size + 1, F.lit(size)))
    split = recorded.select("id", "url", "digest", "refers_to", "several", "named", n.cast("long").alias("total"), "payload", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    return split.select("id", "url", "digest", "refers_to", "several", "named", "total", "chunk", data.alias("data"))


def _clean(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text)


def _name(page: int, digest: str) -> str:
    """The record id of the only response of a page with a payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-{page}-{digest}')}>"


def _head(row: dict, length: int, kind: str) -> bytes:
    name = "-" if row["id"] is None else str(row["id"])
    plain = kind == "response" and not row["several"]
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", _name(row["id"], row["digest"]) if plain else f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if row["url"] is None else _clean(row["url"])), ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("Content-Type", "application/http; msgtype=response"), ("X-Page", name), ("X-Payload-Length", str(row["total"])),
    ]
    if kind == "revisit":
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _name(row["refers_to"], row["digest"]) if row["named"] else None), ("X-Refers-To-Page", str(row["refers_to"])),
        ]
    fields.append(("Content-Length", str(length)))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


class _Members:
    """A file of gzip members, one per record."""

    def __init__(self, sink):
        self.sink, self.member = sink, None

    def write(self, data: bytes) -> None:
        if self.member is None:
            self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.sink.write(self.member.compress(data))

    def end(self) -> None:
        self.sink.write(self.member.flush())
        self.member = None

    def close(self) -> None:
        self.sink.close()


class _Inflated:
    """The bytes of a file of gzip members, `size` packed bytes at a time; a file that isn't packed as it is."""

    def __init__(self, source, size: int):
        self.source, self.size, self.member, self.held = source, size, None, source.read(size)
        self.packed = self.held[:2] == b"\x1f\x8b"

    def read(self, most: int) -> bytes:
        while True:
            if not self.packed:
                out, self.held = self.held or self.source.read(self.size), b""
                return out
            if not self.held:
                self.held = self.source.read(self.size)
                if not self.held:
                    if self.member is not None:
                        raise ValueError("an archive ends inside a record")
                    return b""
            if self.member is None:
                self.member = zlib.decompressobj(31)
            out = self.member.decompress(self.held, most)
            self.held = self.member.unconsumed_tail
            if self.member.eof:
                self.held, self.member = self.member.unused_data, None
            if out:
                return out


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, sink, written = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        state = hashlib.sha256()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("id", "url", "digest", "refers_to", "several", "named", "total", "chunk")}
                if sink is None:
                    sink = _Members(store.open_output_stream(name, compression=None))
                if row["refers_to"] is not None:
                    sink.write(_head(row, 0, "revisit") + b"\r\n\r\n")
                    sink.end()
                    written += 1
                    continue
                data = batch.column("data")[i].as_buffer()
                if row["chunk"] == 0:
                    http = _HEAD % row["total"]
                    sink.write(_head(row, len(http) + row["total"], "response") + http)
                    state, written, sent = hashlib.sha256(), written + 1, 0
                state.update(data)
                sink.write(data)
                sent += data.size
                if sent == row["total"]:
                    if state.hexdigest() != row["digest"]:
                        raise ValueError(f"page {row['id']}: its chunks don't add up to its digest")
                    sink.write(b"\r\n\r\n")
                    sink.end()
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"archive": [name.removeprefix(root + "/")], "records": [written]})

    return write


def write(recorded: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; returns (archive, records), one row per archive under `folder`."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    return settled(chunks(recorded).mapInArrow(_writer(folder), "archive string, records long"), f"{folder}-index")


def _stream(source, size: int) -> Iterator[dict]:
    """The rows of one archive, read `size` bytes at a time."""
    held = bytearray()

    def line() -> bytes:
        nonlocal held
        while (end := held.find(b"\r\n")) < 0:
            more = source.read(size)
            if not more:
                raise ValueError("an archive ends inside a record")
            held += more
        got, held = bytes(held[:end]), held[end + 2 :]
        return got

    def take(n: int) -> Iterator[bytes]:
        nonlocal held
        while n:
            if not held:
                held += source.read(size)
                if not held:
                    raise ValueError("an archive ends inside a record")
            part = bytes(held[: min(n, size)])
            held, n = held[len(part) :], n - len(part)
            yield part

    while True:
        if not held:
            held += source.read(size)
            if not held:
                return
        if not line().startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        while text := line():
            key, _, value = text.decode(errors="replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        left, kind = int(fields["content-length"]), fields.get("warc-type", "")
        page, digest = fields.get("x-page", "-"), fields.get("warc-payload-digest", "")
        about = {"page_id": None if page == "-" else int(page), "record_type": kind, "refers_to": int(fields["x-refers-to-page"]) if "x-refers-to-page" in fields else None}
        if kind == "response":
            while left and fields.get("content-type", "").startswith("application/http"):
                text = line()
                left -= len(text) + 2
                if not text:
                    break
            state, seen, chunk = hashlib.sha256(), 0, 0
            if not left:
                yield about | {"chunk": 0, "chunk_bytes": 0, "payload_bytes": 0, "payload_digest": state.hexdigest(), "last": True}
            for part in take(left):
                state.update(part)
                seen += len(part)
                yield about | {"chunk": chunk, "chunk_bytes": len(part), "payload_bytes": seen, "payload_digest": state.hexdigest(), "last": seen == left}
                chunk += 1
            if digest.startswith("sha256:") and digest != f"sha256:{state.hexdigest()}":
                raise ValueError(f"record {fields.get('warc-record-id')}: its payload differs from its digest")
        else:
            for _ in take(left):
                pass
            if kind == "revisit":
                yield about | {"chunk": 0, "chunk_bytes": 0, "payload_bytes": int(fields["x-payload-length"]) if "x-payload-length" in fields else None, "payload_digest": digest.removeprefix("sha256:") or None, "last": True}
        if line() or line():
            raise ValueError("a record doesn't end where it should")


def _reader(folder: str, size: int):
    names = [x.split()[0] for x in _ROWS.split(", ")]
    kinds = {"payload_digest": pa.string(), "record_type": pa.string(), "last": pa.bool_()}
    schema = pa.schema([(x, kinds.get(x, pa.int64())) for x in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    rows = []
                    for row in _stream(_Inflated(source, size), size):
                        rows.append(row)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read(archives: DataFrame, folder: str, size: int = CHUNK) -> DataFrame:
    """The chunk rows of the archives: bytes and digest up to and with each chunk, `last` marking the record's end."""
    return archives.repartition(max(1, archives.count()), "archive").mapInArrow(_reader(folder, size), _ROWS)


def query(pages: DataFrame) -> DataFrame:
    folder = f"{scratch(pages.sparkSession)}/warc"
    archives = write(records(pages), folder)
    return read(archives, folder).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {LEAST} AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST} AND first < page_id THEN first END AS refers_to
FROM f
"""
