"""WARC archives as a data source, and web pages in archives without repeated payloads.

``register`` makes the format ``warc`` known to a session. Writing makes one archive a task, every record a gzip member of
its own whose header holds the member's length. What a write has made counts from the moment its manifest stands, so
archives of lost or repeated tasks are never read. Reading plans partitions from the manifests: long archives are split
at records, short ones are put together. Each record's headers are inflated and parsed first; predicates on them that Spark
hands down are tested there, and a record that fails one is skipped by its length with its payload neither inflated nor
decoded. Archives from elsewhere (plain, or gzip without lengths) are read record after record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.runtime import cut, ensure_checkpoint_dir, join_unique, small_batches

#: Fixed values of the format: version, profile of a revisit, default date.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
#: Compressed bytes of a partition, bytes read at once, bytes of a record inflated at first, level of compression.
SPLIT, WINDOW, HEAD, LEVEL = 32 << 20, 1 << 20, 2048, 6
#: Rows and bytes of a batch that goes to Spark.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Keys of payloads that repeat are broadcast up to so many (32 bytes each).
BROADCAST_KEYS = 200_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: Columns by the header that they come from.
HEADERS = {"type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "uri": "warc-target-uri", "refers_to": "warc-refers-to",
           "payload_digest": "warc-payload-digest", "content_type": "content-type"}
READ = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), *[T.StructField(c, T.StringType()) for c in HEADERS],
    T.StructField("content_length", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("digest", T.StringType()),
])


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _value(text: str) -> str:
    """A header's value in one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record_bytes(r: dict) -> bytes:
    """A record (``type``, ``record_id``, and if known ``date``, ``uri``, ``refers_to``, ``payload``, ``payload_bytes``, ``payload_sha1``); a revisit has no payload."""
    revisit = r["type"] == "revisit"
    payload = b"" if revisit else r.get("payload") or b""
    size = r.get("payload_bytes") if revisit else len(payload)
    sha1 = bytes.fromhex(r["payload_sha1"]) if revisit and r.get("payload_sha1") else hashlib.sha1(payload).digest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size or 0}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", r["type"]), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r.get("date") or NO_DATE)]
    if r.get("uri") is not None:
        headers.append(("WARC-Target-URI", r["uri"]))
    headers.append(("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha1).decode()}"))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{r['refers_to']}>")]
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{n}: {_value(v)}\r\n" for n, v in headers)
    return f"{VERSION}\r\n{head}\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own length and that of its data."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8)
    return head + struct.pack("<II", len(head) + 8 + len(body) + 8, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


#: Bytes before the deflated data of such a member.
_MEMBER_HEAD = 24


def _has_lengths(head: bytes) -> bool:
    return head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"sl"


class WarcWriter(ds.DataSourceArrowWriter):
    """Writes one archive a task; ``commit`` lists them, with places to split them at, in a manifest."""

    def __init__(self, path: str, overwrite: bool, split: int):
        self.path, self.overwrite, self.split = path, overwrite, split

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ds.WriterCommitMessage:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        at, since, splits, records = 0, 0, [0], 0
        info = {"type": "warcinfo", "record_id": f"urn:uuid:{uuid.uuid4()}"}
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:  # the records are packed already
            for batch in iterator:
                for r in batch.to_pylist():
                    data = (member(record_bytes(info)) if not at else b"") + member(record_bytes(r))
                    if since >= self.split:
                        splits.append(at)
                        since = 0
                    out.write(data)
                    at, since, records = at + len(data), since + len(data), records + 1
        message = ds.WriterCommitMessage()
        message.file = {"name": name, "bytes": at, "records": records, "splits": splits}
        return message

    def commit(self, messages: list) -> None:
        fs, folder = filesystem(self.path)
        old = _manifests(fs, folder) if self.overwrite else []
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([m.file for m in messages if m is not None]).encode())
        for path, files in old:
            fs.delete_file(path)
            for f in files:
                fs.delete_file(f"{folder}/{f['name']}")
        for m in messages:
            if m is not None and not m.file["records"]:
                fs.delete_file(f"{folder}/{m.file['name']}")

    def abort(self, messages: list) -> None:
        fs, folder = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{folder}/{m.file['name']}")


def _manifests(fs: pa.fs.FileSystem, folder: str) -> list[tuple[str, list[dict]]]:
    out = []
    for info in fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.startswith("_manifest-"):
            with fs.open_input_stream(info.path) as f:
                out.append((info.path, json.loads(f.read())))
    return out


def _test(f: ds.Filter):
    """What a pushed filter asks of the headers, or None if it is left to Spark."""
    if isinstance(f, ds.Not):
        inner = f.child
        if isinstance(inner, (ds.IsNull, ds.IsNotNull)):
            test = _test(inner)
            return test and (lambda h: not test(h))
        test, column = _test(inner), getattr(inner, "attribute", ("",))[0]
        return test and (lambda h: h.get(column) is not None and not test(h))
    if len(f.attribute) != 1 or f.attribute[0] not in (*HEADERS, "content_length"):
        return None
    column = f.attribute[0]
    known = {
        ds.EqualTo: lambda v: v == f.value, ds.EqualNullSafe: lambda v: v == f.value, ds.In: lambda v: v in f.value, ds.StringStartsWith: lambda v: v.startswith(f.value),
        ds.StringEndsWith: lambda v: v.endswith(f.value), ds.StringContains: lambda v: f.value in v, ds.GreaterThan: lambda v: v > f.value,
        ds.GreaterThanOrEqual: lambda v: v >= f.value, ds.LessThan: lambda v: v < f.value, ds.LessThanOrEqual: lambda v: v <= f.value,
    }
    if isinstance(f, ds.IsNull):
        return lambda h: h.get(column) is None
    if isinstance(f, ds.IsNotNull):
        return lambda h: h.get(column) is not None
    if isinstance(f, ds.EqualNullSafe) and f.value is None:
        return lambda h: h.get(column) is None
    if isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)) and column != "content_length":
        return None  # Spark orders strings by their bytes, Python by code points
    test = known.get(type(f))
    return test and (lambda h: h.get(column) is not None and test(h[column]))


def parse_head(data: bytes) -> dict:
    """Columns of a record's headers; names in any case, folded lines put together."""
    lines = data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:60]!r}")
    raw: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            raw[name] += " " + line.strip()
        elif ":" in line:
            name, _, v = line.partition(":")
            name = name.strip().lower()
            raw[name] = v.strip()
    out: dict = {c: raw.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c][1:-1] if out[c] and out[c][0] == "<" and out[c][-1] == ">" else out[c]
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].rpartition(":")[2]
    out["content_length"] = int(raw.get("content-length", 0))
    return out


def _with_block(h: dict, block: bytes, payload: str) -> dict:
    """Add to headers what their block tells: the payload (``whole``), its digest, and the size of the full payload."""
    size, body = None, block
    if (h["content_type"] or "").startswith("application/http"):
        http, gap, body = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n")[1:]:
            name, _, v = line.partition(b":")
            if name.strip().lower() == b"content-length" and v.strip().isdigit():
                size = int(v)
    if h["type"] == "revisit":
        return {**h, "payload_bytes": size}
    if payload == "none":
        return {**h, "payload_bytes": size if size is not None else len(body)}
    return {**h, "payload_bytes": len(body), "digest": base32_sha1(body), "payload": body if payload == "whole" else None}


class WarcReader(ds.DataSourceReader):
    """Reads records; ``payload`` is ``none`` (headers only), ``digest`` (length and digest of each payload) or ``whole``."""

    def __init__(self, path: str, payload: str, split: int):
        self.path, self.payload, self.split, self.tests = path, payload, split, []

    def partitions(self) -> list[ds.InputPartition]:
        """Stretches of archives, each of about ``split`` bytes."""
        fs, folder = filesystem(self.path)
        top = fs.get_file_info(folder)
        listed = _manifests(fs, folder) if top.type == pa.fs.FileType.Directory else []
        parts: list[tuple[str, int, int]] = []
        if listed:
            for f in (f for _, files in listed for f in files if f["records"]):
                parts += [(f"{folder}/{f['name']}", a, b) for a, b in zip(f["splits"], [*f["splits"][1:], f["bytes"]], strict=True)]
        else:
            infos = [top] if top.type == pa.fs.FileType.File else fs.get_file_info(pa.fs.FileSelector(folder, recursive=True, allow_not_found=True))
            parts = [(i.path, 0, i.size) for i in infos if i.type == pa.fs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        out, some, size = [], [], 0
        for p in sorted(parts):
            if some and size + p[2] - p[1] > self.split:
                out.append(ds.InputPartition(some))
                some, size = [], 0
            some.append(p)
            size += p[2] - p[1]
        return [*out, *([ds.InputPartition(some)] if some or not out else [])]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        rows, size = [], 0
        for path, start, end in partition.value:
            with fs.open_input_file(path) as f:
                try:
                    for offset, r in self._records(f, start, end):
                        rows.append({**r, "file": path, "offset": offset})
                        size += len(r.get("payload") or b"") + 500
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield self._batch(rows)
                            rows, size = [], 0
                except (ValueError, EOFError, zlib.error, struct.error) as e:
                    raise ValueError(f"{path} cannot be read: {e}") from e
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {T.StringType: pa.string(), T.LongType: pa.int64(), T.BinaryType: pa.binary()}
        names = [*READ, *([T.StructField("payload", T.BinaryType())] if self.payload == "whole" else [])]
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], kinds[type(f.dataType)]) for f in names], [f.name for f in names])

    def _wanted(self, h: dict) -> bool:
        return all(test(h) for test in self.tests)

    def _records(self, f, start: int, end: int) -> Iterator[tuple[int, dict]]:
        head = f.read_at(min(_MEMBER_HEAD, end - start), start) if end > start else b""
        if _has_lengths(head):
            yield from self._members(f, start, end)
        else:
            f.seek(start)
            packed = head[:2] == b"\x1f\x8b"
            yield from self._stream(io.BufferedReader(gzip.GzipFile(fileobj=f)) if packed else io.BufferedReader(f, WINDOW), packed)

    def _members(self, f, start: int, end: int) -> Iterator[tuple[int, dict]]:
        """Records of members with lengths; only the first bytes of those that are not wanted are inflated."""
        window, base = b"", start

        def seen(at: int, n: int) -> bytes:
            nonlocal window, base
            if at < base or at + n > base + len(window):
                window, base = f.read_at(min(max(n, WINDOW), end - at), at), at
            return window[at - base : at - base + n]

        at = start
        while at < end:
            head = seen(at, _MEMBER_HEAD)
            if not _has_lengths(head):
                raise ValueError(f"no record at byte {at}")
            length, whole = struct.unpack("<II", head[16:24])
            first = seen(at, min(length, _MEMBER_HEAD + HEAD))
            inflate = zlib.decompressobj(-15)
            data, fed = inflate.decompress(first[_MEMBER_HEAD:], HEAD), len(first)
            while (cut_at := data.find(b"\r\n\r\n")) < 0:
                more = inflate.decompress(inflate.unconsumed_tail or seen(at, length)[fed:], len(data) + HEAD)
                fed = fed if inflate.unconsumed_tail else length
                if not more:
                    raise ValueError(f"headers of the record at byte {at} do not end")
                data += more
            h = parse_head(data[:cut_at])
            if self._wanted(h):
                if self.payload != "none" and h["type"] != "revisit":
                    data = zlib.decompress(seen(at, length)[_MEMBER_HEAD : length - 8], -15, whole or 1)
                block = data[cut_at + 4 : cut_at + 4 + h["content_length"]]
                if self.payload != "none" and len(block) < h["content_length"]:
                    raise ValueError(f"the record at byte {at} is cut off")
                yield at, _with_block(h, block, self.payload)
            at += length

    def _stream(self, f: io.BufferedReader, packed: bool) -> Iterator[tuple[int, dict]]:
        """Records that follow each other; offsets are those of the inflated bytes."""
        at = 0
        while True:
            line = f.readline()
            if not line:
                return
            if not line.strip():
                at += len(line)
                continue
            head, offset = line, at
            while (line := f.readline()).strip():
                head += line
            at += len(head) + len(line)
            h = parse_head(head)
            n = h["content_length"]
            if self._wanted(h):
                block = f.read(n if self.payload != "none" or n <= 2 * HEAD else 2 * HEAD)
                if len(block) < min(n, 2 * HEAD) or (self.payload != "none" and len(block) < n):
                    raise ValueError(f"the record at byte {offset} is cut off")
                yield offset, _with_block(h, block, self.payload)
                left = n - len(block)
            else:
                left = n
            if packed:
                while left > 0 and (got := len(f.read(min(left, WINDOW)))):
                    left -= got
            else:
                f.seek(at + n)
            at += n


class PredicateReader(WarcReader):
    """Takes predicates on headers from Spark. Spark refuses such a reader where its setting PUSHDOWN is off."""

    def pushFilters(self, filters: list[ds.Filter]):  # noqa: N802
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)


class WarcSource(ds.DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``: options ``path``, ``payload`` (``none``, ``digest``, ``whole``), ``split`` (bytes)
    and ``pushdown`` (``true`` where the session's setting is on)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def _payload(self) -> str:
        return self.options.get("payload", "whole")

    def schema(self) -> T.StructType:
        return T.StructType([*READ, T.StructField("payload", T.BinaryType())]) if self._payload() == "whole" else READ

    def reader(self, schema: T.StructType) -> WarcReader:
        kind = PredicateReader if self.options.get("pushdown") == "true" else WarcReader
        return kind(self.options["path"], self._payload(), int(self.options.get("split", SPLIT)))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


@contextmanager
def pushdown(spark: SparkSession):
    """Within it Spark hands predicates down to Python data sources; the session's setting is put back afterwards."""
    before = spark.conf.get(PUSHDOWN, None)
    spark.conf.set(PUSHDOWN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PUSHDOWN)
        else:
            spark.conf.set(PUSHDOWN, before)


def read_warc(spark: SparkSession, path: str, payload: str = "whole") -> DataFrame:
    """Records of the archives in a folder. Made and run within ``pushdown``, predicates on headers are tested before payloads are read."""
    register(spark)
    return spark.read.format("warc").option("payload", payload).option("pushdown", spark.conf.get(PUSHDOWN, "false")).load(path)


def _record_id(page_id) -> F.Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")))


def write_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as archives: of pages with equal payloads of ``least`` bytes and more the one with the
    smallest id is a response, the others are revisits that refer to it; smaller ones are all responses.

    A payload is told by its SHA-256 digest. Ids are shuffled with digests; payloads stay where they are, but for those that
    repeat, of which one copy a task is. Defined cases: null html is an empty payload; a null id comes last, so it is a
    response only where no other id has its payload; of rows that share id and payload one counts as the first; a null
    url is left out; an empty table makes no archive; other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    register(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("uri"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.unhex(F.sha2(payload, 256)).alias("key"))
    known = cut(rows.withColumn("row", F.monotonically_increasing_id()).select("page_id", "uri", "payload_bytes", "key", "row", F.sha1("payload").alias("payload_sha1")))
    place = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "uri", "row")
    shared = known.filter(F.col("payload_bytes") >= least).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    shared = cut(shared)
    record = lambda df, kind, page, uri, *more: df.select(
        F.lit(kind).alias("type"), _record_id(F.col(page)).alias("record_id"), F.col(uri).alias("uri"), *more)
    whole = [F.lit(None).cast("string").alias("refers_to"), F.col("payload"), F.lit(None).cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("payload_sha1")]
    few = shared.count() <= BROADCAST_KEYS
    keys = shared.select("key", "n")
    if few:
        alone, copies = rows.join(F.broadcast(keys), "key", "left_anti"), rows.join(F.broadcast(keys), "key")
    else:
        copies = join_unique(rows, keys, ["key"], "n")
        hot = keys.orderBy(F.desc("n")).limit(1000).select("key")
        alone = rows.join(F.broadcast(hot), "key", "left_anti").join(keys, "key", "left_anti")
    once = copies.groupBy("key").agg(F.first("payload").alias("payload")).join(shared.select("key", "first.page_id", "first.uri"), "key")
    again = join_unique(known, shared, ["key"], "n").filter(F.col("row") != F.col("first.row"))
    again = record(again, "revisit", "page_id", "uri", _record_id(F.col("first.page_id")).alias("refers_to"), F.lit(None).cast("binary").alias("payload"), "payload_bytes", "payload_sha1")
    out = record(alone, "response", "page_id", "uri", *whole).unionByName(record(once, "response", "page_id", "uri", *whole)).unionByName(again)
    out.write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Write pages as archives and read these back: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Sizes and digests of responses are taken from the payloads that are read, those of revisits from their headers.
    """
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    path = path or f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path, least)
    number = lambda c: F.expr(f"try_cast(substr({c}, 10) AS long)")
    shape = lambda df, digest: df.select(
        number("record_id").alias("page_id"), "payload_bytes", F.col(digest).alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
    with pushdown(spark):
        responses = shape(read_warc(spark, path, "digest").filter("type = 'response'"), "digest")
        revisits = shape(read_warc(spark, path, "none").filter("type = 'revisit'"), "payload_digest")
        return cut(responses.unionByName(revisits))


_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
SQL = f"""
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS key, sha1(coalesce(html, '')) AS hex FROM pages),
ranked AS (SELECT *, min(page_id) OVER (PARTITION BY key, payload_bytes) AS first FROM sized)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr({_BASE32}, ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM ranked"""
