"""WARC archives: a writer of one gzip member a record, and a splittable reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, remove, values, written

#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a split, and of a read while a record is followed past the end of one.
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 20
#: Bytes of decoded records that are held until the members of a split are known to be records.
HELD_BYTES = 32 << 20


def payload_digest(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool | None = None) -> bytes:
    """One gzip member. A revisit holds the HTTP header alone, whose Content-Length is that of the full payload; it names
    the record that it refers to, unless that has no id. revisit is told by refers_to where it is not given."""
    revisit = refers_to is not None if revisit is None else revisit
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = " ".join((url or "").split())
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return gzip.compress(VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it: those that pyarrow opens, also under the schemes that Hadoop gives them."""
    scheme, colon, rest = uri.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Add `_revisit` and `_refers` to pages (page_id, url, _payload): of equal payloads of at least `least` bytes, the row
    with the largest page_id (then the largest url) is a response, and all others revisit it.

    Null ids are smaller than any other; if a response has a null id, its revisits refer to null. Of rows that are equal
    throughout one is the response. Digests alone are grouped; a digest that one row has leaves no trace. Only rows that
    are equal throughout and the response of their payload are brought together with their payload.
    """
    keyed = pages.withColumn("_key", F.when(F.octet_length("_payload") >= least, F.sha2("_payload", 256)))
    same = written(keyed.where(F.col("_key").isNotNull()).groupBy("_key", "page_id", "url").agg(F.count(F.lit(1)).alias("n")), "digests")
    best = F.max(F.struct(F.col("page_id").isNotNull(), "page_id", F.col("url").isNotNull(), "url", "n"))
    shared = same.groupBy(F.col("_key").alias("_k")).agg(best.alias("_best"), F.sum("n").alias("_all")).where("_all > 1")
    shared = written(shared.select("_k", F.col("_best.page_id").alias("_last"), F.col("_best.url").alias("_of"), F.col("_best.n").alias("_twins")), "shared")
    joined = keyed.join(shared, keyed["_key"] == shared["_k"], "left")
    first = F.col("page_id").eqNullSafe(F.col("_last")) & F.col("url").eqNullSafe(F.col("_of"))
    revisit = F.col("_k").isNotNull() & ~first
    out = joined.select("page_id", "url", "_payload", revisit.alias("_revisit"), F.when(revisit, F.col("_last")).alias("_refers"), F.when(first, F.col("_twins")).alias("_twins"), "_key")
    if not shared.where("_twins > 1").isEmpty():
        twins = out.where("_twins > 1").dropDuplicates(["_key"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_twins"))))
        twins = twins.withColumn("_revisit", F.col("_copy") > 1).withColumn("_refers", F.when(F.col("_copy") > 1, F.col("page_id"))).drop("_copy")
        out = out.where("_twins is null or _twins <= 1").unionByName(twins)
    return out.drop("_twins", "_key")


def write_warc(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files under folder, one file a task, and return (path, bytes, records).

    The payload is the html in UTF-8 (null: empty). A task writes under a name of its own and only files of tasks that
    ended well are in the result, so a task that is lost or run twice does no harm. Null urls are empty. Other columns
    are ignored. An empty table gives no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(folder)
        store.create_dir(at, recursive=True)
        name, out, size, count = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page_id, url, payload, refers, revisit in zip(*(values(batch.column(c)) for c in ("page_id", "url", "_payload", "_refers", "_revisit"))):
                out = out or store.open_output_stream(f"{at}/{name}", compression=None)  # the members are compressed already
                member = record(page_id, url, payload, payload_digest(payload), refers, revisit)
                out.write(member)
                size, count = size + len(member), count + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

    bodies = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("_payload"))
    return written(with_revisits(bodies, least).mapInArrow(run, "path string, bytes long, records long"), "archives")


class _Tail:
    """The bytes of a file from one place on, read as far as they are asked for."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, bytearray()
        file.seek(start)

    def more(self, upto: int) -> bool:
        """Hold the bytes before the place upto, as far as the file goes; False if there were no more."""
        before = len(self.data)
        while self.start + len(self.data) < min(upto, self.size):
            got = self.file.read(max(READ_BYTES, min(upto, self.size) - self.start - len(self.data)))
            if not got:
                break
            self.data += got
        return len(self.data) > before


def member_at(tail: _Tail, at: int, keep: bool = True) -> tuple[bytes, int] | None:
    """The record whose member starts at `at` and the place after it, or None if no whole WARC record starts there.
    Without keep the record is decoded and checked, and only its first bytes are held."""
    if not _magic(tail, at):
        return None
    inflate, out, pos = zlib.decompressobj(wbits=31), bytearray(), at
    while not inflate.eof:
        if pos - tail.start >= len(tail.data) and not tail.more(pos + READ_BYTES):
            return None
        chunk = bytes(tail.data[pos - tail.start : pos - tail.start + READ_BYTES])
        try:
            more = inflate.decompress(chunk)
        except zlib.error:
            return None
        out += more if keep else more[: max(0, len(VERSION) - len(out))]
        if not VERSION.startswith(bytes(out[: len(VERSION)])):
            return None
        pos += len(chunk)
    return bytes(out), pos - len(inflate.unused_data)


def members_of_split(file, start: int, end: int, size: int) -> Iterator[tuple[int, int, bytes | None]]:
    """The gzip members that start in [start, end): place, length and record; or place, 0 and None where a member ought to
    start and none can be decoded.

    A candidate is a place with the gzip magic; it counts if its header decodes to a WARC record and so does what
    follows it, member by member, until a member starts past the split or the file ends, zeros at the end apart. So
    magic that stands inside a record's own bytes is no start. Where the members end at one that has its magic but does
    not decode, in the split or as the first past it, or at the start of the file, that place is told, and the search goes
    on behind it. One case can't be told apart: a payload that is itself an archive, is stored without compression and
    has the split's end between two of its members; the writer here compresses payloads. And members before one whose
    magic is gone are taken for such a payload, unless they begin the file; `unread` tells of what is missing then.
    Memory: a split as it is stored, and one record.
    """
    tail = _Tail(file, start, size)
    tail.more(end + len(MAGIC))
    at = tail.data.find(MAGIC)
    if start == 0 and size and at != 0 and not _zeros(tail, 0):
        yield 0, 0, None
    while 0 <= at < end - start:
        spots, pos, held = [], start + at, 0
        while pos < end and (got := member_at(tail, pos, held < HELD_BYTES)):
            spots.append((pos, got[1] - pos, got[0] if held < HELD_BYTES else None))
            pos, held = got[1], held + len(got[0])
        over = _zeros(tail, pos) if spots else False
        if spots and (over or pos >= end and _magic(tail, pos)):
            broken = not over and not member_at(tail, pos, False)
        elif start + at == 0 or spots and _magic(tail, pos):
            broken = True
        else:
            at = tail.data.find(MAGIC, at + 1)
            continue
        for place, length, raw in spots:
            yield place, length, raw if raw is not None else member_at(tail, place)[0]
        if broken:
            yield pos, 0, None
        if not broken or pos >= end:
            return
        at = tail.data.find(MAGIC, pos - start + 1)


def records_of_split(file, start: int, end: int, size: int) -> list[bytes]:
    """The records whose gzip members start in [start, end)."""
    return [raw for _, _, raw in members_of_split(file, start, end, size) if raw is not None]


def _magic(tail: _Tail, pos: int) -> bool:
    tail.more(pos + len(MAGIC))
    return bytes(tail.data[pos - tail.start : pos - tail.start + len(MAGIC)]) == MAGIC


def _zeros(tail: _Tail, pos: int) -> bool:
    """Whether there is nothing but zeros from pos to the end of the file."""
    while pos < tail.size:
        tail.more(pos + 1)
        if any(tail.data[pos - tail.start :]):
            return False
        pos = tail.start + len(tail.data)
    return True


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of a record."""

    def fields(lines: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _page(value: str | None) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(number[1]) if number else None


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, path string, offset long, length long, error string"


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES, damaged: str = "raise") -> DataFrame:
    """Records of archives (path, bytes): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, and
    path, offset and length of the member they stand in.

    Files are cut into splits of split_bytes, dealt out evenly; a split's task reads its own bytes and, past the end,
    the rest of the last record that started inside. A revisit's payload is null; its length and digest come from its
    headers. Files without a record give no rows, and zeros at the end of a file are nothing. Where a member can't be
    decoded (a file that was cut off, or damaged), and where a response's payload does not have the digest of its header,
    damaged="raise" fails with the place, and damaged="report" gives a row with path, offset and error, besides all
    records that can be read. page_id is null where a record's id is not of this module's form.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = archives.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = splits.repartition(parts, "path", "start")

    def fields_of(raw: bytes) -> tuple:
        warc, http, payload = parse(raw)
        kind, digest = warc.get("warc-type"), (warc.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        if kind == "response" and digest not in (None, own := payload_digest(payload)):
            raise ValueError(f"the payload of {warc.get('warc-record-id')} has the digest {own}, not {digest}")
        whole = payload if kind != "revisit" else None
        length = len(payload) if whole is not None else int(http.get("content-length", 0))
        return _page(warc.get("warc-record-id")), warc.get("warc-target-uri"), kind, _page(warc.get("warc-refers-to")), length, digest, whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                store, at = store_of(path)
                rows, held = [], 0
                with store.open_input_file(at) as file:
                    for offset, length, raw in members_of_split(file, start, start + split_bytes, size):
                        error = None if raw is not None else "no member of the archive can be decoded here"
                        try:
                            fields = fields_of(raw) if raw is not None else (None,) * 7
                        except (ValueError, KeyError) as why:
                            error, fields = str(why), (None,) * 7
                        if error and damaged == "raise":
                            raise ValueError(f"{path}, byte {offset}: {error}")
                        rows.append((*fields, path, offset, length, error))
                        held += len(raw or b"")
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return splits.mapInArrow(run, READ_SCHEMA)


def unread(archives: DataFrame, records: DataFrame) -> DataFrame:
    """(path, bytes, read) of the archives (path, bytes) whose members in records (path, length) do not add up to their
    bytes. Zeros at the end of a file count as bytes that were not read."""
    read = records.groupBy("path").agg(F.sum("length").alias("read"))
    return archives.select("path", "bytes").join(read, "path", "left").select("path", "bytes", F.coalesce("read", F.lit(0)).alias("read")).where("read <> bytes")


def warc_digest(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write pages as WARC, read the archives back, and return what the records say, one row for each page.

    It fails if anything of an archive can't be read. Null html is an empty payload; null ids, repeated rows and equal
    payloads are told in with_revisits; an empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    archives = write_warc(pages, folder if "://" in folder else f"file://{folder}")
    back = written(read_warc(archives, split_bytes).drop("payload", "url", "error"), "records")
    lost = unread(archives, back).first()
    if lost:
        raise ValueError(f"{lost['path']}: {lost['read']} of {lost['bytes']} bytes were read")
    remove(spark, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
