"""WARC: archives written as one gzip member for each record, and a splittable reader.

Writer: every task streams its rows into archives of about `file_bytes` in the shared folder, under names of its own
attempt, and returns a manifest row for each; only archives named by the committed manifest count, so a lost or repeated
task leaves nothing behind that is read. Of pages with equal payloads of at least MIN_REVISIT bytes, the one with the
smallest id is a response and the rest are revisits that name it.

Reader: every file is cut into byte ranges. A task looks for the gzip magic from its range's start, validates each
candidate by decoding its header up to the WARC version line, and owns the records whose member starts inside the range;
the last one is read beyond the range's end. Memory: one block of the file and one record.

Edge cases: a null payload is empty; a null id has no id header and reads back as null (it counts as larger than any id);
rows with equal ids and payloads get equal types; control characters in a URL are percent-encoded; an empty table gives
no archive and no rows. Only the id, URL and payload columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import arrow_fs, fresh_path, slices, written

MIN_REVISIT = 100
FILE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BLOCK = 1 << 20
SLOTS = 1 << 24  # bits of the map of repeated digests, 2 MB
SALTS = 16
MAGIC = b"\x1f\x8b\x08"

RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, target_uri string, path string, offset long, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("target_uri", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())])


# --- writer ---------------------------------------------------------------------------------------------------


def _uri(url: str | None) -> str:
    return "".join(c if "!" <= c else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"]
    head += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    head += [f"WARC-Target-URI: {_uri(url)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = arrow_fs(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]}, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for batch in slices(batches, "html"):
            for page_id, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first_id"))):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = member(page_id, url, html or b"", digest, first if first is not None and first != page_id else None)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The manifest of the written archives: path, bytes, records."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("html")).withColumn("digest", F.sha2("html", 256))
    counted = rows.where(F.length("html") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = written(counted.where("n > 1").drop("n"), "warc-repeated")
    # only pages that may be repeated are shuffled: a bit map of fixed size tells those that are not
    slots = written(_bit_map(repeated), "warc-slots")
    bit = F.pmod(F.xxhash64("digest"), F.lit(SLOTS))
    known = rows.withColumn("slot", bit).withColumn("page", F.floor(F.col("slot") / 32768)).join(F.broadcast(slots), "page", "left")  # SLOTS / 8 bytes
    within = F.pmod(F.col("slot"), F.lit(32768))
    byte = F.conv(F.hex(F.substring("bits", F.floor(within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce((F.length("html") >= min_revisit) & (byte % F.pow(F.lit(2), F.pmod(within, F.lit(8)) + 1) >= F.pow(F.lit(2), F.pmod(within, F.lit(8)))), F.lit(False))
    known = known.withColumn("maybe", maybe).select("page_id", "url", "html", "digest", "maybe")
    alone = known.where(~F.col("maybe")).select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("first_id"))
    # a very common page is dealt over SALTS tasks
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = known.where("maybe").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    marked = again.join(salted, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", "first_id")
    fields, folder = "path string, bytes long, records long", fresh_path(spark, "warc")
    manifest = alone.unionByName(marked).mapInArrow(_writer(folder, file_bytes), fields)
    return written(manifest, "warc-manifest")


def _bit_map(digests: DataFrame) -> DataFrame:
    """The digests' slots as bits: page, and bits (4,096 bytes) of the pages that have any."""
    slot = digests.select(F.pmod(F.xxhash64("digest"), F.lit(SLOTS)).alias("slot"))
    return slot.select(F.floor(F.col("slot") / 32768).alias("page"), F.pmod("slot", F.lit(32768)).alias("at")).groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))


# --- reader ---------------------------------------------------------------------------------------------------


class _File:
    """Reads of a file by block, with one block kept."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.at, self.kept = handle, size, -1, b""

    def block(self, offset: int) -> tuple[int, bytes]:
        """The kept block that holds the offset, and its place."""
        begin = offset - offset % BLOCK
        if begin != self.at:
            self.at, self.kept = begin, self.handle.read_at(min(BLOCK, self.size - begin), begin)
        return begin, self.kept


def decode_member(file: _File, offset: int) -> tuple[bytes, int] | None:
    """The bytes of the gzip member at the offset and the offset after it; None if what is there is no whole WARC record."""
    gz, parts, at, head = zlib.decompressobj(31), [], offset, False
    try:
        while not gz.eof:
            if at >= file.size:
                return None
            begin, data = file.block(at)
            part = gz.decompress(data[at - begin:])
            at = begin + len(data) - len(gz.unused_data)
            parts.append(part)
            if not head and sum(map(len, parts)) >= 7:
                parts, head = [b"".join(parts)], True
                if not parts[0].startswith(b"WARC/1."):
                    return None
    except zlib.error:
        return None
    whole = b"".join(parts)
    return (whole, at) if head else None


def members(file: _File, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records whose member starts in [start, end)."""
    at = start
    while at < min(end, file.size):
        begin, data = file.block(at)
        tail = file.handle.read_at(min(2, max(0, file.size - begin - len(data))), begin + len(data))  # the magic may cross two blocks
        found = (data + tail).find(MAGIC, at - begin)
        if found < 0:
            at = begin + len(data)
            continue
        at = begin + found
        if at >= end:
            return
        got = decode_member(file, at)
        if got is None:
            at += 1
            continue
        yield at, got[0]
        at = got[1]


def parse_record(data: bytes) -> dict:
    """A record of any writer: header names in any case, values with or without a blank before them, over several lines.
    Payload: what follows an HTTP header, else the whole block. Of a revisit, digest and length are those it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last is not None:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            fields[last] = value.strip()

    def number(key: str) -> int | None:
        value = fields.get(key, "")
        return int(value) if value.lstrip("-").isdecimal() else None

    size = number("content-length")
    block = rest.removesuffix(b"\r\n\r\n") if size is None else rest[:size]
    kind = fields.get("warc-type", "").lower() or None
    http = block.startswith(b"HTTP/") or fields.get("content-type", "").lower().startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    revisit = kind == "revisit"
    return {
        "page_id": number("x-page-id"), "record_type": kind, "refers_to": number("x-refers-to-page-id"),
        "payload_bytes": number("x-payload-length") if revisit else len(payload),
        "payload_digest": _digest(fields.get("warc-payload-digest")) if revisit else hashlib.sha256(payload).hexdigest(),
        "target_uri": fields.get("warc-target-uri", "").strip("<>"), "payload": None if revisit else payload,
    }


def _digest(stated: str | None) -> str | None:
    """A stated SHA-256 as bare lower-case hex (base 32 is turned into it); another algorithm's as `name:value`."""
    if not stated:
        return None
    name, _, value = stated.rpartition(":")
    if name.lower().replace("-", "") not in ("sha256", ""):
        return f"{name.lower()}:{value}"
    if len(value) == 64:
        return value.lower()
    try:
        return base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except ValueError:
        return f"{name.lower()}:{value}"


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "bytes"))):
                fs, local = arrow_fs(path)
                rows, held = [], 0
                with fs.open_input_file(local) as handle:
                    for offset, data in members(_File(handle, size), start, end):
                        row = parse_record(data) | {"path": path, "offset": offset}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 500
                        if held >= BLOCK:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return read


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the files (path, bytes) in RECORD's columns."""
    cuts = files.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes))).alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, "bytes"))
    # ranges are dealt over all cores: a few bytes each here, whole ranges once read
    n = max(1, files.sparkSession.sparkContext.defaultParallelism * 2)
    return cuts.repartition(n, "path", "start").mapInArrow(_reader(with_payload), RECORD)
