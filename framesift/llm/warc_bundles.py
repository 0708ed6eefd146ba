"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole records, and a footer: a skippable frame with the
seek table (compressed and decompressed size of each frame).  An index maps a record's id to the bundle, the frame and
the record's place in the decompressed frame, so one record costs one ranged read and one frame's decompression.  A
bundle begins with a warcinfo record; the others are HTTP responses whose body is the payload, or revisits with the
headers of such a response alone.

Of pages with equal payloads of at least REVISIT_BYTES, the smallest page_id is a response and the others are revisits
that refer to it.  Null html is an empty payload, and payloads of any length are one record.  A null page_id comes after all others.  Rows that
repeat the smallest page_id are all responses.  Other columns are ignored, whatever their names; an empty table writes no bundle.

Payloads are not shuffled: one scan takes digests and sizes, from which the revisits follow, and a second one writes each
task's responses where it reads them.  It leaves out the revisits by a bit filter over their rows; the few responses that
the filter takes for revisits are written by a join.

Bundles go to a folder that all executors share, by way of pyarrow's file systems.  A task writes under a name of
its own attempt, so a task that runs again harms nothing: the index of the attempt that ended names its own files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, durable, has_bit, mapped, named_rows, release, same_word, shared_dir, temporary

REVISIT_BYTES = 100
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
# Fixed values of the seekable format: skippable frame magic, seek table magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


RECORD = "page_id long, url string, html string, digest string, bytes long, revisit boolean, refers_to long"
#: Records made at once.
_SLICE = 256


def _record(kind: str, name: str, headers: list[str], block: bytes, mime: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z", *headers, f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, revisit: bool, refers: int | None) -> bytes:
    headers = [f"WARC-Target-URI: {''.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers is None else refers}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _record("revisit" if revisit else "response", f"urn:page:{'' if page_id is None else page_id}", headers, http + payload, "application/http; msgtype=response")


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8").split("\r\n")
    return first, dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; X-Payload-Length is the length that the HTTP headers state."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, headers = _headers(head)
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if headers["WARC-Type"] not in ("response", "revisit"):
        return headers, rest[:n]
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    headers["X-Payload-Length"] = _headers(http)[1]["Content-Length"]
    return headers, payload


class BundleWriter:
    def __init__(self, folder: str, name: str):
        import zstandard
        from pyarrow import fs

        self.files, base = fs.FileSystem.from_uri(folder)
        self.files.create_dir(base, recursive=True)
        self.name, self.path, self.frames, self.at = name, f"{base}/{name}", [], 0
        self.out, self.packer, self.held, self.places = self.files.open_output_stream(self.path, compression=None), zstandard.ZstdCompressor(level=3), bytearray(), []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset in the frame and length of the record."""
        if self.held and len(self.held) + len(record) > FRAME_BYTES:
            self._flush()
        place = (len(self.frames), len(self.held), len(record))
        self.held += record
        return place

    def _flush(self) -> None:
        data = self.packer.compress(bytes(self.held))
        self.out.write(data)
        self.frames.append((len(data), len(self.held)))
        self.at += len(data)
        self.held.clear()

    def close(self) -> None:
        if self.held:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle through its footer."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        self.file = files.open_input_file(f"{base}/{name}")
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            import zstandard

            at, packed, plain = self.frames[k]
            self.last = (k, zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain))
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def records(pages: DataFrame) -> DataFrame:
    """A row for each record to be written (RECORD); html is null in revisits."""
    pages, file, place = named_rows(pages)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")]
    row = F.xxhash64(file, place).alias("row")
    measured = pages.select(file.alias("file"), place.alias("place"), *own, F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    measured = durable(measured, "digests")
    # aggregated before its shuffle: a group of copies is one row a task
    long = measured.where(F.col("bytes") >= REVISIT_BYTES)
    first = long.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").select("digest", "first")
    revisits = durable(long.join(first.hint("shuffle_hash"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))), "revisits")
    filtered = bit_filter(revisits.select(F.xxhash64("file", "place").alias("row")), "row")
    taken = durable(measured.withColumn("row", F.xxhash64("file", "place")).join(filtered, same_word("row") & has_bit("row")).select("file", "place", "row").join(revisits.select("file", "place").hint("shuffle_hash"), ["file", "place"], "left_anti"), "taken")
    release(measured)

    scan = pages.select(*own, html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"), row, file.alias("file"), place.alias("place"))
    plain = scan.join(filtered, same_word("row"), "left").where(~has_bit("row"))
    late = scan.join(bit_filter(taken, "row"), same_word("row") & has_bit("row")).join(taken.select("file", "place").hint("shuffle_hash"), ["file", "place"], "left_semi")
    responses = plain.select("page_id", "url", "html", "digest", "bytes").unionByName(late.select("page_id", "url", "html", "digest", "bytes"))
    none = F.lit(None)
    return responses.select("*", F.lit(False).alias("revisit"), none.cast("long").alias("refers_to")).unionByName(revisits.select("page_id", "url", none.cast("string").alias("html"), "digest", "bytes", F.lit(True).alias("revisit"), F.col("first").alias("refers_to")))


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the bundles; returns the index: page_id, bundle, frame, frame_offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: BundleWriter | None = None
        names = ["page_id", "bundle", "frame", "frame_offset", "length"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for whole in batches:
            for lo in range(0, whole.num_rows, _SLICE):
                b = whole.slice(lo, _SLICE)
                out: list[tuple] = []
                for page, url, html, *about in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if writer is None:
                        writer = BundleWriter(folder, f"{uuid.uuid4().hex}.warc.zst")
                        writer.add(_record("warcinfo", f"urn:bundle:{writer.name}", [], b"software: framesift\r\nformat: WARC File Format 1.1\r\n", "application/warc-fields"))
                    out.append((page, writer.name, *writer.add(_page(page, url, (html or "").encode("utf-8", "replace"), *about))))
                    if writer.at > BUNDLE_BYTES:
                        writer.close()
                        writer = None
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if writer is not None:
            writer.close()

    schema = "page_id long, bundle string, frame long, frame_offset long, length long"
    return durable(records(pages).transform(mapped, run, schema), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each indexed record, read from the bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for b in (whole.slice(lo, _SLICE) for whole in batches for lo in range(0, whole.num_rows, _SLICE)):
            out: list[tuple] = []
            for page, bundle, frame, offset, length in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if bundle != name:
                    reader, name = BundleReader(folder, bundle), bundle
                headers, payload = parse(reader.record(frame, offset, length))
                size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if headers["WARC-Type"] == "response":
                    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} has changed")
                refers = headers.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
                out.append((page, size, digest, headers["WARC-Type"], int(refers) if refers else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # all of a bundle's records together, in their order: each frame is decompressed once.  The index is small for the
    # work behind it, so its partitions are not left to their size.
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.repartition(parts, "bundle").sortWithinPartitions("bundle", "frame", "frame_offset").select("page_id", "bundle", "frame", "frame_offset", "length")
    return placed.transform(mapped, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages to bundles in folder (one of its own in the shared folder if not given) and reads them back."""
    folder = folder or temporary(pages.sparkSession, f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    if ":" not in folder.split("/")[0]:
        folder = "file://" + folder
    return read_records(write_bundles(pages, folder), folder)
