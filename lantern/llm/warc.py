"""Zstandard WARC archives: a dictionary in the leading skippable frame, then one frame per record."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.common import broadcast_if_small, prepare, read, shared_dir, written

# Fixed values of the formats: frame magics, and the profile of a revisit with an equal payload.
DICTIONARY_FRAME, ZSTD_MAGIC, DICTIONARY_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Shorter payloads are never revisits.
LEAST_SHARED = 100
#: An archive's dictionary, and how much of its first records it is trained on.
DICTIONARY_BYTES, TRAINING_BYTES, TRAINING_RECORDS = 64 << 10, 4 << 20, 400
#: An archive is closed beyond this size.
ARCHIVE_BYTES = 1 << 30
#: A record that is longer is reported as an error and passed over; none that was written from a row is.
RECORD_BYTES = (1 << 31) + (1 << 20)
DATE = "2024-01-01T00:00:00Z"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}') if page_id is not None else uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record; of a revisit, only the headers hold its payload's digest and length."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def train(samples: list[bytes]) -> tuple[zstd.ZstdCompressionDict, bytes]:
    """A dictionary and its bytes; too few samples to train on serve as a raw dictionary themselves."""
    try:
        found = zstd.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
        return found, found.as_bytes()
    except zstd.ZstdError:
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        if raw[:4] in (ZSTD_MAGIC, DICTIONARY_MAGIC) or len(raw) < 8:
            raw = b"WARC/1.1\r\nWARC-Type: response\r\n" + raw
        return zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT), raw


class Archive:
    """An archive being written. It appears under its name only when closed whole."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.fs, self.path = _open(self.uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part", compression=None)
        self.held: list[bytes] | None = []
        self.size = self.records = self.bytes = 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.held is None:
            self._write(self.compressor.compress(data))
            return
        self.held.append(data)
        self.size += len(data)
        if self.size >= TRAINING_BYTES or len(self.held) >= TRAINING_RECORDS:
            self._start()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        dictionary, raw = train(self.held)
        self.compressor = zstd.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        self._write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        held, self.held = self.held, None
        for data in held:
            self._write(self.compressor.compress(data))

    def close(self) -> tuple[str, int, int]:
        if self.held is not None:
            self._start()
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.uri, self.records, self.bytes


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, payload_digest, refers_to) rows to archives; (archive, records, bytes) of each.

    One task writes one partition, holding one record at a time beyond the dictionary's bounded training sample. The
    result is a written table: it names only archives of tasks that finished, so a repeated attempt adds no record.
    """
    prepare(records.sparkSession)
    rows = records.select("page_id", "url", "payload", "payload_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*b.columns, strict=True):
                archive = archive or Archive(folder)
                archive.add(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()))
                if archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["archive", "records", "bytes"])

    return written(rows.mapInArrow(run, "archive string, records long, bytes long"))


def frames(stream, longest: int = RECORD_BYTES) -> Iterator[bytes | Exception]:
    """The content of each frame after the dictionary.

    A frame that is longer than a record may be gives an error and is passed over; one that cannot be decoded ends the
    archive, as nothing tells where the next begins.
    """
    head = stream.read(8)
    dictionary, rest = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", head[4:])[0]
        raw, rest = stream.read(size), b""
        if len(raw) != size:
            yield ValueError("the dictionary frame is cut short")
            return
        if raw[:4] == ZSTD_MAGIC:
            raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
        kind = zstd.DICT_TYPE_FULLDICT if raw[:4] == DICTIONARY_MAGIC else zstd.DICT_TYPE_RAWCONTENT
        dictionary = zstd.ZstdCompressionDict(raw, dict_type=kind)
    reader = zstd.ZstdDecompressor(dict_data=dictionary) if dictionary else zstd.ZstdDecompressor()
    while rest or (rest := stream.read(1 << 16)):
        frame, parts, total = reader.decompressobj(), [], 0
        try:
            while not frame.eof:
                if not rest and not (rest := stream.read(1 << 16)):
                    raise ValueError("the last frame is cut short")
                parts.append(frame.decompress(rest))
                total += len(parts[-1])
                rest = frame.unused_data if frame.eof else b""
                if total > longest:
                    parts.clear()
        except (zstd.ZstdError, ValueError) as e:
            yield ValueError(str(e))
            return
        yield b"".join(parts) if total <= longest else ValueError(f"a frame holds {total} bytes, more than a record may have")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; ValueError unless headers and lengths hold."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line and header block")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"bad header line {line[:60]!r}")
        headers.setdefault(name.lower(), value.strip())
    if missing := [x for x in REQUIRED if x not in headers]:
        raise ValueError(f"missing {', '.join(missing)}")
    if not re.fullmatch(r"[0-9]{1,18}", headers["content-length"]):
        raise ValueError("Content-Length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the block and its end have {len(rest)} bytes")
    return headers, rest[:size]


_FIELDS = "archive string, record_no long, record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, error string"


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per frame of the archives named in column `archive`; a bad frame gives a row with its error.

    A task streams an archive frame by frame. Headers, lengths and, for responses, the payload's SHA-256 and length
    are checked. A revisit has the digest and length of the payload that it refers to.
    """
    prepare(spark)
    names = [x.split()[0] for x in _FIELDS.split(", ")] + ["payload"] * with_payload
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: len(names)]

    def row(uri: str, number: int, data: bytes | Exception) -> tuple:
        try:
            if isinstance(data, Exception):
                raise data
            h, block = parse(data)
            digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
            size = int(h.get("x-payload-length", len(block)))
            if h["warc-type"] == "response":
                own = hashlib.sha256(block).hexdigest()
                if digest not in (None, own):
                    raise ValueError("the payload's digest differs")
                if size != len(block):
                    raise ValueError("the payload's length differs")
                digest = own
            number_of = lambda name: int(h[name]) if name in h else None
            return uri, number, h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), number_of("x-page-id"), number_of("x-refers-to-page"), size, digest, None, block
        except ValueError as e:
            return uri, number, None, None, None, None, None, None, None, str(e), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = _open(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for number, data in enumerate(frames(stream)):
                        rows.append(row(uri, number, data)[: len(names)])
                        held += len(data) if with_payload and isinstance(data, bytes) else 200
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    each = archives.select("archive").repartition(max(1, archives.count()))
    return each.mapInArrow(run, _FIELDS + ", payload binary" * with_payload)


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_shared: int = LEAST_SHARED) -> DataFrame:
    """Pages as (page_id, url, payload, payload_digest, refers_to) rows.

    Of equal payloads of least_shared bytes or more, the smallest id's are responses (all rows that repeat it) and
    the rest refer to it; rows with a null id refer to it too, unless no row of the payload has an id. A null html
    is an empty payload. Extra columns are not read. Equal payloads are counted by digest before anything is joined.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("payload_digest", F.sha2("payload", 256))
    shared = base.where(F.octet_length("payload") >= least_shared).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = broadcast_if_small(written(shared.select("payload_digest", "first")))
    first = F.col("first")
    return base.join(shared, "payload_digest", "left").withColumn("refers_to", F.when(first.isNotNull() & ~first.eqNullSafe(F.col("page_id")), first)).drop("first")


def op1_warc_zstd(spark, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    archives = write_archives(records_of(read(spark, sf_dir, "pages")), shared_dir(spark))
    return read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "error")


OP1_SQL = f"""
with p as (select page_id, url, coalesce(html, '') as html from pages),
 f as (select *, count(*) over (partition by html) as n, min(page_id) over (partition by html) as first from p),
 g as (select *, case when strlen(html) >= {LEAST_SHARED} and n > 1 and first is distinct from page_id then first end as refers_to from f)
select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to,
  url as target_uri, cast(null as varchar) as error
from g
"""
