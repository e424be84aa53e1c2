"""WARC archives: one gzip member per record, written by Spark tasks and read back record by record.

The writer names one response for each payload and makes revisit records of the others. Each task writes its rows to
archives of a bounded size in the shared folder, under names that no other attempt uses; the table of written
archives, itself a committed Spark table, says which of them count, so a retried or lost task leaves no doubles.
The reader goes through an archive front to back with bounded memory: it inflates a chunk at a time, frames records
by Content-Length, and verifies each block against the record's digests. Revisits are then joined to the responses that
they name, and what they say of the payload is verified there.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import common

#: Payloads under this many bytes are responses always.
LEAST_REVISIT = 100
#: A task begins another archive once one has this many bytes.
ARCHIVE_BYTES = 32_000_000
CHUNK = 65_536
#: Longest WARC header that the reader takes.
MOST_HEADER = 1_000_000
#: All records carry one date, so that a retried task writes the same bytes.
DATE = datetime(2000, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
#: The record types, and the profile of revisits of the same payload.
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class WarcError(ValueError):
    """An archive that breaks the format, or a block that does not match its digest."""


#: Digest algorithms by their WARC name, with their length in bytes. Others are not verified.
ALGORITHMS = {"sha1": 20, "sha256": 32, "sha512": 64, "md5": 16}


def parse_digest(labelled: str | None) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a digest in Base32 or hex; None if there is none, or of an algorithm that is not known."""
    name, _, value = (labelled or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ALGORITHMS:
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * ALGORITHMS[name] else base64.b32decode(value.upper().rstrip("=") + "=" * (-len(value.rstrip("=")) % 8))
    except ValueError as e:
        raise WarcError(f"not a digest: {labelled!r}") from e
    if len(raw) != ALGORITHMS[name]:
        raise WarcError(f"not a digest: {labelled!r}")
    return name, raw


def _sha(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def write_record(record_type: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A record as a gzip member. A revisit's block holds the HTTP head only, its payload digest is that of the full payload."""
    block = HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload) + (payload if record_type == RESPONSE else b"")
    head = {
        "WARC-Type": record_type,
        "WARC-Record-ID": record_id(page_id, _sha(payload)),
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Payload-Digest": _sha(payload),
        "WARC-Block-Digest": _sha(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if record_type == REVISIT:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, _sha(payload)), "X-Refers-To-Page-Id": str(refers_to)}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(lines.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as its inflated chunks; a member must be read to its end before the next."""
    held = stream.read(CHUNK)
    while held:
        inflate = zlib.decompressobj(31)

        def chunks(inflate: zlib._Decompress = inflate) -> Iterator[bytes]:
            nonlocal held
            while not inflate.eof:
                if not held and not (held := stream.read(CHUNK)):
                    raise WarcError("the archive ends within a record")
                try:
                    out = inflate.decompress(held, CHUNK)
                except zlib.error as e:
                    raise WarcError(f"a gzip member is damaged: {e}") from e
                held = inflate.unconsumed_tail
                if out:
                    yield out
            held = inflate.unused_data or stream.read(CHUNK)

        yield chunks()


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, in order. Header names are in lower case, as their case has no meaning; folded lines are
    joined. Lengths are verified, and block digests where there are any. All damage is a WarcError."""
    for member in _members(stream):
        data = bytearray()
        while (end := data.find(b"\r\n\r\n")) < 0:
            part = next(member, b"")
            if not part or len(data) > MOST_HEADER:
                raise WarcError("no end of the WARC header")
            data += part
        head = parse_headers(bytes(data[:end]))
        length = int(head["content-length"])
        del data[: end + 4]
        size, block, claimed = 0, bytearray(), parse_digest(head.get("warc-block-digest"))
        digest = hashlib.new(claimed[0] if claimed else "sha256")
        for part in _chain(bytes(data), member):
            mine = part[: max(0, length - size)]
            digest.update(mine)
            block += part
            size += len(mine)
            if len(block) > length + 4:  # more than the record's end: what else the member holds is not read
                raise WarcError(f"the record is framed as {length} bytes, {len(block)} or more were found")
        if bytes(block[length:]) != b"\r\n\r\n":
            raise WarcError(f"the record is framed as {length} bytes, {len(block)} were found")
        if claimed and digest.digest() != claimed[1]:
            raise WarcError(f"the block of {head.get('warc-record-id')} does not match its digest")
        yield head, bytes(block[:length])


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    if first:
        yield first
    yield from rest


def parse_headers(data: bytes) -> dict[str, str]:
    """The named fields of a WARC header, names in lower case; the first line is checked, and that there is a length."""
    version, *lines = data.decode(errors="replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise WarcError(f"not a WARC record: {version[:40]!r}")
    head: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            head[name] = f"{head[name]} {line.strip()}"
        elif ":" in line:
            name, value = line.split(":", 1)
            head[name := name.strip().lower()] = value.strip()
        else:
            raise WarcError(f"not a header field: {line[:40]!r}")
    if not head.get("content-length", "").isdecimal():
        raise WarcError(f"no Content-Length: {head.get('content-length')!r}")
    return head


def _http_length(block: bytes) -> int | None:
    """The Content-Length of an HTTP head."""
    for line in block.split(b"\r\n\r\n", 1)[0].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdecimal() else None


def page_of(head: dict[str, str], block: bytes) -> dict:
    """What a record says of its page; a response's payload is verified against its digest too, if it has one.

    Archives of other writers have no page_id (null). A revisit's payload_bytes are those of its HTTP head, and payload_digest
    is null where the record names none by SHA-256; resolve_revisits() gets both from the response.
    """
    kind, claimed = head.get("warc-type", ""), parse_digest(head.get("warc-payload-digest"))
    revisit, parts = kind == REVISIT, block.split(b"\r\n\r\n", 1)
    payload = None if revisit else parts[1] if len(parts) > 1 else block
    if payload is not None and claimed and hashlib.new(claimed[0], payload).digest() != claimed[1]:
        raise WarcError(f"the payload of {head.get('warc-record-id')} does not match its digest")
    known = claimed[1].hex() if claimed and claimed[0] == "sha256" else None
    return {
        "page_id": _number(head.get("x-page-id")),
        "url": head.get("warc-target-uri"),
        "payload": payload,
        "payload_bytes": _http_length(block) if revisit else len(payload),
        "payload_digest": known if revisit else known or hashlib.sha256(payload).hexdigest(),
        "record_type": kind,
        "refers_to": _number(head.get("x-refers-to-page-id")) if revisit else None,
        "record_id": head.get("warc-record-id"),
        "refers_to_record": head.get("warc-refers-to") if revisit else None,
    }


def with_record_type(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """pages with digest, record_type and refers_to: of equal payloads of LEAST_REVISIT bytes or more, the smallest id is the response.

    Rows that repeat that id are responses too. A payload all of whose ids are null is a response each time.
    """
    keyed = pages.withColumn("digest", F.unhex(F.sha2(common.text_or_empty(payload_col).cast("binary"), 256)))
    long = F.octet_length(F.col(payload_col)) >= LEAST_REVISIT
    first = keyed.filter(long).groupBy("digest").agg(F.min(id_col).alias("first"), F.count("*").alias("copies")).filter("copies > 1").select(F.col("digest").alias("of"), "first")
    # copies only: what has no other is not in the table, and takes no part in a skewed key
    joined = keyed.join(first, (F.col("digest") == F.col("of")) & long, "left")
    revisit = F.col("first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("first"))
    return joined.select("*", F.when(revisit, REVISIT).otherwise(RESPONSE).alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")).drop("of", "first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Writes all pages as archives under folder, which all executors reach; returns the table of archives (path, n_records)."""
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(payload_col).cast("binary").alias("payload"), F.col(url_col).cast("string").alias("url"))
    typed = with_record_type(slim, "id", "payload")
    typed = typed.select("id", "payload", "url", "record_type", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = pafs.FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        out, path, size, n = None, "", 0, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, n))
                out = None

        for batch in batches:
            for part in common.bounded(batch):
                for page, payload, url, kind, refers in zip(*(part.column(c).to_pylist() for c in ("id", "payload", "url", "record_type", "refers_to")), strict=True):
                    if out is None:
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        path, size, n = f"{folder}/{name}", 0, 0
                        out = files.open_output_stream(f"{place}/{name}", compression=None)
                    member = write_record(kind, page, url, payload or b"", refers)
                    out.write(member)
                    size, n = size + len(member), n + 1
                    if size >= ARCHIVE_BYTES:
                        close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([k for _, k in done], pa.int64())], names=["path", "n_records"])

    return common.stage(typed.mapInArrow(write, "path string, n_records long"), "archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The pages in archives (column path), a row per record: page_id, url, payload (null: revisit), payload_bytes,
    payload_digest, record_type, refers_to, record_id, refers_to_record. Archives are dealt to tasks, and each is read in order."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_record", pa.string())]
    schema = pa.schema([f for f in fields if payloads or f[0] != "payload"])

    def rows(pages: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{k: p[k] for k in schema.names} for p in pages], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, place = pafs.FileSystem.from_uri(path)
                held, size = [], 0
                with files.open_input_stream(place, compression=None) as stream:
                    for head, block in read_records(stream):
                        held.append(page_of(head, block))
                        size += len(block)
                        if size > 8_000_000 or len(held) >= 5_000:
                            yield rows(held)
                            held, size = [], 0
                if held:
                    yield rows(held)

    dealt = archives.select("path").repartition(max(1, archives.count()))
    return dealt.mapInArrow(read, "page_id long, url string, " + "payload binary, " * payloads + "payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records, as read_archives() gives them, with each revisit's refers_to, payload_bytes and payload_digest from the response that
    its WARC-Refers-To names.

    What the revisit says itself must agree, or the job fails. A revisit whose response is not among the records keeps what
    it says, and refers_to null. Of responses with one record id, the smallest page_id counts.
    """
    of = records.filter((F.col("record_type") == RESPONSE) & F.col("record_id").isNotNull()).groupBy(F.col("record_id").alias("refers_to_record"))
    of = of.agg(F.min(F.struct("page_id", "payload_bytes", "payload_digest")).alias("of"))
    own = F.col("refers_to_record").isNull()
    # only revisits take part in the join
    met = records.filter(~own).join(of, "refers_to_record", "left")
    differs = lambda c, o: F.col(c).isNotNull() & F.col("of").isNotNull() & (F.col(c) != F.col(f"of.{o}"))
    wrong = differs("payload_bytes", "payload_bytes") | differs("payload_digest", "payload_digest") | differs("refers_to", "page_id")
    fail = F.raise_error(F.concat(F.lit("the revisit "), F.coalesce("record_id", F.lit("?")), F.lit(" does not match its response")))
    met = met.withColumns({
        "refers_to": F.when(wrong, fail.cast("long")).otherwise(F.col("of.page_id")),
        "payload_bytes": F.coalesce("of.payload_bytes", "payload_bytes"),
        "payload_digest": F.coalesce("of.payload_digest", "payload_digest"),
    })
    return records.filter(own).unionByName(met.select(records.columns))


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back; one row per row of pages, as read_archives() gives it.

    Null payloads count as empty; null ids come back as null, white space in URLs is dropped. An empty table writes no archive and gives
    no rows. Other columns are not read.
    """
    folder = common.fresh_path(spark, "warc")
    records = read_archives(write_archives(pages, folder, id_col, payload_col, url_col), payloads=False).drop("url")
    return resolve_revisits(common.stage(records, "records")).drop("record_id", "refers_to_record")
