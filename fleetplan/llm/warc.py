"""Web archives: pages to WARC records and back, with segmented records and chunked transfer coding.

Writing: a page whose payload another page with a smaller id already has becomes a ``revisit`` record, all
others ``response`` records. The response's HTTP message carries its payload in chunked transfer coding; a
message longer than a segment is cut, the rest goes into ``continuation`` records of a second file. Every
record is a gzip member of its own.

Reading: records of one part are decoded where they are read. Parts of a segmented record are grouped by
the identifier of their origin, ordered by segment number, checked against the total length that the last
part states, and joined before the transfer coding is undone. Digests are checked.

Null or odd input: a null payload is empty; a null page id is written as such and is larger than all others;
repeated rows are each written and read, and those with the smallest id of a payload are all responses;
control characters of a URL are percent-encoded; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetplan.llm.files import new_folder, read_file, write_file
from fleetplan.llm.texts import short_batches
from fleetplan.session import stage

#: Bytes of an HTTP message in one record, and of a chunk.
SEGMENT_BYTES, CHUNK_BYTES = 48 << 10, 8 << 10
#: Bytes of payload after which a task begins new files.
FILE_BYTES = 32 << 20
_DATE = "2024-01-01T00:00:00Z"
_KINDS = (
    "page_id {id}, url string, record_type string, refers_to {id}, payload binary, payload_bytes bigint, payload_digest string, "
    "origin string, segment int, total bigint"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer coding."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + size])
        if len(out[-1]) != size:
            raise ValueError("a chunk is cut short")
        at = stop + 4 + size


def record(fields: dict[str, object], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "Content-Length": len(block)}.items() if v is not None)
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def records(data: bytes, block: int = 16 << 10) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and blocks of an archive of gzip members. The archive is handed on in small blocks, so that what
    follows a member is not copied for each of them."""
    view, at = memoryview(data), 0
    while at < len(view):
        opener, parts = zlib.decompressobj(31), []
        while not opener.eof:
            piece = view[at : at + block]
            if not len(piece):
                raise ValueError("a record is cut short")
            parts.append(opener.decompress(piece))
            at += len(piece) - len(opener.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _new_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def page_records(page: object, url: str | None, payload: bytes, digest: str, first: object, revisit: bool, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page of this payload digest: itself, and continuations if its message is long."""
    name = _new_id()
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": name,
        "WARC-Date": _DATE,
        "WARC-Target-URI": None if url is None else _safe(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Page-ID": page,
    }
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Refers-To-Page-ID": first}
        return [record(fields, head + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) > 1:
        fields["WARC-Segment-Number"] = 1
    out = [record(fields, parts[0])]
    for i, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": _new_id(), "WARC-Date": _DATE, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": i}
        out.append(record(more | ({"WARC-Segment-Total-Length": len(block)} if i == len(parts) else {}), part))
    return out


def message_payload(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write all pages and return the stored list of archives (folder, file, segmented).

    Records of messages that fit one segment are in files of their own, all segments of longer ones in others, so that a reader
    takes each file once. Pages with equal payloads of at least ``min_bytes`` bytes refer to the one with the smallest id.
    """
    spark = pages.sparkSession
    short_batches(spark)
    folder = folder or new_folder(spark, "warc")
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "utf-8")))
    firsts = rows.groupBy("digest").agg(F.min("page").alias("first"))
    revisit = (F.octet_length("payload") >= min_bytes) & ~F.col("page").eqNullSafe(F.col("first"))
    marked = rows.join(firsts, "digest").select("page", "url", "payload", "digest", "first", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, main, more, size, n = TaskContext.get().partitionId(), [], [], 0, 0

        def close():
            names = [write_file(folder, f"pages-{task:07d}-{n}{end}.warc.gz", part) for end, part in (("", main), ("-segments", more)) if part]
            return pa.RecordBatch.from_pydict({"folder": [folder] * len(names), "file": names, "segmented": ["-segments" in name for name in names]})

        for batch in batches:
            for page, at, text, digest, first, again in zip(*[c.to_pylist() for c in batch.columns]):
                payload = text.encode()
                own = page_records(page, at, payload, base64.b32encode(bytes.fromhex(digest)).decode(), first, again)
                (main if len(own) == 1 else more).extend(own)
                size += len(payload)
                if size > FILE_BYTES:
                    yield close()
                    main, more, size, n = [], [], 0, n + 1
        if main or more:
            yield close()

    return stage(marked.mapInArrow(write, "folder string, file string, segmented boolean"), "warc-list")


def _row(fields: dict[str, str], payload: bytes | None, number) -> dict:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and digest_of(payload) != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
    return {
        "page_id": number(fields.get("Page-ID")),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("Refers-To-Page-ID")),
        "payload": payload,
        "payload_bytes": None if payload is None else len(payload),
        "payload_digest": digest,
    }


def read_archives(archives: DataFrame, key: str = "page_id", key_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """One row for each page: (``key``, url, record_type, refers_to, payload, payload_bytes, payload_digest).

    A revisit has no payload of its own; its bytes and digest are those of the full payload. Without ``payloads`` that
    column is absent, and payloads that need no other record do not leave the task that has checked them.
    """
    kinds = _KINDS.format(id=key_type)
    number = str if key_type == "string" else int
    cast = lambda v: None if v is None else number(v)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in kinds.split(", ")])

    def parse(segmented: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for folder, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows, size = [], 0
                    for fields, block in records(read_file(folder, file)):
                        part = fields.get("WARC-Segment-Number")
                        if (part is not None) != segmented:
                            raise ValueError(f"{file}: a record does not belong there")
                        if fields["WARC-Type"] == "continuation":
                            row = {"origin": fields["WARC-Segment-Origin-ID"], "segment": int(part), "total": cast_total(fields), "payload": block}
                        elif segmented:
                            row = _row(fields, None, cast) | {"origin": fields["WARC-Record-ID"], "segment": 1, "payload": block}
                        elif fields["WARC-Type"] == "revisit":
                            length = re.search(rb"(?i)content-length: (\d+)", block)
                            row = _row(fields, None, cast) | {"payload_bytes": int(length[1])}
                        else:
                            row = _row(fields, message_payload(block), cast)
                            row = row if payloads else row | {"payload": None}
                        rows.append(row)
                        size += len(row.get("payload") or b"") + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

        return run

    def cast_total(fields):
        total = fields.get("WARC-Segment-Total-Length")
        return None if total is None else int(total)

    def join(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["segment"])
        block = b"".join(p["payload"] for p in parts)
        if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
            raise ValueError(f"{parts[0]['origin']}: segments are missing")
        payload = message_payload(block)
        if digest_of(payload) != parts[0]["payload_digest"]:
            raise ValueError(f"{parts[0]['origin']}: the payload does not have its digest")
        return pa.Table.from_pylist([parts[0] | {"payload": payload if payloads else None, "payload_bytes": len(payload)}], schema)

    listed = archives.repartition(max(1, archives.count()), "file")
    whole = listed.where("NOT segmented").mapInArrow(parse(False), kinds)
    joined = listed.where("segmented").mapInArrow(parse(True), kinds).groupBy("origin").applyInArrow(join, kinds)
    found = whole.unionByName(joined).drop("origin", "segment", "total", *([] if payloads else ["payload"]))
    return found.withColumnRenamed("page_id", key)
