"""WARC archives: written with segmented records and chunked transfer framing, read back
by reassembling the segments.

A record is an HTTP response (chunked transfer coding) in blocks of at most ``segment``
bytes: the first has the origin's id and segment number 1, the rest are continuation
records, the last of them with the total length. Archives are gzip members, one a
record, rotated at ``archive_bytes``; each is written whole and then renamed, so a task
that is repeated leaves the same files. Reading parses archives in parallel; only the
blocks of segmented records are shuffled, by origin id, ordered by segment number, joined
once at a record's end, verified against the total length, and the chunked framing is decoded.

Equal payloads of ``least`` bytes or more: the smallest page_id is the response and the
others revisit it. A first scan keeps digests only; they are aggregated before any join, only
digests that occur twice are joined back to these narrow rows (hot ones apart from the
rest), and which rows revisit what comes back to the scan that writes by place
(``places``). So no html is shuffled, and a hot payload is no hot task.

Cases: null html is an empty payload; repeated rows (equal page_id and payload): one is
the response and the others revisit their own id; rows without a page_id are written
and read like others (they refer to the group's smallest id, or to nothing if none has
one). Pages of any length are written and read whole, by one task each. A truncated, gapped
or ill-framed record raises. An empty table writes nothing. Further columns aren't looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_if_null, keyed_join, partitions, read_file, shared_dir, write_file, written
from .places import FILE, ROW, Answers, placed, standing, store

SEGMENT = 16 << 10
CHUNK = 8 << 10
ARCHIVE = 64 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        p = payload[i : i + size]
        parts += [b"%x\r\n" % len(p), p, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("chunked body without an end")
        n = int(body[at:eol].split(b";")[0], 16)
        at = eol + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk of another length than it says")
        out.append(body[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower case) and block of each record of an archive."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            n = int(head["content-length"])
            block = f.read(n)
            if len(block) != n or f.read(4) != b"\r\n\r\n":
                raise ValueError("truncated record")
            yield head, block


def _id(pid: int, n: int) -> str:
    h = hashlib.md5(f"{pid}-{n}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _write(folder: str, revisits: str, segment: int, archive: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, answers = TaskContext.get().partitionId(), Answers(revisits)
        parts: list[bytes] = []
        held = files = rows = 0

        def flush():
            nonlocal parts, held, files
            path = f"{folder}/part-{pid:06d}-{files:04d}.warc.gz"
            write_file(path, b"".join(parts))
            out = pa.RecordBatch.from_pydict({"path": pa.array([path]), "size": pa.array([held], pa.int64())})
            parts, held, files = [], 0, files + 1
            return out

        for b in batches:
            hit, col = answers.find(b.column(2).to_numpy(), b.column(3).to_numpy(), "known", "refers_to")
            for i, (page_id, html) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                payload, origin = (html or "").encode(), _id(pid, rows)
                rows += 1
                page = "" if page_id is None else str(page_id)
                digest = hashlib.sha256(payload).hexdigest()
                common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("X-Page-Id", page), ("WARC-Payload-Digest", f"sha256:{digest}")]
                kind = [("WARC-Type", "revisit" if hit[i] else "response")]
                if hit[i]:
                    ref = str(col["refers_to"][i]) if col["known"][i] else ""
                    kind += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To", ref), ("X-Payload-Length", str(len(payload)))]
                    blocks = [HTTP]
                else:
                    whole = HTTP + chunked(payload)
                    blocks = [whole[i : i + segment] for i in range(0, len(whole), segment)]
                for k, block in enumerate(blocks):
                    h = [*kind, *common] if k == 0 else [("WARC-Type", "continuation"), common[0], ("WARC-Segment-Origin-ID", origin)]
                    h.append(("WARC-Record-ID", origin if k == 0 else origin.replace(">", f"-{k}>")))
                    if len(blocks) > 1:
                        h.append(("WARC-Segment-Number", str(k + 1)))
                        if k + 1 == len(blocks):
                            h.append(("WARC-Segment-Total-Length", str(sum(map(len, blocks)))))
                    parts.append(record(h, block))
                    held += len(parts[-1])
                    if held >= archive:
                        yield flush()
        if parts:
            yield flush()

    return run


def _finished(r: dict) -> tuple[int, str, bytes | None]:
    """Payload length, digest and payload of a whole record, verified."""
    block = r["block"]
    if r["record_type"] == "revisit":
        return r["length"], r["digest"], None
    if r["total"] is not None and len(block) != r["total"]:
        raise ValueError(f"record {r['origin']}: {len(block)} bytes of {r['total']}")
    head, _, body = block.partition(b"\r\n\r\n")
    payload = dechunked(body) if b"chunked" in head.lower() else body
    digest = hashlib.sha256(payload).hexdigest()
    if r["digest"] and r["digest"] != digest:
        raise ValueError(f"record {r['origin']}: payload of another digest")
    return len(payload), digest, payload


def _read(payloads: bool):
    """Records of archives: those of one segment are finished (their block is the payload, or
    nothing unless payloads are asked for), segments of others have their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = 0
        for b in batches:
            for path in b.column(0).to_pylist():
                for h, block in parse(read_file(path)):
                    more = h["warc-type"] == "continuation"
                    total = h.get("warc-segment-total-length")
                    ref = h.get("x-refers-to")
                    r = {
                        "origin": h["warc-segment-origin-id"] if more else h["warc-record-id"],
                        "number": int(h["warc-segment-number"]) if "warc-segment-number" in h else None,
                        "total": int(total) if total else None, "page_id": int(h["x-page-id"]) if h.get("x-page-id") else None,
                        "record_type": None if more else h["warc-type"], "refers_to": int(ref) if ref else None,
                        "digest": h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                        "length": int(h["x-payload-length"]) if "x-payload-length" in h else None, "block": block,
                    }
                    if r["number"] is None:
                        r["length"], r["digest"], payload = _finished(r)
                        r["block"] = payload if payloads else None
                    out.append(r)
                    held += 300 + len(r["block"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, RECORD)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, RECORD)

    return run


RECORD = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("length", pa.int64()), ("block", pa.binary())])
_RECORD = "origin string, number int, total long, page_id long, record_type string, refers_to long, digest string, length long, block binary"
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reassembled(payloads: bool):
    """Segments sorted by origin and number to finished records; one record is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict = {}
        blocks: list[bytes] = []
        out: list[tuple] = []
        held = 0

        def finish():
            if first["number"] != 1 or first["total"] is None:
                raise ValueError(f"missing segment of {first['origin']}")
            n, digest, payload = _finished(first | {"block": b"".join(blocks)})
            return first["page_id"], n, digest, first["record_type"], first["refers_to"], payload if payloads else None

        for b in batches:
            for r in b.to_pylist():
                if r["origin"] != first.get("origin"):
                    if first:
                        out.append(finish())
                        held += len(out[-1][5] or b"") + 200
                    first, blocks = r, []
                elif r["number"] != len(blocks) + 1:
                    raise ValueError(f"missing segment of {r['origin']}")
                else:
                    first["total"] = r["total"]
                blocks.append(r["block"])
                if held > 4 << 20:
                    yield _out(out)
                    out, held = [], 0
        if first:
            out.append(finish())
        if out:
            yield _out(out)

    return run


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """Place of each row of a ``standing`` table whose payload another row has as response,
    that row's page_id (``refers_to``, 0 if it has none) and whether it has one (``known``)."""
    html = F.encode(empty_if_null("html"), "utf-8")
    narrow = placed(pages, "page_id", "html").select("page_id", FILE, ROW, F.length(html).alias("bytes"), F.unhex(F.sha2(html, 256)).alias("d"))
    narrow = written(narrow.where(F.col("bytes") >= least).drop("bytes"), "digests")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", FILE, ROW)).alias("first")
    again = written(narrow.groupBy("d").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    other = (F.col(f"first.{FILE}") != F.col(FILE)) | (F.col(f"first.{ROW}") != F.col(ROW))
    to = F.col("first.page_id")
    return keyed_join(narrow, again, "d", "n").where(other).select(FILE, ROW, to.isNotNull().cast("long").alias("known"), F.coalesce(to, F.lit(0)).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT, archive_bytes: int = ARCHIVE, least: int = 100) -> DataFrame:
    """Write one record per page below ``folder``; the table of archives (path, size)."""
    pages = standing(pages)
    answers = store(revisits(pages, least))
    return written(placed(pages, "page_id", "html").mapInArrow(_write(folder, answers, segment, archive_bytes), "path string, size long"), "archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives (column ``path``), segments put together; the
    payload itself only if asked for."""
    paths = archives.select("path")
    n = max(1, min(paths.count(), 1 << 16))
    parts = written(paths.repartition(n, "path").mapInArrow(_read(payloads), _RECORD), "records")
    whole = parts.where("number is null").select(
        "page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", F.col("block").alias("payload")
    )
    seg = parts.where("number is not null").repartition(partitions(parts.sparkSession), "origin").sortWithinPartitions("origin", "number")
    return whole.unionByName(seg.mapInArrow(_reassembled(payloads), OUT))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read them back."""
    folder = shared_dir(pages.sparkSession) + "/warc"
    return read_archives(write_archives(pages, folder)).drop("payload")
