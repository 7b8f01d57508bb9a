"""WARC archives: a writer with one gzip member for each record, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, shared_dir, text_or_empty

#: Fixed values of the format.
VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are always stored as responses.
LEAST_REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
#: Largest number of tasks that read archives.
MOST_TASKS = 20_000


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    """A header value without line ends or other control characters (percent-encoded)."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, payload_bytes: int | None = None) -> bytes:
    """One record. A revisit has an empty block and names the response; its own payload's length and digest stay in headers."""
    name = "none" if page_id is None else str(page_id)
    digest = payload_digest(payload)
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{digest}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {name}", f"X-Payload-Bytes: {len(payload)}"]
    block = payload
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page: {refers_to}"]
        block = b""
    head += [f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Gap(Exception):
    """A record that fails a check; ``end``: where it ends all the same, if its length can be trusted, else -1."""

    def __init__(self, why: str, end: int = -1) -> None:
        super().__init__(why)
        self.end = end


class Places:
    """Where patterns stand next in ``data``, asked for from front to back, so that each byte is looked at once."""

    def __init__(self, data: bytes) -> None:
        self.data, self.last = data, {}

    def next(self, pattern: bytes, at: int) -> int:
        """The first place at or after ``at``; the end of the data if there is none."""
        asked, found = self.last.get(pattern, (0, -1))
        if not asked <= at <= found:
            found = self.data.find(pattern, at)
            found = len(self.data) if found < 0 else found
        self.last[pattern] = at, found
        return found


def parse_record(data: bytes, at: int = 0, places: Places | None = None) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block and end of the record at ``at``; raises ``Gap`` after a failed check."""
    if not data.startswith(b"WARC/", at):
        raise Gap("no version line")
    if not VERSION_LINE.match(data, at):
        raise Gap("bad version line")
    places = places or Places(data)
    split = places.next(b"\r\n\r\n", at)
    if split == len(data) or places.next(b"\nWARC/", at) < split:
        raise Gap("headers do not end")
    head: dict[str, str] = {}
    for line in data[at:split].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Gap("bad header line")
        head[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not head.get("content-length", "").isdigit():
        raise Gap("no content length")
    start, end = split + 4, split + 4 + int(head["content-length"])
    if end > len(data):
        raise Gap("block is cut short")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Gap("block does not end where it should")
    block = data[start:end]
    wanted = head.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and wanted[5:] != payload_digest(block):
        # the record ends in its place: what looks like a record in its block is payload
        whole = end + 4 == len(data) or data.startswith((b"WARC/", MEMBER), end + 4)
        raise Gap("block digest differs", end + 4 if whole else -1)
    return head, block, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The bytes of the gzip member at ``at``, where reading ended, and what is wrong with it ("" where nothing is).

    Of a cut or damaged member come the bytes up to the place at which decompression fails.
    """
    z = zlib.decompressobj(31)
    out, pos, step = [], at, 1 << 20
    while not z.eof:
        piece = data[pos : pos + step]
        if not piece:
            return b"".join(out), pos, "member is cut short"
        try:
            out.append(z.decompress(piece))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), pos, f"bad member: {e}"
            # the failing piece gave nothing: once more up to it, then byte by byte
            z, step = zlib.decompressobj(31), 1
            for x in range(at, pos, 1 << 20):
                z.decompress(data[x : x + (1 << 20)])
            continue
        pos += len(piece)
    return b"".join(out), pos - len(z.unused_data), ""


def salvage(plain: bytes, whole: bool) -> Iterator[tuple[str, int, int, object, bytes]]:
    """Like ``read_archive``, for the bytes of a gzip member; of one that is not ``whole`` only records with a block digest."""
    at, bad, why, places = 0, -1, "", Places(plain)
    while at < len(plain):
        try:
            head, block, end = parse_record(plain, at, places)
            if not whole and not head.get("warc-block-digest", "").startswith("sha1:"):
                raise Gap("no block digest in a damaged member", end)
        except Gap as e:
            if bad < 0:
                bad, why = at, str(e)
            at = e.end if e.end > at else places.next(b"WARC/", at + 1)
            continue
        if bad >= 0:
            yield "gap", bad, at, why, b""
            bad = -1
        yield "record", at, end, head, block
        at = end
    if bad >= 0:
        yield "gap", bad, len(plain), why, b""


def read_archive(data: bytes) -> Iterator[tuple[str, int, int, object, bytes]]:
    """``("record", start, end, headers, block)`` and ``("gap", start, end, reason, b"")`` in file order.

    After a failed check the reader looks for the next place at which a whole valid record starts (a gzip member, or a
    version line in plain files and in the bytes of a member), and reports the bytes between as a gap. A plain record
    that only fails its digest is left out whole. Records and gaps in a member have the member's range, and the reason
    of such a gap names its place in the inflated bytes. A damaged member gives its valid records and then a gap that
    starts where the member does.
    """
    at, bad, why, places = 0, -1, "", Places(data)
    given, until = [], 0
    while at < len(data):
        packed, damage, past = data.startswith(MEMBER, at), "", -1
        if packed:
            plain, end, damage = inflate(data, at)
            found = list(salvage(plain, not damage))
        else:
            try:
                head, block, end = parse_record(data, at, places)
                found = [("record", at, end, head, block)]
            except Gap as e:
                found, end, damage, past = [], at, str(e), e.end
        records = [(head, block) for kind, _, _, head, block in found if kind == "record"]
        lost = bool(damage) or bool(found) and not records
        if bad >= 0 and (records or not lost):
            yield "gap", bad, at, why, b""
            bad = -1
        for kind, start, stop, head, block in found:
            # uncompressed parts of a damaged member would show its records a second time
            if kind == "record" and (packed or at >= until or (head, block) not in given):
                yield kind, at, end, head, block
            elif kind == "gap" and not lost:
                yield kind, at, end, f"{head} (inflated bytes {start} to {stop})", block
        if lost and bad < 0:
            bad, why = at, damage or str(found[0][3])
        if packed and damage and records:
            given, until = records, end
        if damage:
            end = past if past > at else min(places.next(MEMBER, at + 1), places.next(b"WARC/", at + 1))
        at = end
    if bad >= 0:
        yield "gap", bad, len(data), why, b""


def _open_fs(path: str):
    """The file system of ``path`` and the path in it; local folders need no library."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][\w+.-]*:", path) else (fs.LocalFileSystem(), path)


def plan_records(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, html, record_type, refers_to``: of equal payloads, the one with the largest id is the response."""
    base = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), text_or_empty(html).alias("html"))
    base = base.withColumn("_digest", F.sha2(F.col("html").cast("binary"), 256))
    most = base.filter(F.octet_length("html") >= LEAST_REVISIT_BYTES).groupBy("_digest").agg(F.max("page_id").alias("_most"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("_digest").alias("_same"), "_most")
    joined = base.join(most, base["_digest"] == most["_same"], "left")
    revisit = F.col("_most").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_most"))
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_most")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str, *, compress: bool = True, file_bytes: int = 64 << 20) -> DataFrame:
    """Write ``records`` (of ``plan_records``) and return the manifest ``path, n_records, n_bytes``.

    Every attempt of a task writes files of its own name; only files of the attempt that succeeded are in the
    manifest, so a lost executor leaves orphans but no double or missing record.
    """

    def run(batches):
        import pandas as pd

        system, base = _open_fs(folder)
        out, path, n, size, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, n, size))
            out = None

        for batch in batches:
            for page_id, url, html, kind, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                data = record_bytes(page_id, url, html.encode(), kind, refers)
                data = gzip_member(data) if compress else data
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * compress
                    path, n, size = f"{folder}/{name}", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    close()
        close()
        import pyarrow as pa

        frame = pd.DataFrame(done, columns=["path", "n_records", "n_bytes"])
        yield pa.RecordBatch.from_pydict({"path": pa.array(frame["path"], pa.string()), "n_records": pa.array(frame["n_records"], pa.int64()), "n_bytes": pa.array(frame["n_bytes"], pa.int64())})

    system, base = _open_fs(folder)
    system.create_dir(base, recursive=True)
    # the manifest is computed once: writing files is its side effect
    return materialize(records.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


RECORD_SCHEMA = "path string, kind string, start long, end long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string, problem string"


def read_warc(manifest: DataFrame, *, payload: bool = True) -> DataFrame:
    """Rows of ``RECORD_SCHEMA`` for the files of ``manifest(path)``: records, and gaps with their ``problem``.

    A payload digest that does not fit the block of a response is a problem of the record. ``payload`` false leaves the
    payload column null.
    """

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in RECORD_SCHEMA.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = _open_fs(path)
                with system.open_input_stream(inner, compression=None) as f:
                    data = f.read()
                rows, held = [], 0
                for kind, start, end, head, block in read_archive(data):
                    if kind == "gap":
                        rows.append((path, kind, start, end, None, None, end - start, None, None, None, None, head))
                        continue
                    number = lambda name: int(head[name]) if re.fullmatch(r"-?\d+", head.get(name, "")) else None
                    kind_of = head.get("warc-type")
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    length = number("x-payload-bytes")
                    problem = None
                    if kind_of == "response":
                        own = payload_digest(block)
                        problem = "payload digest differs" if digest not in (None, own) else None
                        digest, length = own, len(block)
                    rows.append((path, kind, start, end, number("x-page-id"), head.get("warc-target-uri"), length, digest, kind_of, number("x-refers-to-page"), block.decode("utf-8", "replace") if payload and kind_of == "response" else None, problem))
                    held += len(block) * payload
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    # a file for each task, as the number of files is known: small rows would be merged into few tasks
    tasks = max(1, min(2 * manifest.count(), MOST_TASKS))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(run, RECORD_SCHEMA)


def quarantined(back: DataFrame, folder: str) -> DataFrame:
    """Gaps, and records with a problem, of ``read_warc``'s rows; kept as Parquet in ``folder`` and named in the log."""
    back.filter("kind = 'gap' or problem is not null").select("path", "kind", "start", "end", "page_id", "payload_bytes", "problem").write.mode("overwrite").parquet(folder)
    found = back.sparkSession.read.parquet(folder)
    n, size = found.agg(F.count(F.lit(1)), F.sum(F.when(F.col("kind") == "gap", F.col("payload_bytes")))).first()
    if n:
        logging.getLogger(__name__).warning("%d quarantined parts, %d bytes of gaps: %s", n, size or 0, folder)
    return found


def round_trip(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read back from the written archives.

    Null html is an empty payload. Rows that share the largest id and the payload are all responses; a null id counts as
    smallest. An empty table writes no file and gives an empty result. Gaps and records with a problem are listed in
    ``quarantine`` under the folder, and such records are left out of the result.
    """
    where = folder or f"{shared_dir(pages.sparkSession)}/evoria/warc-{uuid.uuid4().hex}"
    manifest = write_warc(plan_records(pages, key=key, url=url, html=html), where)
    back = materialize(read_warc(manifest, payload=False), "warc-records")
    quarantined(back, f"{where}/quarantine")
    return back.filter("kind = 'record' and problem is null").select(F.col("page_id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
