"""WARC archives with an index written first, and coalesced byte-range reads.

Writing: each task appends gzip members, one per record, to archives of bounded size in the shared folder, and
returns an index row per record (file, offset, length, URL, digest). The index is a table before anything is
read. Reading: the selected index rows are dealt by ranges of (file, offset), as many as the bytes to read ask for, and
neighbouring ranges are read in one request.

A file's name holds a random part, so a task that is run again (a lost executor) writes new files; the index
refers to those of the attempt that succeeded.

Records with equal payloads of at least `min_revisit` bytes: the one with the largest page_id is a response, the others
are revisits that refer to it. A digest that a third of all pages share is dealt over many tasks.

Defined cases: null html is an empty payload; null url is an empty target URI; empty tables give no rows; rows
that repeat a page_id write a record each (those with the largest page_id of a payload are all responses); a row with a null page_id
is a response; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import join_hot, materialize, new_path

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
#: Ranges less than this far apart are read together.
GAP = 64 << 10
#: A coalesced read holds at most this much, unless one record is larger.
READ_BYTES = 8 << 20
#: Revisits up to which they are broadcast (about 100 bytes each).
BROADCAST_REVISITS = 500_000
_STAMP = "2024-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def number(text: str | None) -> int | None:
    return int(text) if text else None


def frame(rows: list[tuple], kind: str):
    """rows as a pandas frame with exact nullable integers."""
    import pandas as pd

    names = [x.split() for x in kind.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pd.DataFrame({n: pd.array(c, dtype="Int64") if t == "long" else pd.Series(c, dtype=object) for (n, t), c in zip(names, cols, strict=True)})


def record(page_id: str | None, url: str | None, payload: bytes | None, payload_bytes: int, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; payload None makes a revisit."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id or ''}>",
        f"WARC-Date: {_STAMP}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {payload_bytes}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + (payload or b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_types(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    Digests are grouped without the payloads. Only the pages that revisit come back, by page_id and digest; while they
    are counted to be few they are broadcast, and payloads aren't shuffled at all.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    p = pages.select("page_id", "url", "html", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    digests = materialize(p.where(F.col("payload_bytes") >= min_revisit).select("page_id", "payload_digest"), "digests")
    shared = digests.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "last")
    revisits = join_hot(digests, shared, "payload_digest", "page_id").where("page_id <> last").distinct()
    revisits = materialize(revisits.select("page_id", "payload_digest", "last"), "revisits")
    few = F.broadcast(revisits) if revisits.count() <= BROADCAST_REVISITS else revisits
    kind = F.when(F.col("last").isNotNull(), "revisit").otherwise("response").alias("record_type")
    return p.join(few, ["page_id", "payload_digest"], "left").select("page_id", "url", "html", "payload_bytes", "payload_digest", kind, F.col("last").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the typed pages as .warc.gz files under folder (any URI that pyarrow can open); returns the index, as a table."""

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for r in b.itertuples(index=False):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    refers = r.refers_to or None
                    payload = (r.html or "").encode() if r.record_type == "response" else None
                    data = gzip.compress(record(r.page_id, r.url, payload, r.payload_bytes, r.payload_digest, refers), 5, mtime=0)
                    out.write(data)
                    rows.append((name, at, len(data), number(r.page_id), r.url, r.record_type, number(refers), r.payload_bytes, r.payload_digest))
                    at += len(data)
                yield frame(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    # ids travel as strings: pandas would turn nullable longs into floats
    ids = {x: F.col(x).cast("string") for x in ("page_id", "refers_to")}
    return materialize(pages.withColumns(ids).mapInPandas(write, INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, ranges) of the reads that cover the ranges, sorted by (offset, length)."""
    run: list[tuple[int, int]] = []
    start = end = 0
    for offset, length in sorted(ranges):
        if run and (offset - end > gap or offset + length - start > most):
            yield start, end, run
            run = []
        if not run:
            start = end = offset
        run.append((offset, length))
        end = max(end, offset + length)
    if run:
        yield start, end, run


def read_records(index: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, html of the indexed records.

    A task for every archive, or for every `archive_bytes` of the selected records if that is more; adaptive execution doesn't merge them by
    the size of the index. Sorted by file and offset inside each partition, so a task reads forward. A digest that doesn't fit its payload
    is an error. html is null for revisits.
    """
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"

    def read(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            rows = []
            for name, part in b.groupby("file", sort=False):
                with store.open_input_file(f"{root}/{name}") as f:
                    for start, end, run in coalesced(list(zip(part["offset"].tolist(), part["length"].tolist(), strict=True))):
                        data = f.read_at(end - start, start)
                        for offset, length in run:
                            head, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            whole = head["WARC-Type"] == "response"
                            if whole and hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"damaged record at {offset} of {name}")
                            refers = head.get("WARC-Refers-To")
                            rows.append((number(head["WARC-Record-ID"][10:-1]), head["WARC-Target-URI"], len(payload) if whole else int(head["X-Payload-Bytes"]), digest, head["WARC-Type"], number(refers[10:-1]) if refers else None, payload.decode() if whole else None))
                    if sum(len(r[6] or "") for r in rows) > READ_BYTES:
                        yield frame(rows, kind)
                        rows = []
            yield frame(rows, kind)

    size = index.agg(F.countDistinct("file").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, size["files"], -(-size["bytes"] // archive_bytes))
    return index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInPandas(read, kind)


def archive_round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write all pages, then read them all back through the index."""
    folder = new_path(pages.sparkSession, "warc")
    return read_records(write_archives(with_types(pages, min_revisit), folder), folder)
