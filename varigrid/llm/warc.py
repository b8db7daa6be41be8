"""WARC archives with an index made first: write, select by index, read coalesced byte ranges.

Every record is a gzip member of its own in a file of the shared folder. The task that writes a file returns its index rows, and only rows of
tasks that succeed are kept, so a lost executor leaves no wrong entry. Readers sort the selected entries by file and offset
and fetch neighbours in one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import new_path, store

_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:page:{i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(f'none-{uuid.uuid4().hex}' if page_id is None else page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Fields of an unpacked record: page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null for revisits)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda x: int(x) if x and not x.startswith("none-") else None
    bare = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
    out = {"page_id": number(bare(fields["WARC-Record-ID"])), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number(bare(fields.get("WARC-Refers-To", ""))), "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": None}
    if out["record_type"] == "response":
        if len(payload) != size or digest(payload) != out["payload_digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        out["payload"] = payload
    return out


_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows (page_id, html_sha, refers_to) of distinct pages: the smallest page_id with an equal payload, or null for responses."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.sha1(html).alias("html_sha"), F.octet_length(html).alias("bytes")).distinct()
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("html_sha").agg(F.min("page_id").alias("first"))
    role = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "html_sha", "left").select("page_id", "html_sha", role.alias("refers_to"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a WARC record below ``path``; returns the stored index.

    A null html is an empty payload, a null url leaves out its header. Of records with equal payloads of ``least_bytes`` or more, those with
    the smallest page_id are responses, the others revisits of it without payload; a null page_id is never the smallest, and records that all lack one are responses. Rows
    that repeat each get a record. A very long html is one record, in a file that may then be larger than ``file_bytes``. Without pages the index is
    empty; other columns are ignored. Columns of the index: file, offset, length, page_id, url, digest, record_type.
    """
    role = roles(pages, least_bytes).select(F.coalesce("page_id", F.lit(-1)).alias("id_"), F.col("page_id").isNull().alias("none_"), F.col("html_sha").alias("sha_"), "refers_to")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", F.encode(html, "UTF-8").alias("payload"), F.sha1(html).alias("sha"))
    rows = rows.join(role, (F.coalesce(rows.page_id, F.lit(-1)) == role.id_) & (rows.page_id.isNull() == role.none_) & (rows.sha == role.sha_)).select("page_id", "url", "payload", "refers_to")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(path)
        fs.create_dir(where, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in it:
                index = []
                for r in b.to_pylist():
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{where}/{name}", compression=None)
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = z.compress(_record(r["page_id"], r["url"], r["payload"], r["refers_to"])) + z.flush()
                    out.write(member)
                    index.append((name, at, len(member), r["page_id"], r["url"], digest(r["payload"]), "response" if r["refers_to"] is None else "revisit"))
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index, strict=True), _INDEX.types, strict=True)], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return store(rows.mapInArrow(work, "file string, offset long, length long, page_id long, url string, digest string, record_type string"), "warc-index")


def read(index: DataFrame, path: str, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """Records of the selected index rows, read in order of file and offset; ranges at most ``gap`` bytes apart share a read of up to ``most`` bytes.

    Reads are dealt by the bytes that they fetch, not by the few bytes of their index rows: to a task for each 64 MB, and to as many tasks as the session's
    shuffle partitions at least. No selected rows give no records.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(path)
        name, file = "", None
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for b in it:
            rows, i = b.to_pylist(), 0
            while i < len(rows):
                first, end, j = rows[i], rows[i]["offset"] + rows[i]["length"], i + 1
                while j < len(rows) and rows[j]["file"] == first["file"] and rows[j]["offset"] - end <= gap and rows[j]["offset"] + rows[j]["length"] - first["offset"] <= most:
                    end = max(end, rows[j]["offset"] + rows[j]["length"])
                    j += 1
                if first["file"] != name:
                    if file is not None:
                        file.close()
                    name, file = first["file"], fs.open_input_file(f"{where}/{first['file']}")
                file.seek(first["offset"])
                raw = file.read(end - first["offset"])
                parsed = [parse(zlib.decompress(raw[r["offset"] - first["offset"] :][: r["length"]], 31)) for r in rows[i:j]]
                yield pa.RecordBatch.from_pylist(parsed, schema)
                i = j

    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(index.agg(F.sum("length")).first()[0] or 0) // (64 << 20)))
    picked = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return picked.mapInArrow(work, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` to a new place in the shared folder and read all their records back."""
    path = new_path(pages.sparkSession, "warc")
    return read(write(pages, path), path)
