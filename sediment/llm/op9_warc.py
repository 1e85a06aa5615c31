"""WARC archives of Zstandard frames with a dictionary: a writer and a validating reader.

An archive starts with a skippable frame that holds the dictionary; each record is one frame of its own
(`.warc.zst`). The writer settles responses and revisits by a grouped minimum over payload digests; tasks
then write archives of bounded size into the shared folder under names fixed by partition and number, through
a temporary name, so that a task that runs again leaves the same files. The reader takes archives as Spark's
binary files, loads the dictionary from the leading frame, decodes frame by frame and checks lengths and digests.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_folder, small_batches, table, text_column, written

# Fixed values of the archive format.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are always stored in full.
LEAST_REVISIT = 100
#: Bytes of frames in an archive, of samples for its dictionary, and of the dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 2 << 20, 32 << 10
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that isn't whole or isn't what its headers say."""


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, headers and block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload if refers_to is None else b"")
    heads = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        heads.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        heads.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        heads += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(heads).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_dictionary(samples: list[bytes]):
    import zstandard as zstd

    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples, level=3)
    except (zstd.ZstdError, ValueError):  # too little to train on
        raw = b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\nWARC-Type: "
        return zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)


def archives(records: Iterator[bytes], most: int = ARCHIVE_BYTES) -> Iterator[tuple[bytes, int]]:
    """Whole archives, each with its number of records; only one is in memory."""
    import zstandard as zstd

    done = False
    while not done:
        first: list[bytes] = []
        size = 0
        while size < SAMPLE_BYTES and (r := next(records, None)) is not None:
            first.append(r)
            size += len(r)
        if not first:
            return
        words = make_dictionary([r[:65536] for r in first])
        press = zstd.ZstdCompressor(level=3, dict_data=words, write_checksum=True, write_content_size=True)
        held = words.as_bytes()
        out = [struct.pack("<II", DICTIONARY_MAGIC, len(held)), held]
        n, size = 0, 0
        queue = iter(first)
        while True:
            r = next(queue, None)
            if r is None:
                if size >= most or (r := next(records, None)) is None:
                    done = size < most
                    break
            frame = press.compress(r)
            out.append(frame)
            n, size = n + 1, size + len(frame)
        yield b"".join(out), n


def frame_length(data: memoryview, at: int) -> int:
    """Bytes of the frame that starts here, by its header and block headers."""
    import zstandard as zstd

    params = zstd.get_frame_parameters(bytes(data[at : at + 18]))
    pos = at + zstd.frame_header_size(bytes(data[at : at + 18]))
    while True:
        if pos + 3 > len(data):
            raise WarcError("a frame ends early")
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if (head >> 1) & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 if params.has_checksum else 0
    if pos > len(data):
        raise WarcError("a frame ends early")
    return pos - at


def parse_record(raw: bytes) -> dict:
    """Headers by lower-case name, the HTTP head and the payload; raises WarcError where lengths or digests don't hold."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("the block isn't as long as its Content-Length")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("the block isn't what its digest says")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    if fields["warc-type"] == "response":
        if len(payload) != length:
            raise WarcError("the payload isn't as long as its header says")
        if fields.get("warc-payload-digest") != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise WarcError("the payload isn't what its digest says")
    return {"fields": fields, "payload": payload, "payload_bytes": length}


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order."""
    import zstandard as zstd

    view = memoryview(data)
    if len(view) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack("<II", view[:8])
    if magic != DICTIONARY_MAGIC or 8 + size > len(view):
        raise WarcError("the leading frame isn't a dictionary")
    held = bytes(view[8 : 8 + size])
    if held[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
        held = zstd.ZstdDecompressor().decompress(held)
    unpress = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(held))
    at = 8 + size
    while at < len(view):
        if view[at : at + 4] != struct.pack("<I", FRAME_MAGIC):
            raise WarcError("not a frame")
        n = frame_length(view, at)
        yield parse_record(unpress.decompress(view[at : at + n]))
        at += n


def settle(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: a response).

    Among rows whose payloads are equal and of LEAST_REVISIT bytes or more, the smallest page_id is the response;
    rows that repeat that very page_id are responses too, and so are all where no page_id is known. Null html is an empty
    payload; payloads of any length are hashed whole. Other columns don't matter, whatever their names; an empty table gives no
    rows.
    """
    whole = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), whole.alias("payload"), F.sha2(whole, 256).alias("digest"))
    ids = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = ids.filter("n > 1").select("digest", "first_id")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages into `folder` (a URI on a store that all executors share); one row per archive: path, records, bytes.

    Null html is an empty payload, a null url leaves its header out. Repeated rows each give a record, of the
    same WARC-Record-ID, since it is made of page_id and digest. A record is held whole by its task, however long. Other columns
    don't matter, whatever their names. No rows, no archives.
    """
    small_batches(pages.sparkSession)
    ready = settle(pages, page_id, url, html).sortWithinPartitions("page_id", "digest", "url")  # each task writes what the join dealt it

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        context = TaskContext.get()

        def records() -> Iterator[bytes]:
            for b in batches:
                urls = b.column("url").to_pylist()
                payloads = text_column(b, "payload").cast(pa.binary()).to_pylist()
                for i, u, p, d, r in zip(b.column("page_id").to_pylist(), urls, payloads, b.column("digest").to_pylist(), b.column("refers_to").to_pylist(), strict=True):
                    yield record(i, u, p, d, r)

        for k, (data, n) in enumerate(archives(records())):
            path = f"{top}/part-{context.partitionId():06d}-{k:04d}.warc.zst"
            trying = f"{top}/.trying-{context.taskAttemptId()}-{k}"
            with store.open_output_stream(trying) as out:
                out.write(data)
            store.move(trying, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [len(data)]})

    return written(ready.mapInArrow(write, "path string, records long, bytes long"), "warc-index")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits).

    An archive that doesn't hold what it says fails the job. Archives are those of write_archives: each frame states its content
    size. A folder without archives gives no rows.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows, size = [], 0
                for got in read_archive(data.as_py()):
                    f = got["fields"]
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    kind = f["warc-type"]
                    rows.append({"page_id": number("warc-page-id"), "url": f.get("warc-target-uri"), "record_type": kind, "payload_bytes": got["payload_bytes"], "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha256:"), "refers_to": number("warc-refers-to-page-id"), "payload": got["payload"] if kind == "response" else None})
                    size += len(got["payload"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    folder = new_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    index = write_archives(pages, folder)
    if index.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
