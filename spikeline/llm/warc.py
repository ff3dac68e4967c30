"""WARC: a deterministic sharded writer, and a reader that takes archives back apart.

Pages are sorted by page_id in ranges of about as many bytes, which depend on the pages and
spark.sql.shuffle.partitions alone. Each range is written by one task, a record after another, as gzip members; a file ends once it
holds ROLL compressed bytes. Headers and digests are made anew from the payload,
with a fixed date, so the same pages give the same bytes. A file is written under
a temporary name and renamed when it is complete, so a task that runs again
replaces it by itself; the manifest, written last, lists the files with sizes and
SHA-1, and readers open only what it lists.

Of pages with equal payloads of at least SMALLEST bytes the one with the largest
page_id is a response, the others revisit it: only the ids and digests of pages
meet for that, not the payloads.

Nulls: a null html is an empty payload, a null url an empty target; pages without
page_id come first, are never referred to and are all responses. Many pages without
page_id, or with one and the same, are parted by a hash of the payload. Of rows that repeat the largest page_id one is the response. Extra columns don't
matter; no rows give an empty manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Ranges, materialize, partitions, read, shared_dir, shuffles_removed, utf8

SMALLEST = 1000
ROLL = 16 << 20
LEVEL = 4
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6f1f0c1e-1d1b-4b8e-9d57-3f6f6f3c2a10")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}|{digest}')}>"


def _one_line(url: str | None) -> str:
    return "".join((url or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[bytes]:
    """A file's gzip members, cut without copying the rest again and again."""
    view, at = memoryview(data), 0
    while at < len(data):
        member = zlib.decompressobj(31)
        step, parts = 1 << 16, []
        while not member.eof:
            chunk = view[at : at + step]
            if not chunk:
                raise ValueError("a member is cut off")
            parts.append(member.decompress(chunk))
            at += len(chunk) - len(member.unused_data)
        yield b"".join(parts)


def records_of(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of the records in uncompressed bytes; ValueError if one is broken."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a header is cut off")
        version, *lines = raw[at:end].decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {version[:20]!r}")
        header = dict((k, v.strip()) for k, _, v in (x.partition(":") for x in lines))
        size = int(header["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        if len(block) != size or raw[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        if header.get("WARC-Block-Digest") != f"sha1:{hashlib.sha1(block).hexdigest()}":
            raise ValueError("a block's digest differs")
        yield header, block


def plan_revisits(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """page_id, refers_to, digest and tie of all pages whose payload another page has too. pages: page_id, html (binary)."""
    light = pages.where(F.col("page_id").isNotNull() & (F.length("html") >= smallest)).select("page_id", F.sha1("html").alias("digest"), F.xxhash64("html").alias("tie"))
    light = materialize(light, "digests")
    last = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return light.join(last, "digest").select("page_id", "refers_to", "digest", "tie")


MANIFEST = "file string, records long, bytes long, sha1 string"


def write_warc(pages: DataFrame, path: str, roll: int = ROLL, smallest: int = SMALLEST) -> DataFrame:
    """Writes pages (page_id, url, html) under path and returns the manifest, which is at path/manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", utf8("html").alias("html"))
    tie = F.xxhash64("html")
    ranges = Ranges(rows, "page_id", tie, partitions(rows), F.length("html").cast("long") + 256)
    keyed = rows.withColumn("tie", tie).withColumn("part", ranges.number())
    notes = plan_revisits(rows, smallest).withColumn("html", F.lit(None).cast("binary"))
    # a page is dealt by its html, its note by the tie that stands for it
    ranges.tie = F.col("tie")
    notes = notes.select(ranges.number().alias("part"), F.lit(0).alias("kind"), "page_id", F.col("digest").alias("url"), "html", "refers_to", "tie")
    both = keyed.select("part", F.lit(1).alias("kind"), "page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"), "tie").unionByName(notes)
    # a page's notes come before it; rows that repeat a page_id in a fixed order
    ordered = both.repartitionById(ranges.count, "part").sortWithinPartitions("part", F.col("page_id").asc_nulls_first(), "tie", "kind", "url", "html").drop("tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        state = {"part": None, "number": 0, "bytes": 0, "records": 0}
        sink, digest = None, None

        def close() -> pa.RecordBatch:
            nonlocal sink
            sink.close()
            name = f"part-{state['part']:06d}-{state['number']:06d}.warc.gz"
            store.move(state["temporary"], f"{root}/{name}")
            sink = None
            state["number"] += 1
            return pa.RecordBatch.from_pydict({"file": [name], "records": [state["records"]], "bytes": [state["bytes"]], "sha1": [digest.hexdigest()]})

        page, notes_here, answered = object(), {}, set()
        for batch in batches:
            for of, kind, page_id, url, html, refers_to in zip(*batch.columns):
                of, page_id, url = of.as_py(), page_id.as_py(), url.as_py()
                if page_id != page:
                    page, notes_here, answered = page_id, {}, set()
                if not kind.as_py():
                    notes_here[url] = refers_to.as_py()
                    continue
                if sink is not None and (of != state["part"] or state["bytes"] >= roll):
                    yield close()
                if of != state["part"]:
                    state |= {"part": of, "number": 0}
                payload = html.as_py()
                sha = hashlib.sha1(payload).hexdigest()
                target = notes_here.get(sha)
                if target == page_id and target is not None and sha not in answered:
                    answered.add(sha)
                    target = None
                if sink is None:
                    state |= {"bytes": 0, "records": 0, "temporary": f"{root}/.{uuid.uuid4().hex}.tmp"}
                    sink, digest = store.open_output_stream(state["temporary"], compression=None), hashlib.sha1()
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id, url, payload, sha, target)) + packer.flush()
                sink.write(data)
                digest.update(data)
                state["bytes"] += len(data)
                state["records"] += 1
        if sink is not None:
            yield close()

    # written once: the files' names are final when the manifest is
    with shuffles_removed(spark):
        ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload (null
    for revisits) of the records in the files that the manifest lists."""
    manifest = spark.read.parquet(f"{path}/manifest")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, sha in zip(batch.column("file").to_pylist(), batch.column("sha1").to_pylist()):
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha1(data).hexdigest() != sha:
                    raise ValueError(f"{name} differs from its manifest")
                out, size = [], 0
                for member in members(data):
                    ((header, block),) = records_of(member)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    revisit = header["WARC-Type"] == "revisit"
                    digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"a payload in {name} differs from its header")
                    page = header.get("WARC-Page-ID")
                    out.append((int(page) if page else None, length, digest, header["WARC-Type"], int(header["WARC-Refers-To-Page"]) if revisit else None, header["WARC-Target-URI"], None if revisit else payload))
                    size += len(block)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    files = min(max(1, manifest.count()), 200_000)  # tasks for them
    number = F.row_number().over(Window.orderBy("file"))  # over one row a file
    return manifest.select("file", "sha1", F.pmod(number, F.lit(files)).cast("int").alias("task")).repartitionById(files, "task").drop("task").mapInArrow(parse, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files and read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(read(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).drop("url", "payload")


QUERIES = {"op9_warc": op9_warc}
ORACLE = {
    "op9_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= {SMALLEST} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {SMALLEST} AND page_id <> last THEN last END AS refers_to
FROM m"""
}
