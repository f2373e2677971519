"""WARC archives compressed record by record with a Zstandard dictionary that they carry."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the formats: skippable-frame magics (the dictionary's, and an empty frame that
#: separates records) and WARC's revisit profile.
DICT_MAGIC = 0x184D2A5D
GAP = struct.pack("<II", 0x184D2A50, 0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def train_dictionary(payloads: list[bytes], size: int = 65536) -> bytes:
    """A Zstandard dictionary of at most ``size`` bytes; too few samples give a raw-content one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, payloads).as_bytes()
    except zstandard.ZstdError:
        return b"".join(payloads)[-size:]


def head(dictionary: bytes) -> bytes:
    """The leading skippable frame."""
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC/1.1 record: the response, or a revisit with its HTTP head alone."""
    name = "null" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    clean = lambda u: "".join(c for c in u or "" if c not in "\r\n")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {clean(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {clean(refers_url)}"]
    block = http if refers_to is not None else http + html
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers in lower case, HTTP head, payload) of one record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of a whole archive, which needs nothing but itself to be read."""
    import zstandard

    dctx = zstandard.ZstdDecompressor()
    view, at = memoryview(archive), 0
    while at < len(archive):
        magic, n = struct.unpack_from("<II", archive, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICT_MAGIC and n:
                dctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[at + 8 : at + 8 + n]))
            at += 8 + n
            continue
        one = dctx.decompressobj()
        yield one.decompress(view[at:])
        at = len(archive) - len(one.unused_data)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """Adds refers_to and refers_url: the smallest page_id of equal payloads of ``least`` bytes or more.

    Payloads are compared by SHA-256 and length, so no payload moves. First pages are found by an
    aggregation that combines on the map side, and only groups of two or more are joined back.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha2("html", 256)).withColumn("n_bytes", F.octet_length("html"))
    first = rows.where(F.col("n_bytes") >= least).groupBy("sha", "n_bytes")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = first.agg(F.min(named).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = common.materialize(first.select("sha", "n_bytes", "first"), "warc-first")
    rows = rows.join(common.small(first), ["sha", "n_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return rows.select(
        "page_id", "url", "html", F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_url")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = 0,
    archive_bytes: int = 16 << 20,
    sample_rows: int = 1000,
    sample_bytes: int = 8 << 20,
    level: int = 3,
) -> str:
    """Write ``path``/part-*: archives of at most ``archive_bytes`` or one record; returns the path.

    Every task writes the pages that it reads, so no payload is shuffled (unless equal payloads are
    too many groups to broadcast). Every archive starts with a skippable frame that holds the
    dictionary, and each record is a frame of its own. An archive is one row to Spark's text sink, a
    file each (its line separator is an empty skippable frame, which every Zstandard reader passes
    over), so archives go to any store that Spark can write and are committed task by task. The
    dictionary is trained on whole records: at most ``sample_rows`` of them, the pages whose id
    hashes lowest, as far as their payloads fit into ``sample_bytes``.
    """
    spark = pages.sparkSession
    rows = plan_records(pages, id_col, url_col, html_col, least)
    payload = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    # ids and sizes alone are ordered; the texts of those chosen are fetched afterwards
    fit = payload.where(F.col("id").isNotNull())
    picks = fit.select("id", F.octet_length("html").alias("n")).orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    chosen, room = [], sample_bytes
    for r in picks:
        if r["n"] <= room:
            chosen.append((r["id"],))
            room -= r["n"]
    wanted = F.broadcast(spark.createDataFrame(chosen, "id long"))
    sample = [(r["id"], r["url"], r["html"].encode()) for r in fit.join(wanted, "id", "left_semi").dropDuplicates(["id"]).orderBy("id").collect()]
    records = [record(i, url, body, base32_sha1(body), None, None) for i, url, body in sample]
    dictionary = spark.sparkContext.broadcast(train_dictionary(records))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        start = head(dictionary.value)
        cctx = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None)
        held, size = [start], 0
        for batch in batches:
            for page_id, url, html, refers_to, refers_url in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                body = (html.as_py() or "").encode("utf-8", "surrogatepass")
                one = cctx.compress(record(page_id.as_py(), url.as_py(), body, base32_sha1(body), refers_to.as_py(), refers_url.as_py()))
                if size and size + len(one) > archive_bytes:
                    yield pa.RecordBatch.from_pydict({"value": [b"".join(held)]})
                    held, size = [start], 0
                held.append(one)
                size += len(one)
        if size:
            yield pa.RecordBatch.from_pydict({"value": [b"".join(held)]})

    archives = rows.mapInArrow(compress, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", GAP.decode("latin1")).option("compression", "none").text(path)
    return path


def read_archives(spark, path: str) -> DataFrame:
    """Records of every archive under ``path``: RECORDS, each response checked against its digest."""
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(path)

    def work(part: pa.RecordBatch) -> dict:
        number = lambda s: None if s is None or s == "<urn:page:null>" else int(s.rpartition(":")[2].rstrip(">"))
        rows = []
        for content in common.bytes_of(part, "content"):
            for raw in frames(content):
                fields, http, payload = parse(raw)
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
                n = int(http.decode().lower().partition("content-length: ")[2].split("\r\n")[0])
                if kind == "response" and (len(payload) != n or base32_sha1(payload) != digest):
                    raise ValueError(f"damaged record {fields['warc-record-id']}")
                rows.append((number(fields["warc-record-id"]), n, digest, kind, number(fields.get("warc-refers-to"))))
        names = [c.split()[0] for c in RECORDS.split(", ")]
        return dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True))

    return common.map_parts(files.select("content"), lambda: work, RECORDS, most=1)


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: one row per page.

    Null html is an empty payload; null urls are empty; whole payloads are written, however long;
    equal payloads (empty ones too, from ``least`` bytes) are one response and revisits to it. Rows
    that repeat a page_id and payload are all responses; a row without an id revisits the first
    that has one. Other columns are ignored. An empty table gives no archive and an empty result.
    """
    spark = pages.sparkSession
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(spark, write_archives(pages, path, **options))
