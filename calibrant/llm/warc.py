"""WARC archives: writing, normalising monolithic gzip files, and reading through the offset index.

Spark's text sink writes the archives (records end in the separator, and a compressed part is one gzip
stream). The normaliser inflates each such file once as a stream, rewrites every record as a gzip member of
its own and writes a sidecar index, so that a reader can take any range of records.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm.common import cut, filled, need, scratch

END = "\r\n\r\n"
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """value, the text of one WARC record per row of ``pages`` (page_id, url, html).

    Of equal payloads of at least ``revisit_bytes`` the row with the largest page_id is the response, others
    revisit it; a null page_id is smaller than any; rows that repeat the largest are all responses.
    """
    base = need(pages, "page_id", "url", "html").select("page_id", F.regexp_replace(filled("url"), r"[\r\n]", " ").alias("url"), filled("html").alias("html"))
    base = base.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    copies = base.where(F.col("size") >= revisit_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = base.join(copies, ["sha", "size"], "left")
    again = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    return told.select(F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _header("WARC-Record-ID", name(F.col("page_id"))),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        F.when(again, F.concat(_header("WARC-Refers-To", name(F.col("keep"))), _header("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block,
    ).alias("value"))


def write_monolithic(pages: DataFrame, path: str) -> None:
    """Write the records of ``pages`` below ``path``, each part one gzip stream."""
    records(pages).write.option("lineSep", END).option("compression", "gzip").text(path)


def _opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, in bounded chunks."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = inflate.decompress(data, CHUNK)
            if out:
                yield out
            data = inflate.unconsumed_tail
            if inflate.eof:
                data = inflate.unused_data
                inflate = zlib.decompressobj(31)


def parsed(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, header bytes and block of each record; holds one record at a time.

    Raises ValueError when the stream ends within a record.
    """
    held, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        chunk = next(chunks, None)
        ended = chunk is None
        held.extend(chunk or b"")
        return not ended

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if at < 0:
            if held.strip():
                raise ValueError("the archive ends within a record's header")
            return
        head = bytes(held[: at + 4])
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:60]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        while len(held) < at + 4 + size + 4 and more():
            pass
        if len(held) < at + 4 + size + 4:
            raise ValueError("the archive ends within a record's block")
        yield headers, head, bytes(held[at + 4 : at + 4 + size])
        del held[: at + 4 + size + 4]


INDEX = "archive string, offset long, length long, record_id string, record_type string, uri string, digest string"


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite each gzip file below ``source`` under ``target`` with one member per record; returns the index
    (one row per record), which is also beside each archive as ``<name>.idx`` (JSON lines).

    A file is a task's unit; a record is what it holds in memory. Files are written under a name of the
    attempt and renamed when whole, so a retried or speculative task leaves whole files only.
    """
    listed = spark.read.format("binaryFile").load(source).select("path", "length")
    n = max(1, listed.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if not path.endswith(".gz"):
                    continue
                name = re.sub(r"(\.txt|\.warc)?\.gz$", "", path.rpartition("/")[2])
                fs, root = _opened(target)
                fs.create_dir(root, recursive=True)
                final, attempt = f"{root}/{name}.warc.gz", f".{TaskContext.get().taskAttemptId()}.tmp"
                src, where = _opened(path)
                at, entries = 0, []
                with src.open_input_stream(where, compression=None) as stream, fs.open_output_stream(final + attempt, compression=None) as out, fs.open_output_stream(final + ".idx" + attempt, compression=None) as side:
                    for headers, head, block in parsed(_inflated(stream)):
                        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = deflate.compress(head + block + b"\r\n\r\n") + deflate.flush()
                        out.write(member)
                        entry = (f"{target}/{name}.warc.gz", at, len(member), *[headers.get(k, "") for k in ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest")])
                        side.write((json.dumps(dict(zip(("archive", "offset", "length", "record_id", "record_type", "uri", "digest"), entry))) + "\n").encode())
                        at += len(member)
                        entries.append(entry)
                        if len(entries) == 10_000:
                            yield _index(entries)
                            entries = []
                for whole in (final, final + ".idx"):
                    if fs.get_file_info(whole).is_file:  # an attempt before this one left it, with equal bytes
                        fs.delete_file(whole + attempt)
                    else:
                        fs.move(whole + attempt, whole)
                if entries:
                    yield _index(entries)

    return cut(listed.repartitionByRange(n, "path").mapInArrow(run, INDEX), "warc-index")


def _index(entries: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries), kinds)], ["archive", "offset", "length", "record_id", "record_type", "uri", "digest"])


READ = "record_id string, record_type string, refers_to string, declared string, payload_bytes long, payload_digest string"


def read_indexed(index: DataFrame, records_per_task: int = 20_000) -> DataFrame:
    """Each record of the index, read by its offset: ids, declared payload digest, and length and SHA-1 of the
    payload that it holds (nothing for a revisit). Records of one archive may go to several tasks."""
    n = max(1, -(-index.count() // records_per_task))
    size = 4 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, name = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    fs, where = _opened(archive)
                    handle, name = fs.open_input_file(where), archive
                handle.seek(offset)
                held = handle.read(length)
                for headers, _, block in parsed(_inflated(pa.BufferReader(held))):
                    payload = block.partition(b"\r\n\r\n")[2]
                    rows.append((headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-refers-to"), headers.get("warc-payload-digest", "").removeprefix("sha1:"), len(payload), hashlib.sha1(payload).hexdigest()))
            kinds = [*[pa.string()] * 4, pa.int64(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["record_id", "record_type", "refers_to", "declared", "payload_bytes", "payload_digest"])

    spread = index.select("archive", "offset", "length").repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(run, READ)


def op1_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive, normalise and read back ``pages``: page_id, payload_bytes, payload_digest, record_type,
    refers_to. A revisit takes its payload's length and digest from the response that it refers to.

    Null html is an empty payload, a null url an empty URI; a null page_id comes back null; repeated rows
    are repeated records; no rows give no rows; other columns are not read.
    """
    mono, clean = scratch(spark, "warc-monolithic"), scratch(spark, "warc")
    write_monolithic(pages, mono)
    found = read_indexed(normalise(spark, mono, clean))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    found = cut(found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("coalesce(refers_to, '')").alias("refers_to")), "warc-read")
    revisits = found.where("record_type = 'revisit'")
    targets = found.where("record_type = 'response'").select(F.col("page_id").alias("target"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")).distinct()
    solved = revisits.join(targets, F.col("refers_to") == F.col("target"), "left").select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to")
    return found.where("record_type = 'response'").unionByName(solved)
