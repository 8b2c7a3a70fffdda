"""Web archives (WARC 1.1, one gzip member a record): reading, revisit resolution, deduplicated writing.

Headers alone are shuffled, by payload digest: each digest's earliest response (by date, then page id, then url, nulls last)
is its original, and every other response or revisit of the digest refers to it. The deduplicated archives hold the
originals whole and revisit records for the rest, all with fresh headers (ids, dates, lengths, digests, references).
Payloads are never shuffled: what is to become of a row is written down by the file that it stands in, and the task that
reads the file looks it up; archives are rewritten by the task that holds their headers, which reads each original by its
offset. Archives are read and written where the tasks run, through the file system that the shared path names; a task
writes to a name of its own and moves the file into place at its end, so a task that runs twice leaves one file.

Header values that hold control characters or outer blanks are written percent-encoded, with the exact value beside them in
a header of its own, from which they are read back.

Defined cases: a page without html has the digest of the empty text; rows equal in id, url and html are one record; of
equal payloads under other urls or ids all but the first are revisits; ids are of any type that a cast to text and back
keeps, null urls and ids are kept as such; urls and pages of any length are carried whole; a revisit whose original is
nowhere stays a revisit, with the references it came with; no pages, no archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.common import maybe_broadcast, scratch_dir, stored, text_batches

#: Date of records whose source has none.
DATE = "2024-01-01T00:00:00Z"
HEADERS = "page_id string, url string, warc_type string, date string, payload_digest string, payload_length long, record_id string, refers_to string, refers_to_uri string, refers_to_date string, archive string, offset long"
_NAMES = [x.split()[0] for x in HEADERS.split(", ")]
_CRLF = b"\r\n"
_UNFIT, _EXACT = re.compile("[\x00-\x1f\x7f-\x9f\u2028\u2029]"), "X-Exact-"


def digest_of(payload: bytes) -> str:
    return "sha256:" + hashlib.sha256(payload).hexdigest()


def _plain(value: str) -> str:
    """``value`` fit for a header line."""
    coded = _UNFIT.sub(lambda m: quote(m[0], safe=""), value)
    head, tail = len(coded) - len(coded.lstrip()), len(coded.rstrip())
    return quote(coded[:head], safe="") + coded[head:tail] + quote(coded[max(tail, head) :], safe="")


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as one gzip member."""
    lines = []
    for k, v in [("WARC-Type", kind), *fields, ("WARC-Block-Digest", digest_of(block)), ("Content-Length", str(len(block)))]:
        if v is not None:
            lines.append((k, _plain(v)))
            if lines[-1][1] != v:
                lines.append((_EXACT + k, base64.b64encode(v.encode()).decode()))
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}".encode() + _CRLF for k, v in lines)
    return gzip.compress(head + _CRLF + block + _CRLF + _CRLF, 6, mtime=0)


def http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def urn(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(of))}>"


def records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers in lower case, block) of each record of a plain or gzipped archive; a broken end ends it."""
    data, base = b"", 0
    while True:
        if len(data) < 65536:
            data += stream.read(1 << 20)
        if not data:
            return
        if data[:2] == b"\x1f\x8b":
            unzip = zlib.decompressobj(31)
            parts, used = [], 0
            while not unzip.eof:
                parts.append(unzip.decompress(data))
                used += len(data) - len(unzip.unused_data)
                data = unzip.unused_data
                if not unzip.eof and not (data := stream.read(1 << 20)):
                    return
            whole = b"".join(parts)
            head, _, rest = whole.partition(b"\r\n\r\n")
            yield base, _fields(head), rest[: int(_fields(head).get("content-length", 0))]
            base += used
        else:
            while (end := data.find(b"\r\n\r\n")) < 0:
                if not (more := stream.read(1 << 20)):
                    return
                data += more
            fields = _fields(data[:end])
            size = end + 4 + int(fields.get("content-length", 0)) + 4
            while len(data) < size and (more := stream.read(1 << 20)):
                data += more
            yield base, fields, data[end + 4 : size - 4]
            base, data = base + size, data[size:]


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    out = {k.strip().lower(): v.strip() for k, _, v in pairs}
    exact = {k.removeprefix(_EXACT.lower()): base64.b64decode(v).decode() for k, v in out.items() if k.startswith(_EXACT.lower())}
    return {k: v for k, v in out.items() if not k.startswith(_EXACT.lower())} | exact


def _open(path: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(path) if "://" in path else (pfs.LocalFileSystem(), path.removeprefix("file:"))


def read_headers(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """The headers of all response and revisit records of the archives named in column ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _open(path)
                rows: list[tuple] = []
                with fs.open_input_stream(name, compression=None) as stream:
                    for offset, h, block in records(stream):
                        kind, digest = h.get("warc-type"), h.get("warc-payload-digest")
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            length, digest = len(payload), digest or digest_of(payload)
                        elif kind == "revisit":
                            length = int(x) if (x := h.get("warc-refers-to-payload-length")) else None
                        else:
                            continue
                        rows.append((h.get("warc-page-id"), h.get("warc-target-uri"), kind, h.get("warc-date"), digest, length, h.get("warc-record-id"), h.get("warc-refers-to-page-id"), h.get("warc-refers-to-target-uri"), h.get("warc-refers-to-date"), path, offset))
                        if len(rows) == 20_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return paths.select("path").mapInArrow(run, HEADERS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if n in ("payload_length", "offset") else pa.string() for n in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _NAMES)


def _order(*columns: str):
    """A struct to order by, nulls last."""
    return F.struct(*[x for c in columns for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])


def resolved(headers: DataFrame) -> DataFrame:
    """``headers`` (page_id, url, warc_type, date, payload_digest) with ``original``, the struct (date, page_id, url) of the
    digest's earliest response, null if there is none: one shuffle of headers, combined before it."""
    first = F.min(F.when(F.col("warc_type") == "response", _order("date", "page_id", "url")))
    least = headers.groupBy("payload_digest").agg(first.alias("f"), F.count("*").alias("n"))
    shared = least.where("n > 1 or f is null").select(F.col("payload_digest").alias("d"), F.col("f.date").alias("__date"), F.col("f.page_id").alias("__id"), F.col("f.url").alias("__url"), F.col("f").isNotNull().alias("__is"))
    own = F.when(F.col("d").isNull(), F.struct("date", "page_id", "url")).when(F.col("__is"), F.struct(F.col("__date").alias("date"), F.col("__id").alias("page_id"), F.col("__url").alias("url")))
    return headers.join(maybe_broadcast(stored(shared, "shared")), F.col("payload_digest") == F.col("d"), "left").withColumn("original", own).drop("d", "__date", "__id", "__url", "__is")


class _Archive:
    """One archive that a task writes, under a name of its own until it is whole."""

    def __init__(self, folder: str):
        task = TaskContext.get()
        self.name, self.folder = f"part-{task.partitionId():06d}.warc.gz", folder
        self.fs, self.base = _open(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.draft = posixpath.join(self.base, f"_{self.name}-{task.taskAttemptId()}-{uuid.uuid4().hex}")
        self.out, self.count = self.fs.open_output_stream(self.draft, compression=None), 0

    def response(self, page, url, date, digest, block: bytes) -> None:
        self._write("response", [*self._own(page, url, date, digest), ("Content-Type", "application/http;msgtype=response")], block)

    def revisit(self, page, url, date, digest, refers: list[tuple[str, str | None]]) -> None:
        self._write("revisit", [*self._own(page, url, date, digest), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *refers], b"")

    @staticmethod
    def _own(page, url, date, digest) -> list[tuple[str, str | None]]:
        return [("WARC-Record-ID", urn(page, url, digest)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Page-ID", page), ("WARC-Payload-Digest", digest)]

    def _write(self, *of) -> None:
        self.out.write(record(*of))
        self.count += 1

    def end(self) -> Iterator[pa.RecordBatch]:
        """Put the archive into place; its path, unless it has no record."""
        self.out.close()
        if not self.count:
            self.fs.delete_file(self.draft)
            return
        final = posixpath.join(self.base, self.name)
        if self.fs.get_file_info(final).type != pfs.FileType.NotFound:  # an earlier attempt's, with the same records
            self.fs.delete_file(final)
        self.fs.move(self.draft, final)
        yield pa.RecordBatch.from_arrays([pa.array([f"{self.folder}/{self.name}"])], ["path"])


def _refers(digest: str, page, url, date, length: int | None) -> list[tuple[str, str | None]]:
    return [("WARC-Refers-To", urn(page, url, digest)), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Refers-To-Page-ID", page), ("WARC-Refers-To-Payload-Length", None if length is None else str(length))]


def _located(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, file, at): rows with the file they stand in and their place there. What does not come straight
    from columnar files is written to the shared folder first."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    try:
        return pages.select("page_id", "url", "html", *place)
    except AnalysisException:
        return stored(pages.select("page_id", "url", "html"), "pages").select("page_id", "url", "html", *place)


def _written(folder: str, marks: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(marks)
        out = _Archive(folder)
        known: tuple = (None, {})
        once = set()
        for batch in text_batches(batches, 2):
            for page, url, html, file, at, bucket in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != known[0]:
                    path = posixpath.join(base, f"bucket={bucket}")
                    rows = [] if fs.get_file_info(path).type == pfs.FileType.NotFound else ds.dataset(path, filesystem=fs, format="parquet").to_table(filter=ds.field("file") == file).to_pylist()
                    known = (file, {(r["at"], r["page_id"], r["url"], r["payload_digest"]): r for r in rows})
                payload = (html or "").encode()
                digest = digest_of(payload)
                mark = known[1].get((at, page, url, digest))
                if mark is not None and mark["copies"] > 1:  # of equal rows one is a record
                    if not mark["keep"] or (page, url, digest) in once:
                        continue
                    once.add((page, url, digest))
                if mark is None or mark["o_digest"] is None:
                    out.response(page, url, date, digest, http(payload))
                else:
                    out.revisit(page, url, date, digest, _refers(digest, mark["o_id"], mark["o_url"], date, len(payload)))
        yield from out.end()

    return run


def deduplicated(pages: DataFrame, folder: str | None = None, date: str = DATE) -> DataFrame:
    """Write the archives of pages (page_id, url, html), each payload once, to ``folder`` and return the headers read back."""
    spark = pages.sparkSession
    folder = folder or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    marks = f"{scratch_dir(spark)}/marks-{uuid.uuid4().hex}"
    kind = pages.schema["page_id"].dataType
    rows = _located(pages)
    digest = F.concat(F.lit("sha256:"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    heads = stored(rows.select("page_id", "url", digest.alias("payload_digest"), "file", "at"), "headers")
    key = ["page_id", "url", "payload_digest"]
    each = stored(heads.groupBy(*key).agg(F.count("*").alias("copies"), F.min(F.struct("file", "at")).alias("keep")), "records")
    least = each.groupBy("payload_digest").agg(F.min(_order("page_id", "url")).alias("o"), F.count("*").alias("n")).where("n > 1")
    shared = stored(least.select(F.col("payload_digest").alias("o_digest"), F.col("o.page_id").alias("o_id"), F.col("o.url").alias("o_url")), "shared")
    told = each.join(maybe_broadcast(shared), F.col("payload_digest") == F.col("o_digest"), "left")
    first = F.col("page_id").eqNullSafe(F.col("o_id")) & F.col("url").eqNullSafe(F.col("o_url"))
    told = told.withColumn("o_digest", F.when(~first, F.col("o_digest"))).where("o_digest is not null or copies > 1")
    told = stored(told.select(*[F.col(c).alias(f"k_{c}") for c in key], "copies", F.col("keep").alias("k"), "o_digest", "o_id", "o_url"), "told")
    same = F.col("page_id").eqNullSafe(F.col("k_page_id")) & F.col("url").eqNullSafe(F.col("k_url")) & (F.col("payload_digest") == F.col("k_payload_digest"))
    own = heads.join(maybe_broadcast(told), same).select("file", "at", *[F.col(c).cast("string").alias(c) for c in key], "copies", (F.struct("file", "at") == F.col("k")).alias("keep"), "o_digest", F.col("o_id").cast("string").alias("o_id"), "o_url")
    buckets = told.count() // 200_000 + 1
    bucket = F.pmod(F.xxhash64("file"), F.lit(buckets)).alias("bucket")
    own.select("*", bucket).repartition(buckets, "bucket").sortWithinPartitions("file", "at").write.partitionBy("bucket").parquet(marks)
    paths = stored(rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "file", "at", bucket).mapInArrow(_written(folder, marks, date), "path string"), "archives")
    back = read_headers(spark, paths.repartition(max(1, spark.sparkContext.defaultParallelism), "path"))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "url", "warc_type", "payload_digest", "payload_length", F.col("refers_to").cast(kind).alias("refers_to"))


def _rewritten(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Archive(folder)
        at: tuple = (None, None)
        for batch in batches:
            for r in batch.to_pylist():
                own, first = (r["page_id"], r["url"], r["date"], r["payload_digest"]), r["original"]
                if r["is_original"]:
                    if r["archive"] != at[0]:
                        if at[1] is not None:
                            at[1].close()
                        fs, name = _open(r["archive"])
                        at = (r["archive"], fs.open_input_file(name))
                    at[1].seek(r["offset"])
                    _, _, block = next(records(at[1]))
                    out.response(*own, block)
                elif first is not None:
                    out.revisit(*own, _refers(own[3], first["page_id"], first["url"], first["date"], r["payload_length"] if r["warc_type"] == "response" else r["original_length"]))
                else:
                    out.revisit(*own, [("WARC-Refers-To-Target-URI", r["refers_to_uri"]), ("WARC-Refers-To-Date", r["refers_to_date"]), ("WARC-Refers-To-Page-ID", r["refers_to"]), ("WARC-Refers-To-Payload-Length", None if r["payload_length"] is None else str(r["payload_length"]))])
        if at[1] is not None:
            at[1].close()
        yield from out.end()

    return run


def rewritten(spark: SparkSession, paths: DataFrame, folder: str) -> DataFrame:
    """Rewrite the archives named in column ``path``, revisits and all, to deduplicated ones in ``folder``; the headers read
    back from those. Records equal in id, url, date, kind and digest are one."""
    heads = stored(read_headers(spark, paths.select("path").distinct()), "headers")
    key = ["page_id", "url", "date", "warc_type", "payload_digest"]
    keep = heads.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("archive", "offset")).alias("keep"), F.max("payload_length").alias("most")).where("n > 1")
    keep = stored(keep.select(*[F.col(c).alias(f"k_{c}") for c in key], "keep"), "kept")
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"k_{c}"))
    heads = heads.join(maybe_broadcast(keep), same, "left").where(F.col("keep").isNull() | (F.col("keep") == F.struct("archive", "offset"))).select(*_NAMES)
    told = resolved(stored(heads, "once"))
    is_original = (F.col("warc_type") == "response") & F.col("original.date").eqNullSafe(F.col("date")) & F.col("original.page_id").eqNullSafe(F.col("page_id")) & F.col("original.url").eqNullSafe(F.col("url"))
    told = stored(told.withColumn("is_original", is_original), "told")
    sizes = told.where("is_original").select(F.col("payload_digest").alias("d"), F.col("payload_length").alias("original_length"))
    revisits = told.where("warc_type = 'revisit'").select("payload_digest").distinct().withColumnRenamed("payload_digest", "d")
    sizes = stored(sizes.join(revisits, "d", "left_semi"), "sizes")
    told = told.join(maybe_broadcast(sizes), F.col("payload_digest") == F.col("d"), "left").drop("d")
    done = stored(told.repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(_rewritten(folder), "path string"), "archives")
    return read_headers(spark, done.repartition(max(1, spark.sparkContext.defaultParallelism), "path"))
