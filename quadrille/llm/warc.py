"""WARC archives (operator 8) as a chunked record table.

A payload is cut into rows (record, chunk number, bytes) before any Python code sees it; the writer
streams these rows into archives, the reader streams archives back into such rows. Both keep one
chunk and one running SHA-1 in memory, never a whole record. Archives are written under a temporary
name and renamed when complete, so a task that is run again leaves the same file.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import filesystem, join_few, new_path, read, spool

#: Bytes a chunk row holds at most.
CHUNK_BYTES = 1 << 20
#: Payloads from this size on are stored once; equal ones become revisits.
REVISIT_BYTES = 1000
#: Fixed, so that reruns write the same archives.
DATE = "2024-01-01T00:00:00Z"
#: zlib's window bits for gzip members, one a record.
GZIP = 31
_READ = "record string, kind string, uri string, refers_to string, digest string, archive string, chunk_no int, last boolean, data binary, running_bytes bigint, running_sha1 string"


def records(pages: DataFrame) -> DataFrame:
    """Pages to records: record, kind, uri, refers_to, digest, payload.

    ``record`` is the page_id as text, ``-`` if null. Null html has an empty payload. Of equal payloads
    of at least ``REVISIT_BYTES`` that with the largest page_id is the response (null ids are
    smaller than all others; rows that share it are all responses), the others revisit it; where no
    such page has an id, all are responses. Other columns are left aside; an empty table has no records.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    digests = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= REVISIT_BYTES)
    # Payloads stay where they are: only digests that several pages share travel.
    shared = spool(digests.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("kept")).filter("n > 1 and kept is not null").select("digest", "kept"), "shared-digests")
    base = pages.select("page_id", F.col("url").cast("string").alias("uri"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    joined = join_few(base, shared, "digest", F.col("page_id"))
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    return joined.select(name.alias("record"), F.when(revisit, "revisit").otherwise("response").alias("kind"), "uri", F.when(revisit, F.col("kept").cast("string")).alias("refers_to"), "digest", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Records to rows (record fields, total, chunk_no, last, data); an empty payload has one empty chunk."""
    total = F.octet_length("payload").cast("bigint")
    n = F.greatest(F.ceil(total / chunk_bytes), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("chunk_no"), (k == n - 1).alias("last"), F.substring(F.col("payload"), k * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data")))
    return rows.select("record", "kind", "uri", "refers_to", "digest", total.alias("total"), F.inline(pieces))


def _header(row) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {row.kind}", f"WARC-Record-ID: <urn:page:{row.record}>", f"WARC-Date: {DATE}"]
    if row.uri is not None:
        lines.append("WARC-Target-URI: " + row.uri.replace("\r", "%0D").replace("\n", "%0A"))
    if row.kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row.refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{row.digest}", f"Content-Length: {row.total}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows into one archive a partition; returns (archive, records, bytes), once written."""

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root)
        name = f"part-{context.partitionId():06d}.warc.gz"
        draft = f"{root}/.{name}.{context.taskAttemptId()}"
        count = 0
        with fs.open_output_stream(draft, compression=None, buffer_size=1 << 20) as out:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    if row.chunk_no == 0:
                        member = zlib.compressobj(1, zlib.DEFLATED, GZIP)
                        out.write(member.compress(_header(row)))
                        count += 1
                    out.write(member.compress(row.data))
                    if row.last:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
            size = out.tell()
        if count:
            fs.move(draft, f"{root}/{name}")
            yield pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [count], "bytes": [size]})
        else:
            fs.delete_file(draft)

    return spool(rows.mapInPandas(archive, "archive string, records bigint, bytes bigint"), "warc-index")


def scan(spark: SparkSession, archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Stream archives back as chunk rows that carry the bytes and SHA-1 up to and with the chunk.

    Each archive is read by one task, front to back. Without data, only the digests move on.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["archive"]:
                fs, local = filesystem(path)
                with fs.open_input_stream(local, compression=None) as raw:
                    out, held = [], 0
                    for row in _parse(raw, path, chunk_bytes, with_data):
                        out.append(row)
                        held += len(row[8] or b"") + 200
                        if held > 8 << 20:
                            yield pd.DataFrame(out, columns=_READ_COLUMNS)
                            out, held = [], 0
                    if out:
                        yield pd.DataFrame(out, columns=_READ_COLUMNS)

    n = max(1, spark.sparkContext.defaultParallelism)
    return archives.select("archive").repartition(n).mapInPandas(stream, _READ)


_READ_COLUMNS = [x.split()[0] for x in _READ.split(", ")]


class _Members:
    """A stream's gzip members, one after the other, inflated piece by piece."""

    def __init__(self, raw) -> None:
        self.raw, self.member, self.packed = raw, zlib.decompressobj(GZIP), b""

    def read(self, n: int) -> bytes:
        while True:
            if self.member.eof:
                self.packed, self.member = self.member.unused_data, zlib.decompressobj(GZIP)
            self.packed = self.packed or self.raw.read(1 << 16)
            if not self.packed:
                return self.member.decompress(b"", n) if not self.member.eof else b""
            out = self.member.decompress(self.packed, n)
            self.packed = self.member.unconsumed_tail
            if out:
                return out


class _Buffered:
    """Lines and exact reads over a stream."""

    def __init__(self, raw, size: int) -> None:
        self.raw, self.size, self.kept = raw, size, b""

    def line(self) -> bytes:
        while b"\n" not in self.kept:
            more = self.raw.read(self.size)
            if not more:
                break
            self.kept += more
        line, _, self.kept = self.kept.partition(b"\n")
        return line.rstrip(b"\r")

    def ended(self) -> bool:
        if not self.kept:
            self.kept = self.raw.read(self.size)
        return not self.kept

    def take(self, n: int) -> bytes:
        parts, have = [self.kept], len(self.kept)
        while have < n:
            parts.append(self.raw.read(n - have))
            have += len(parts[-1])
            if not parts[-1]:
                raise ValueError("the archive ends within a record")
        whole = b"".join(parts)
        self.kept = whole[n:]
        return whole[:n]


def _parse(raw, path: str, chunk_bytes: int, with_data: bool):
    source = _Buffered(_Members(raw), 1 << 16)
    while not source.ended():
        if not source.line().startswith(b"WARC/"):
            raise ValueError(f"{path}: no record where one should begin")
        fields = {}
        while line := source.line():
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        bare = lambda s: None if s is None else s.removeprefix("<urn:page:").removesuffix(">")
        head = (bare(fields["warc-record-id"]), fields["warc-type"], fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")), fields["warc-payload-digest"].removeprefix("sha1:"), path)
        left, number, done, running = int(fields["content-length"]), 0, 0, hashlib.sha1()
        while True:
            data = source.take(min(left, chunk_bytes))
            left -= len(data)
            done += len(data)
            running.update(data)
            yield (*head, number, left == 0, data if with_data else None, done, running.hexdigest())
            number += 1
            if not left:
                break
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"{path}: a record's end is missing")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = write(chunked(records(pages)), new_path(spark, "warc"))
    ends = scan(spark, archives, with_data=False).filter("last")
    whole = ends.withColumn("ok", (F.col("kind") == "revisit") | (F.col("running_sha1") == F.col("digest")))
    checked = whole.withColumn("digest", F.when(F.col("ok"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record")))))
    kept = spool(checked.select("record", "kind", "refers_to", "digest", "running_bytes"), "warc-records")
    responses = kept.filter("kind = 'response'").groupBy(F.col("record").alias("refers_to"), "digest").agg(F.max("running_bytes").alias("response_bytes"))
    revisits = kept.filter("kind = 'revisit'").join(responses, ["refers_to", "digest"], "left").select("record", "kind", "refers_to", "digest", F.col("response_bytes").alias("running_bytes"))
    both = kept.filter("kind = 'response'").unionByName(revisits)
    page = lambda c: F.when(F.col(c) != "-", F.col(c)).cast("bigint")
    return both.select(page("record").alias("page_id"), F.col("running_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))
