"""WARC archives: a deterministic sharded writer and its reader.

Records are range-sorted by (key, content hash) into shards whose borders come from
the rows with the smallest hashes, hence from the rows alone, not from how
they were read. A task streams each of its shards in order, one gzip member a record,
and starts a new file when the compressed size passes a limit. Headers and
digests are made anew from the payload. Files are written under names of their
own attempt; the manifest of the attempts that count is written by Spark, the files are then renamed
by tasks, and the final manifest, written last, commits the archive. A
lost executor only leaves unnamed files, which the commit removes.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, that of the
largest key is a response and the others revisit it.

Files go through ``pyarrow.fs``, so the target may be any file system it knows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import stored, table
from docsift.session import scratch_path

MIN_REVISIT = 1000
SHARD_BYTES = 64 << 20
FILE_BYTES = 32 << 20
PIVOTS_PER_SHARD = 64
MAX_PIVOTS = 100_000
DATE = "1970-01-01T00:00:00Z"

MANIFEST = ("shard int, nth int, temp string, name string, records long, bytes long, sha1 string")


def file_system(uri: str):
    """(pyarrow file system, path) of a folder given as URI or local path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def safe_uri(url: str | None) -> str:
    """Without characters that would end a header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record_id(key: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}')}>"


def warc_record(key: int | None, url: str | None, payload: bytes | int, digest: str, refers_to: int | None) -> bytes:
    """One record, headers and all. A revisit has no body (its ``payload`` is the
    length alone) and names the response by id; both carry the digest and length of
    the full payload."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    body = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {safe_uri(url)}", f"WARC-Payload-Digest: sha1:{b32}",
            f"X-Payload-Length: {len(payload) if refers_to is None else payload}"]
    if key is not None:
        head.append(f"X-Key: {key}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Key: {refers_to}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        head += ["Content-Type: text/html; charset=utf-8", f"WARC-Block-Digest: sha1:{b32}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(key, url: str | None, payload: bytes | int, digest: str, refers_to: int | None = None) -> bytes:
    """A record as one gzip member, the same bytes every time."""
    return gzip.compress(warc_record(None if pd.isna(key) else int(key), url, payload, digest, refers_to), 6, mtime=0)


def with_digests(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, url, html, digest, n_bytes, h) of every row; null html is empty."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    return rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")),
                             "n_bytes": F.octet_length("html").cast("long"), "h": F.xxhash64("url", "html")})


def revisited(records: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(digest, top): the largest key of each payload of at least ``least``
    bytes that several records have. Rows below it revisit it; rows that share it
    are all responses, and so are those whose key is null."""
    return (records.filter(F.col("n_bytes") >= least).groupBy("digest")
            .agg(F.max("key").alias("top"), F.count("*").alias("n")).filter("n > 1").drop("n"))


def write_archive(records: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES,
                  file_bytes: int = FILE_BYTES, least: int = MIN_REVISIT) -> DataFrame:
    """Write records (``with_digests``) under ``folder``; returns the
    committed manifest, a row for each file. An empty table gives an archive without files."""
    spark = records.sparkSession
    total = records.agg(F.coalesce(F.sum(F.col("n_bytes") + 512), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard_bytes))
    # The rows of smallest hash, whatever the partitioning: a bounded, repeatable sample.
    picked = (records.select("key", "h").orderBy(F.xxhash64("key", "h"), "h", "key")
              .limit(min(MAX_PIVOTS, PIVOTS_PER_SHARD * shards)).collect())
    order = lambda key, h: (key is not None, key or 0, h)  # noqa: E731  null keys first
    picked = sorted(order(r["key"], r["h"]) for r in picked)
    borders = [picked[len(picked) * i // shards] for i in range(1, shards)] if picked else []
    temp = f"_temporary-{uuid.uuid4().hex}"

    @F.pandas_udf("int")
    def shard_of(key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(borders, order(None if pd.isna(k) else int(k), x))
                          for k, x in zip(key.astype("Int64"), h)], dtype="int32")

    def responses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["member"] = [member(key, url, html.encode(), digest) for key, url, html, digest
                           in zip(b["key"].astype("Int64"), b["url"], b["html"], b["digest"])]
            yield b.drop(columns="html").astype({"key": "Int64"})

    def revisits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, tops = b["key"].astype("Int64"), b["top"].astype("Int64")
            b["member"] = [made if pd.isna(to) or pd.isna(key) or key >= to else member(key, url, n, digest, int(to))
                           for key, to, url, n, digest, made in zip(keys, tops, b["url"], b["n_bytes"], b["digest"], b["member"])]
            yield b[["shard", "key", "h", "member"]].astype({"key": "Int64"})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = file_system(folder)
        system.create_dir(f"{root}/{temp}", recursive=True)
        done: list[tuple] = []
        out = shard = None
        nth = count = size = 0
        name, sha = "", hashlib.sha1()

        def close() -> None:
            if out is not None:
                out.close()
                done.append((shard, nth, name, f"part-{shard:06d}-{nth:04d}.warc.gz", count, size, sha.hexdigest()))

        for b in batches:
            for s, made in zip(b["shard"], b["member"]):
                if out is None or s != shard or size >= file_bytes:
                    close()
                    nth = nth + 1 if s == shard and out is not None else 0
                    shard, count, size, sha = s, 0, 0, hashlib.sha1()
                    name = f"{temp}/{shard:06d}-{nth:04d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                out.write(made)
                sha.update(made)
                size += len(made)
                count += 1
        close()
        yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    # Records are compressed before they move, so both shuffles carry what the files will hold.
    columns = "shard int, key long, h long, url string, digest string, n_bytes long, member binary"
    packed = (records.withColumn("shard", shard_of("key", "h"))
              .select("shard", "key", "h", "url", "digest", "n_bytes", "html").mapInPandas(responses, columns)
              .join(revisited(records, least), "digest", "left")
              .mapInPandas(revisits, "shard int, key long, h long, member binary"))
    ranged = (packed.repartition(min(shards, 4096), "shard")
              .sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "h", "member"))
    attempt = stored(ranged.select("shard", "member").mapInPandas(write, MANIFEST), "warc-attempt")

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        system, root = file_system(folder)
        for b in batches:
            for at, to in zip(b["temp"], b["name"]):
                # Repeated safely: a file already renamed is in its place.
                if system.get_file_info(f"{root}/{at}").type != fs.FileType.NotFound:
                    system.move(f"{root}/{at}", f"{root}/{to}")
            yield b

    committed = attempt.mapInPandas(rename, MANIFEST)
    committed.write.mode("overwrite").parquet(f"{folder}/_manifest")
    system, root = file_system(folder)
    system.delete_dir(f"{root}/{temp}") if attempt.limit(1).count() else None
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


class _Members(io.RawIOBase):
    """Decompresses a stream of gzip members as one stream of bytes."""

    def __init__(self, source):
        self.source, self.inflate, self.held, self.raw = source, None, b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.held:
            if self.inflate is None or self.inflate.eof:
                rest = self.inflate.unused_data if self.inflate is not None else b""
                self.inflate = zlib.decompressobj(31)
                chunk = rest or self.source.read(1 << 20)
                if not chunk:
                    return 0
            else:
                chunk = self.source.read(1 << 20)
                if not chunk:
                    raise EOFError("a WARC file ends inside a record")
            self.held = self.inflate.decompress(chunk)
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of an open WARC.gz stream."""
    text = io.BufferedReader(_Members(stream), 1 << 20)
    while line := text.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := text.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        body = text.read(int(head["Content-Length"]))
        if text.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end where its length says")
        yield head, body


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(key, url, record_type, payload_bytes, payload_digest, refers_to, html)
    of the files that the manifest names; html is null for revisits. A response's
    digest is computed from its body and must be the one in its header."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = file_system(folder)
        names = ["key", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            f = pd.DataFrame(rows, columns=names)
            return f.astype({"key": "Int64", "refers_to": "Int64"})

        for b in batches:
            for name in b["name"]:
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for head, body in records_of(stream):
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        response = head["WARC-Type"] == "response"
                        if response and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload doesn't have its digest")
                        key, to = head.get("X-Key"), head.get("X-Refers-To-Key")
                        rows.append((None if key is None else int(key), head["WARC-Target-URI"], head["WARC-Type"],
                                     len(body) if response else int(head["X-Payload-Length"]), digest,
                                     None if to is None else int(to), body.decode() if response else None))
                        held += len(body)
                        if held > 16 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    files = manifest.repartition(max(1, min(4096, manifest.count())), "name")
    return files.mapInPandas(read, "key long, url string, record_type string, payload_bytes long, payload_digest string, "
                                   "refers_to long, html string")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_archive(with_digests(table(spark, sf_dir, "pages"), "page_id", "url", "html"), folder,
                  shard_bytes=8 << 20, file_bytes=4 << 20)
    return read_archive(spark, folder).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN t USING (payload_digest)
"""

QUERIES = {"op5_warc": op5_warc}
SQL = {"op5_warc": OP5_SQL}
