"""WARC: a deterministic sharded writer and its reader.

Writer: records are sorted by (page_id, payload digest, hash of the url) and cut into shards of about
SHARD_BYTES payload each. The cuts are exact size quantiles of that order: the slim keys are range-sorted
once, their sizes added up, and the first key of each shard kept (one key for each SHARD_BYTES of
payload, sent to the tasks). So shards follow from the records alone, not from the session's settings,
ids far apart or equal are cut like any others, and only rows equal in all three keys stay together. A
shard is streamed in its order and rolled into a new file whenever its compressed size reaches
ROLL_BYTES. Headers are generated anew from the payload (no header of the input is trusted): record id,
digests and lengths. Record ids and dates are functions of the record, so a task that runs again writes
the same bytes.

Commit: a task writes each file under a temporary name and renames it when it is complete; the last
name follows from shard and file number, so a repeated or speculative task replaces a file by an
equal one. What was written is listed in a manifest table (file, records, bytes, digest) beside the
archives; only files of the manifest count, and the reader checks their digests. Temporary files that
lost attempts leave behind go when the job is done.

Equal payloads: of those of at least min_revisit bytes the record with the largest page_id is the
response and the others are revisits of it; smaller payloads are all responses. Roles are told from
slim keys; payloads found once need none, and those found more than HOT times meet theirs by broadcast
(there are at most rows / HOT of them), so that no key's rows meet in one task.

Defined results: null html is an empty payload; of rows that share the largest page_id and the
payload one (by the url's hash, then any of equal rows) is the response and the others revisit it; a
null page_id sorts first, and its revisits have a null refers_to; an empty table writes no archive and
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vodlens.llm.common import drop_stored, fresh_path, partitions, remove_matching, shuffles_freed, stored

SHARD_BYTES, ROLL_BYTES = 256 << 20, 64 << 20
#: A small input is cut into about this many shards instead, of at least LEAST_BYTES each.
LEAST_SHARDS, LEAST_BYTES = 64, 1 << 20
#: Rows of a payload from which on its role is sent to all tasks.
HOT = 100_000
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long, sha256 string"


def digest32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{name} {url} {digest} {revisit}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{rid}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        f"X-Page-ID: {name}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {'null' if refers_to is None else refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream; damage raises ValueError."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("a record's header breaks off")
            k, _, v = line.decode().partition(":")
            head[k] = v.strip()
        block = stream.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record's block breaks off")
        if head["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
            raise ValueError("a record's block does not fit its digest")
        yield head, block


def gzip_member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class RollingFiles:
    """The files of one shard: temporary names, a new file by compressed size, rename at the end."""

    def __init__(self, root: str, shard: int, roll_bytes: int):
        self.store, self.base = fs.FileSystem.from_uri(root)
        self.root, self.shard, self.roll, self.number, self.out = root, shard, roll_bytes, 0, None
        self.done: list[tuple[str, int, int, str]] = []

    def write(self, raw: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.base}/_temporary-{self.name}-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        member = gzip_member(raw)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temporary, f"{self.base}/{self.name}")
            self.done.append((f"{self.root}/{self.name}", self.records, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1


Key = tuple[int, str, int]
#: Stands for a null page_id in a key, before every long.
NULL_ID = -(1 << 63) - 1


def keys(pages: DataFrame) -> DataFrame:
    """page_id, digest (160 bits as in the record; hex here, base32 there), h (of the url) and size of every row."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), _digest().alias("digest"), _h().alias("h"), size)


def _digest() -> Column:
    return F.sha1(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary"))


def _h() -> Column:
    return F.xxhash64(F.col("url").cast("string"))


def in_order(slim: DataFrame) -> DataFrame:
    """The keys sorted over all partitions, with the partition's number and its running sum of sizes, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = batch.column("size").to_numpy().cumsum() + total
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(sums), pa.int32()), pa.array(sums, pa.int64())], [*batch.schema.names, "part", "upto"])

    order = ("page_id", "digest", "h")
    dealt = slim.repartitionByRange(partitions(slim.sparkSession), *order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(run, "page_id long, digest string, h long, size long, part int, upto long"), "warc-keys")


def shard_bounds(ordered: DataFrame, shard_bytes: int, least_shards: int = LEAST_SHARDS) -> list[Key]:
    """The first key of each shard but the first: exact quantiles of the sizes in the order of the keys."""
    totals = {r.part: r.total for r in ordered.groupBy("part").agg(F.max("upto").alias("total")).collect()}
    limit = min(shard_bytes, max(LEAST_BYTES, sum(totals.values()) // least_shards))
    before, starts = 0, []
    for part in sorted(totals):
        starts.append((part, before))
        before += totals[part]
    if before <= limit:
        return []
    offsets = ordered.sparkSession.createDataFrame(starts, "part int, before long")
    place = F.floor((F.col("before") + F.col("upto") - F.col("size")) / F.lit(limit)).cast("long")
    firsts = ordered.join(F.broadcast(offsets), "part").groupBy(place.alias("shard")).agg(F.min(F.struct("page_id", "digest", "h")).alias("first"))
    found = sorted((NULL_ID if r.first.page_id is None else r.first.page_id, r.first.digest, r.first.h) for r in firsts.where("shard > 0").select("first").collect())
    return list(dict.fromkeys(found))


def repeated(ordered: DataFrame) -> DataFrame:
    """digest, n and top (largest page_id, and ~h of its first key) of the payloads that several rows have."""
    top = F.max(F.struct("page_id", F.bitwise_not("h").alias("h"))).alias("top")
    return ordered.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), top).where("n > 1")


def roles(ordered: DataFrame, payloads: DataFrame, hot: int = HOT) -> DataFrame:
    """page_id, digest, h, first_id and lead of each distinct key whose payload other rows have too.

    first_id is the payload's largest page_id; lead marks the key whose first row is the response.
    """
    slim = ordered.select("page_id", "digest", "h")
    often = F.broadcast(payloads.where(F.col("n") > hot))
    rare = slim.join(often.select("digest"), "digest", "left_anti").join(payloads.where(F.col("n") <= hot), "digest")
    both = slim.join(often, "digest").unionByName(rare).distinct()
    lead = F.col("page_id").eqNullSafe(F.col("top.page_id")) & (F.col("h") == F.bitwise_not("top.h"))
    return both.select("page_id", "digest", "h", F.col("top.page_id").alias("first_id"), lead.alias("lead"))


def shard_of(bounds: list[Key]) -> Column:
    """The number of bounds at or below a row's key."""

    def place(ids: pa.Array, digests: pa.Array, hashes: pa.Array) -> pa.Array:
        rows = zip(ids.to_pylist(), digests.to_pylist(), hashes.to_pylist())
        return pa.array([bisect.bisect_right(bounds, (NULL_ID if i is None else i, d, h)) for i, d, h in rows], pa.int32())

    return F.arrow_udf(place, "int")("page_id", "digest", "h") if bounds else F.lit(0)


def write_archives(pages: DataFrame, root: str | None = None, min_revisit: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_shards: int = LEAST_SHARDS, hot: int = HOT) -> DataFrame:
    """Writes the archives under root (in the shared folder) and returns the manifest table."""
    spark = pages.sparkSession
    root = root or fresh_path(spark, "warc")
    uri = root if "://" in root or root.startswith("file:") else f"file://{root}"
    ordered = in_order(keys(pages))
    bounds = shard_bounds(ordered, shard_bytes, least_shards)
    shards = len(bounds) + 1
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html, _digest().alias("digest"), _h().alias("h"))
    none = F.lit(None)
    payloads = stored(repeated(ordered), "warc-payloads")
    told = roles(ordered, payloads, hot).withColumn("url", none.cast("string")).withColumn("html", none.cast("string")).withColumn("kind", F.lit(0))
    both = rows.withColumn("first_id", none.cast("long")).withColumn("lead", none.cast("boolean")).withColumn("kind", F.lit(1)).unionByName(told)
    # A key's role row comes right before its rows. Shards go to partitions by their number.
    dealt = both.withColumn("shard", shard_of(bounds))
    places = min(shards, max(partitions(spark), 10_000))
    dealt = dealt.repartitionById(places, F.pmod("shard", F.lit(places))).sortWithinPartitions("shard", "page_id", "digest", "h", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: RollingFiles | None = None
        done: list[tuple] = []
        told: tuple = ()
        answered, first, lead = False, None, False
        for batch in batches:
            for page_id, url, html, digest, h, first_id, leads, kind, k in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    told, first, lead, answered = (page_id, digest, h), first_id, leads, False
                    continue
                if files is None or files.shard != k:
                    if files is not None:
                        files.close()
                        done += files.done
                    store, base = fs.FileSystem.from_uri(uri)
                    store.create_dir(base, recursive=True)
                    files = RollingFiles(uri, k, roll_bytes)
                payload = html.encode("utf-8", "replace")
                shared = told == (page_id, digest, h)
                revisit = shared and len(payload) >= min_revisit and (answered or not lead)
                answered = True
                files.write(record_bytes(page_id, url, payload, digest32(payload), first if revisit else None, revisit))
        if files is not None:
            files.close()
            done += files.done
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "records", "bytes", "sha256"])

    manifest = dealt.select("page_id", "url", "html", "digest", "h", "first_id", "lead", "kind", "shard").mapInArrow(run, MANIFEST)
    with shuffles_freed(spark):
        manifest.write.parquet(f"{root}/_manifest")
    drop_stored(ordered)
    drop_stored(payloads)
    remove_matching(spark, f"{uri}/_temporary-*")
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


class _Checked(io.RawIOBase):
    """Passes a file's bytes on and digests them."""

    def __init__(self, raw):
        self.raw_file, self.sha = raw, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.raw_file.read(len(into))
        self.sha.update(got)
        into[: len(got)] = got
        return len(got)


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of the manifest's files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def number(text: str | None) -> int | None:
        return None if text in (None, "null") else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for file, records, sha256 in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_stream(path, compression=None) as raw:
                    checked = _Checked(raw)
                    seen = 0
                    with gzip.GzipFile(fileobj=io.BufferedReader(checked, 1 << 20)) as stream:
                        for head, block in parse_records(io.BufferedReader(stream, 1 << 20)):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length:"))[15:])
                            digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
                            if not revisit and (len(payload) != length or digest32(payload) != digest):
                                raise ValueError(f"{file}: a payload does not fit its digest")
                            rows.append((number(head["X-Page-ID"]), head["WARC-Target-URI"], length, digest, head["WARC-Type"], number(head.get("X-Refers-To-Page-ID")), None if revisit else payload))
                            seen += 1
                            held += len(payload)
                            if len(rows) >= 5_000 or held >= 32 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                                rows, held = [], 0
                    if seen != records or checked.sha.hexdigest() != sha256:
                        raise ValueError(f"{file} is not what the manifest lists")
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    files = manifest.select("file", "records", "sha256")
    return files.repartition(max(1, min(partitions(manifest.sparkSession), 10_000)), "file").mapInArrow(run, schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the archives, reads them back and tells each record's digest columns."""
    read = read_archives(write_archives(pages, **options))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
