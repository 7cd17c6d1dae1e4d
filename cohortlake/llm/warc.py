"""WARC archives: one gzip member per record, written by tasks and read back by byte ranges.

Writing. Each task writes files of its own (attempts never share a name) and reports those it
has closed; what a lost attempt left is in no manifest and is not read. Of records with equal payloads
of at least ``least`` bytes, the one with the smallest page_id is a response and the others are
revisits without payload; all smaller ones are responses. Rows of that same smallest id are all responses, and
so is every row of a group without any id. A null payload is empty.

Reading. A file is cut into ranges. A task looks for the gzip magic from the start of its range on, accepts a
position if it inflates to a WARC header and a whole record with a right checksum, and, where it has not yet
met a record, if another gzip member or the end of the file follows. A header may be as long as its record. It owns the records that start inside its
range and reads past its end to finish the last. Files are opened through pyarrow's file systems, by URI.
A record that itself holds stored (uncompressed) archives and is longer than a range can deceive
a range that starts inside it; use ranges longer than such records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.store import stage

LEAST, FILE_BYTES, SPLIT_BYTES, BLOCK = 100, 256 << 20, 8 << 20, 1 << 16
HEAVY = 1000
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
RECORDS = (
    "file string, at bigint, record_type string, page_id bigint, url string, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, payload binary"
)


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, digest: str, first: int | None) -> bytes:
    """A WARC record as a gzip member. Line breaks in a url are percent-encoded."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + payload + b"\r\n\r\n") + packer.flush()


def typed(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, kind, first) for every row.

    The few payloads that make up over a thousandth of all rows each are looked up in a broadcast table (at
    most a thousand rows); the rest meet their group by a shuffle in which no group is large.
    """
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    prints = stage(rows.select("page_id", "digest", F.length("payload").alias("size")), "digests")
    groups = stage(
        prints.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"),
        "groups",
    )
    limit = prints.count() // HEAVY
    heavy = F.broadcast(groups.where(F.col("n") > limit).select("digest", F.col("first").alias("hot"), F.lit(True).alias("is_hot")))
    light = groups.where(F.col("n") <= limit).select(F.col("digest").alias("key"), "first")
    alone = F.concat_ws("-", F.lit("alone"), "digest", F.col("page_id"), F.xxhash64("url"))
    key = F.when(F.col("is_hot").isNull() & (F.length("payload") >= least), F.col("digest")).otherwise(alone)
    joined = rows.join(heavy, "digest", "left").withColumn("key", key).join(light, "key", "left")
    first = F.coalesce("hot", "first")
    return joined.select(
        "page_id", "url", "payload", "digest", first.alias("first"),
        F.when(first.isNotNull() & ~F.col("page_id").eqNullSafe(first), "revisit").otherwise("response").alias("kind"),
    )


def write(pages: DataFrame, folder: str, *, file_bytes: int = FILE_BYTES, **options) -> DataFrame:
    """Write archives below ``folder``; returns the manifest (path, bytes, records, starts of the records), itself a stage table."""
    target = _uri(folder)

    def pack(batches):
        store, root = pafs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        done, out, size, starts, name = [], None, 0, [], ""
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, starts = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = record(row["page_id"], row["url"], row["payload"], row["kind"], row["digest"], row["first"])
                out.write(member)
                starts.append(size)
                size += len(member)
                if size >= file_bytes:
                    out.close()
                    done.append((name, size, starts))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, starts))
        if done:
            names, sizes, places = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{target}/{n}" for n in names]), pa.array(sizes, pa.int64()), pa.array([len(p) for p in places], pa.int64()),
                    pa.array(places, pa.list_(pa.int64())),
                ],
                names=["path", "bytes", "records", "starts"],
            )

    return stage(typed(pages, **options).mapInArrow(pack, "path string, bytes bigint, records bigint, starts array<bigint>"), "manifest")


class Members:
    """The records of one file that start in a range."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def candidates(self, start: int, end: int):
        """Positions of the magic in [start, end); a caller may send where to go on."""
        at = start
        while at < end:
            data = self.read(at, BLOCK + len(MAGIC) - 1)
            found = data.find(MAGIC)
            if found < 0 or at + found >= min(end, at + BLOCK):
                at += BLOCK
                continue
            onward = yield at + found
            at = onward if onward is not None else at + found + 1

    def header(self, data: bytes) -> dict[str, str] | None:
        lines = data.split(b"\r\n")
        if not lines[0].startswith(b"WARC/1."):
            return None
        fields = dict(x.decode("utf-8", "replace").split(": ", 1) for x in lines[1:] if b": " in x)
        return fields if fields.get("Content-Length", "").isdigit() and "WARC-Type" in fields else None

    def member(self, at: int):
        """(header fields, payload, end) of the record at a position; None if there is none."""
        unpack, data, next_at, cut = zlib.decompressobj(31), bytearray(), at, -1
        fields, seen = None, 0
        try:
            while not unpack.eof:
                block = self.read(next_at, BLOCK)
                if not block:
                    return None
                next_at += len(block)
                data += unpack.decompress(block)
                if fields is None:
                    if not data.startswith(b"WARC/1."[: len(data)]):
                        return None
                    cut = data.find(b"\r\n\r\n", max(seen - 3, 0))
                    if cut < 0:
                        seen = len(data)
                        continue
                    fields = self.header(bytes(data[:cut]))
                    if fields is None:
                        return None
        except zlib.error:
            return None
        if fields is None:
            return None
        length = int(fields["Content-Length"])
        if len(data) != cut + 8 + length or not data.endswith(b"\r\n\r\n"):
            return None
        return fields, bytes(data[cut + 4 : cut + 4 + length]), next_at - len(unpack.unused_data)

    def records(self, start: int, end: int):
        known = start == 0
        places = self.candidates(start, min(end, self.size))
        at = next(places, None)
        while at is not None:
            found = self.member(at)
            if found and (known or found[2] == self.size or self.read(found[2], len(MAGIC)) == MAGIC):
                yield at, found[0], found[1]
                known, onward = True, found[2]
            else:
                onward = at + 1
            try:
                at = places.send(onward)
            except StopIteration:
                return


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def read(manifest: DataFrame, *, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the files in ``manifest`` (path, bytes); see ``RECORDS``. payload_bytes and
    payload_digest are those of the full payload; a response whose payload does not match its
    digest is an error, and so is a range that does not hold as many records as the manifest's ``starts``, where it
    has them. ``payloads`` false leaves the payload column null."""
    starts = F.col("starts") if "starts" in manifest.columns else F.lit(None).cast("array<bigint>")
    ranges = manifest.select(
        "path", starts.alias("starts"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"),
    )
    expected = F.size(F.filter("starts", lambda x: (x >= F.col("start")) & (x < F.col("start") + split_bytes)))
    ranges = ranges.select("path", "start", F.when(F.col("starts").isNotNull(), expected).alias("expected"))
    # one range a task: by number, which adaptive execution leaves as it is
    ranges = ranges.repartition(max(ranges.count(), 1))

    def unpack(batches):
        rows, held = [], 0
        for batch in batches:
            for path, start, expected in zip(*(column.to_pylist() for column in batch.columns)):
                store, name = pafs.FileSystem.from_uri(path)
                met = 0
                with store.open_input_file(name) as source:
                    for at, fields, payload in Members(source, source.size()).records(start, start + split_bytes):
                        met += 1
                        kind, digest = fields["WARC-Type"], fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                        size = int(fields.get("X-Payload-Length", len(payload)))
                        if kind == "response":
                            size, own = len(payload), hashlib.sha256(payload).hexdigest()
                            if digest not in ("", own):
                                raise ValueError(f"payload of record {at} in {path} does not match its digest")
                            digest = own
                        rows.append((
                            path, at, kind, _number(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), size, digest,
                            _number(fields.get("WARC-Refers-To")), payload if payloads else None,
                        ))
                        held += len(payload) if payloads else 100
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if expected is not None and met != expected:
                    raise ValueError(f"{met} records from byte {start} of {path} on, {expected} were written")
        if rows:
            yield _batch(rows)

    return ranges.mapInArrow(unpack, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_folder(spark: SparkSession, folder: str, **options) -> DataFrame:
    """As ``read``, over all files of a folder whose archives were not written here."""
    store, root = pafs.FileSystem.from_uri(_uri(folder))
    found = store.get_file_info(pafs.FileSelector(root, recursive=True))
    base = _uri(folder)
    rows = [(f"{base}/{f.path[len(root):].lstrip('/')}", f.size) for f in found if f.is_file and f.size]
    return read(spark.createDataFrame(rows, "path string, bytes bigint"), **options)
