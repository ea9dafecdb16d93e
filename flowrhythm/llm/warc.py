"""WARC archives of pages, written in segments and put together again.

Each page becomes an HTTP response in chunked transfer framing. A block longer than a
segment goes on in continuation records, which may stand in another archive: they name
the record that they continue, their number, and the last one the total length. Of pages
with equal payloads one is a response, the others are revisit records that refer to it.

Reading streams each archive record by record. Segments meet by the record they continue,
in the order of their numbers, within sorted partitions, so a task holds one record at a
time; numbers, total length and digests are verified, and the chunks decoded. A revisit
gets its length and page from the response that it refers to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrhythm.llm.common import bounded, materialise, shared_dir
from flowrhythm.llm.token_shards import _put, _store

#: Bytes of a record's block, about a page, of a chunk of transfer framing, and of an archive.
SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 2048, 1024, 64 << 20
#: Rows of a table that is broadcast at most; beyond, keys with at least a HOT_SHARE-th of all rows are, and so fewer than HOT_SHARE.
BROADCAST_ROWS, HOT_SHARE = 100_000, 1000
#: Records, and bytes of their payloads, that reading hands on at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def framed(payload: bytes, chunk: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), chunk) if (p := payload[i : i + chunk])]
    return b"".join(parts) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over. ValueError if a chunk is cut short."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[end + 2 : at])
        at += 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, without its framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(x.lower().startswith(b"transfer-encoding:") and b"chunked" in x.lower() for x in head.split(b"\r\n"))
    return unframed(body) if chunked else body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def _urn(key: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=key)}>"


def _text(x: object) -> str:
    return quote(str(x), safe="!#$&'()*+,/:;=?@[]~")


def segments(fields: list[tuple[str, str]], own: str, block: bytes, segment: int) -> Iterator[bytes]:
    """The records of one block: one, or the first of several segments and its continuations."""
    cut = [block[i : i + segment] for i in range(0, len(block), segment)] or [b""]
    for n, part in enumerate(cut, 1):
        said = [("WARC-Block-Digest", f"sha1:{sha1(part)}")]
        if len(cut) > 1:
            said.append(("WARC-Segment-Number", str(n)))
        if n == 1:
            yield _record([*fields, *said], part)
        else:
            key = hashlib.md5(f"{own} {n}".encode()).digest()
            said += [("WARC-Segment-Origin-ID", own)] + [("WARC-Segment-Total-Length", str(len(block)))] * (n == len(cut))
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(key)), ("WARC-Date", DATE), *said], part)


def _look_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows with what table says of their key, null where nothing; table has one row for each key and in n how many rows have it.

    A small table is broadcast. Of a large one the few rows of hot keys are, and the others meet theirs in
    a shuffle, in which rows of hot keys are dealt by all they hold instead.
    """
    names = [c for c in table.columns if c not in (key, "n")]
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop("n")), key, "left")
    hot = table.where(F.col("n") * HOT_SHARE > total).drop("n").withColumnsRenamed({c: f"hot_{c}" for c in names}).withColumn("is_hot", F.lit(True))  # fewer than HOT_SHARE rows
    cold = table.where(F.col("n") * HOT_SHARE <= total).drop("n").withColumnRenamed(key, "cold_key")
    marked = rows.join(F.broadcast(hot), key, "left")
    spread = F.unhex(F.md5(F.concat_ws(" ", *(F.col(c).cast("string") for c in rows.columns if c != "content"))))
    met = marked.withColumn("by", F.when(F.col("is_hot"), spread).otherwise(F.col(key).cast("binary"))).join(cold.withColumn("by", F.col("cold_key").cast("binary")), "by", "left")
    return met.select(*rows.columns, *(F.coalesce(f"hot_{c}", c).alias(c) if c != "head" else F.when(F.col("is_hot"), F.col(f"hot_{c}")).otherwise(F.col(c)).alias(c) for c in names))


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages below folder and return (archive, records, bytes), a row for each archive.

    Of pages with equal payloads that with the largest id is the response (a null id is the least; of rows
    equal in both, one), the others are revisits of it. A null html is an empty payload, which counts
    as any other; a null url has no header. Pages of any length go on through as many segments as they
    take. Other columns play no part, an empty table gives no archive. An archive is whole or not there,
    and one that a repeated task wrote before is in no row of the result.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("content"))
    rows = rows.withColumn("h", F.unhex(F.sha2("content", 256)))
    counts = materialise(rows.groupBy("h", "page_id").agg(F.count("*").alias("m")).groupBy("h").agg(F.sum("m").alias("n"), F.max("m").alias("m"), F.max(F.struct("page_id", F.lit(0).cast("long").alias("uid"))).alias("head")), "payloads")
    total, tied = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    repeats = counts.where("n > 1").select("h", "n", "head")
    if tied > 1:  # rows equal in id and payload: numbers tell them apart, written once so that they stay
        rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "pages")
        repeats = materialise(rows.groupBy("h").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "uid")).alias("head")).where("n > 1"), "repeats")
    else:
        rows = rows.withColumn("uid", F.lit(0).cast("long"))

    def key(*columns: str) -> Column:
        return F.unhex(F.md5(F.concat_ws(" ", F.hex("h"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))))

    known = _look_up(rows, repeats, "h", total)
    revisit = F.col("head").isNotNull() & ~F.struct("page_id", "uid").eqNullSafe(F.col("head"))
    known = known.select(F.col("page_id").cast("string").alias("page_id"), "url", "content", key("page_id", "uid").alias("own"), F.when(revisit, key("head.page_id", "head.uid")).alias("refers"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            columns = [b.column(n) for n in ("page_id", "url", "content", "own", "refers")]
            for i in range(len(b)):
                page, where, content, own, refers = (c[i].as_py() for c in columns)
                own = _urn(own)
                fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", DATE)]
                fields += [("WARC-Target-URI", _text(where))] * (where is not None) + [("WARC-Page-ID", _text(page))] * (page is not None)
                fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1(content)}")]
                if refers is not None:
                    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(refers))]
                yield from segments(fields, own, _HTTP + (framed(content) if refers is None else b""), segment_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo, own, k = records(batches), uuid.uuid4().hex, 0
        held = next(todo, None)
        while held is not None:
            path, n, size = f"{folder}/{own}-{k:05d}.warc.gz", 0, 0

            def members() -> Iterator[bytes]:
                nonlocal held, n, size
                yield _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(hashlib.md5(path.encode()).digest())), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                while held is not None and size < archive_bytes:
                    n, size = n + 1, size + len(held)
                    yield held
                    held = next(todo, None)

            _put(path, members())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["archive", "records", "bytes"])
            k += 1

    return materialise(bounded(known).mapInArrow(run, "archive string, records long, bytes long"), "archives")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of each record of a stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        yield fields, stream.read(int(fields["content-length"]))


_PIECE = "origin string, segment int, total long, type string, page string, url string, refers string, digest string, good boolean, content binary"


def pieces(archives: DataFrame, archive: str = "archive") -> DataFrame:
    """A row for each record of the archives but warcinfo, with the record that it belongs to and its segment's number, 0 if it's whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PIECE.split(", ")]
        kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in _PIECE.split(", ")]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        out, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = _store(path)
                with store.open_input_stream(at, compression=None) as f:
                    for said, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=f))):
                        if said["warc-type"] == "warcinfo":
                            continue
                        block_digest = said.get("warc-block-digest")
                        good = len(block) == int(said["content-length"]) and block_digest in (None, f"sha1:{sha1(block)}")
                        number = int(said.get("warc-segment-number", 0))
                        total = int(said["warc-segment-total-length"]) if "warc-segment-total-length" in said else None if number else len(block)
                        back = lambda k: unquote(said[k]) if k in said else None  # noqa: B023, E731
                        out.append((said.get("warc-segment-origin-id", said["warc-record-id"]), number, total, said["warc-type"], back("warc-page-id"), back("warc-target-uri"), said.get("warc-refers-to"), said.get("warc-payload-digest", "").removeprefix("sha1:") or None, good, block))
                        size += len(block)
                        if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield batch(out)
                            out, size = [], 0
        if out:
            yield batch(out)

    parts = max(1, archives.count())  # a task for each archive
    return archives.select(archive).repartitionByRange(parts, archive).mapInArrow(run, _PIECE)


def _whole(rows: list[dict]) -> tuple[bytes, int, bool]:
    """Block, number of segments and soundness of the rows of one record, in the order of their numbers."""
    parts: dict[int, bytes] = {}
    sound = all(r["good"] for r in rows)
    for r in rows:
        sound &= parts.setdefault(r["segment"], r["content"]) == r["content"]
    numbers, block = list(parts), b"".join(parts.values())
    total = [r["total"] for r in rows if r["total"] is not None]
    return block, len(parts), sound and (numbers == [0] or numbers == list(range(1, len(parts) + 1))) and bool(total) and set(total) == {len(block)}


def read_archives(archives: DataFrame, payload: bool = True, page_type: str = "long", archive: str = "archive") -> DataFrame:
    """(record_id, record_type, page_id, url, refers, payload_digest, payload_bytes, segments, intact[, payload]): a row for each record, segments put together.

    intact tells whether all segments are there, once or alike, have their digests and the total length, and
    the payload has its digest; a record that is not has no length or payload. Revisits have neither
    of their own. A record of other archives is held whole, however long it is.
    """
    told = pieces(archives, archive).repartition("origin").sortWithinPartitions("origin", "segment")
    fields = ["record_id", "record_type", "page_id", "url", "refers", "payload_digest", "payload_bytes", "segments", "intact", *(["payload"] if payload else [])]
    kinds = [*(pa.string(),) * 6, pa.int64(), pa.int32(), pa.bool_(), *([pa.binary()] if payload else [])]

    def done(rows: list[dict]) -> tuple:
        block, n, sound = _whole(rows)
        first, body = rows[0], None
        if first["type"] != "revisit" and sound:
            try:
                body = payload_of(block)
            except ValueError:
                sound = False
            else:
                sound = first["digest"] in (None, sha1(body)) and first["type"] != "continuation"
        body = body if sound else None
        return (first["origin"], first["type"], first["page"], first["url"], first["refers"], first["digest"] or (sha1(body) if body is not None else None), None if body is None else len(body), n, sound, *([body] if payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=fields)
        held: list[dict] = []
        out, size = [], 0
        for b in batches:
            for r in b.to_pylist():
                if held and r["origin"] != held[0]["origin"]:
                    out.append(done(held))
                    size += len(out[-1][-1] or b"") if payload else 0
                    held = []
                    if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch(out)
                        out, size = [], 0
                held.append(r)
        if held:
            out.append(done(held))
        if out:
            yield batch(out)

    text = ", ".join(f"{n} {k}" for n, k in zip(fields, ["string"] * 6 + ["long", "int", "boolean", "binary"]))
    found = bounded(told).mapInArrow(run, text)
    return found.withColumn("page_id", F.col("page_id").cast(page_type))


def resolve(records: DataFrame) -> DataFrame:
    """records, read and written, with refers_to, the page that a revisit refers to, and that response's length and digest; null where it is missing."""
    revisits = records.where("record_type = 'revisit'").groupBy(F.col("refers").alias("record_id")).agg(F.count("*").alias("n"))
    heads = records.where("record_type = 'response'").select("record_id", F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("head_bytes"), F.col("payload_digest").alias("head_digest"))
    referred = materialise(revisits.join(heads, "record_id").withColumnRenamed("record_id", "refers"), "referred")
    met = _look_up(records, referred, "refers", records.count())
    again = F.col("record_type") == "revisit"
    sound = F.col("intact") & (~again | F.coalesce(F.col("head_digest") == F.col("payload_digest"), F.lit(False)))
    return met.withColumns({"payload_bytes": F.when(again, F.col("head_bytes")).otherwise(F.col("payload_bytes")), "intact": sound}).drop("head_bytes", "head_digest")


def round_trip(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages written to archives and read from them: (page_id, payload_bytes, payload_digest, record_type, refers_to), a row for each page."""
    archives = write_archives(pages, folder, segment_bytes, archive_bytes)
    records = materialise(read_archives(archives, False, pages.schema["page_id"].dataType.simpleString()), "records")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{shared_dir(spark)}/warc")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head, sha1(coalesce(html, '')) || '00' AS hex FROM pages
), n AS (
  SELECT *, list_transform(range(1, 43), lambda i: instr('0123456789abcdef', substr(hex, CAST(i AS INTEGER), 1)) - 1) AS d FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((((d[5 * i // 4 + 1] * 256 + d[5 * i // 4 + 2] * 16 + d[5 * i // 4 + 3]) >> CAST(7 - 5 * i % 4 AS BIGINT)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM n
"""
