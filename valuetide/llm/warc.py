"""WARC archives: written as revisit-aware records, read back by boundary chains and pointer jumping."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuetide.llm.common import SLICE_BYTES, stored
from valuetide.session import shared_dir

#: Payloads below so many bytes are always written in full.
LEAST_REVISIT = 1000
#: Groups of equal payloads that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

_EDGE = "\r\n\r\n"
_MAGIC = "WARC/1."
#: What stands before every record but a file's first, and so parts candidates.
DELIMITER = _EDGE + _MAGIC
_DATE = "1970-01-01T00:00:00Z"


# --- writing ---------------------------------------------------------------------------------


def _header_safe(text: Column) -> Column:
    """A header value without line ends or other controls."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")


def warc_record(kind: Column, record_id: Column, refers_to: Column, uri: Column, payload: Column, bytes_: Column, digest: Column, date: str = _DATE) -> Column:
    """A record without its closing edge. The block is an HTTP response; a revisit holds its head alone."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), bytes_.cast("string"), F.lit(_EDGE))
    block = F.when(kind == "response", F.concat(http, payload)).otherwise(http)
    line = lambda name, value: F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"{_MAGIC}1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _header_safe(uri)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Refers-To", F.when(revisit, refers_to)),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(_EDGE),
        block,
    )


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record per row of ``pages`` as WARC files below ``path``, one file a task, through Spark's writer.

    Of rows with equal payloads of at least ``least`` bytes, the largest id's are responses and the others revisits that refer to it.
    Payloads are equal when length, SHA-1 and SHA-256 are. Only these are shuffled, counted in each task first; the
    groups with more than one row go to the tasks that write (broadcast up to ``broadcast_rows`` groups, else joined).
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    marks = {"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary")), "strong": F.sha2(F.col("payload").cast("binary"), 256)}
    keys = list(marks)
    marked = rows.withColumns(marks)
    groups = marked.where(F.col("bytes") >= least).groupBy(*keys).agg(F.count("*").alias("rows"), F.max("page").alias("first")).where("rows > 1 AND first IS NOT NULL")
    groups = stored(groups.select(*keys, "first"))
    if groups.count() <= broadcast_rows:
        groups = F.broadcast(groups)
    known = marked.join(groups, keys, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    record = warc_record(kind, page_urn(F.col("page")), page_urn(F.col("first")), F.col("url"), F.col("payload"), F.col("bytes"), F.col("digest"))
    known.select(record.alias("value")).write.option("lineSep", _EDGE).option("compression", "none").text(path)


# --- reading ---------------------------------------------------------------------------------


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, value``: the bytes between delimiters, each in the input split in which it starts."""
    lines = spark.read.option("lineSep", DELIMITER).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, place, bytes) of each chunk; place counts from the first chunk of its split."""
    now, place = None, 0
    for batch in batches:
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (file, block) != now:
                now, place = (file, block), 0
            raw = value.as_py()
            yield file, block, place, raw
            place += len(raw) + len(DELIMITER)


def record_head(raw: bytes) -> tuple[int, dict[str, str]] | None:
    """(bytes before the block, headers by lower-case name) of a candidate; none if it is no record.

    Where the delimiter stands for the edge after the headers, the chunk ends without it.
    """
    end = raw.find(b"\r\n\r\n")
    head = raw if end < 0 else raw[:end]
    lines = head.removeprefix(_MAGIC.encode()).split(b"\r\n")
    if lines[0] not in (b"0", b"1"):
        return None
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or len(length) > 18 or "warc-type" not in headers:
        return None
    return len(head) + 4, headers


def _http(block: bytes) -> tuple[int, int | None]:
    """(where the payload of an HTTP block begins, its stated length)."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return 0, None
    for line in block[:end].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return end + 4, int(value)
    return end + 4, None


_FOUND = "file string, block long, place long, size long, successor long, record_id string, type string, uri string, refers_to string, stated_digest string, payload_bytes long, digest string"


def _payload_facts(kind: str, block: bytes) -> tuple[int, str]:
    """(bytes, SHA-1) of the payload; of a revisit, the bytes that its HTTP head states."""
    start, stated = _http(block)
    return (len(block) - start if kind != "revisit" or stated is None else stated), hashlib.sha1(block[start:]).hexdigest()


def _bare(digest: str | None) -> str | None:
    return digest.rpartition(":")[2].lower() if digest else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk, places counted within the split. A record's successor is null where the chunk is no record; its payload's facts are null where it goes beyond the chunk."""
    out: list[tuple] = []
    names = _FOUND.replace(" string", "").replace(" long", "").split(", ")

    def batch() -> pa.RecordBatch:
        types = [pa.string() if x.endswith("string") else pa.int64() for x in _FOUND.split(", ")]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        out.clear()
        return made

    for file, block, place, raw in _split_rows(batches):
        first = block == 0 and place == 0  # a file's first chunk holds its own magic
        start = place if first else place - len(_MAGIC)
        row = [file, block, start, len(raw) + len(DELIMITER), *[None] * 8]
        found = record_head(raw) if not first or raw.startswith(_MAGIC.encode()) else None
        if found:
            skip, h = found
            length = int(h["content-length"])
            row[4] = place + skip + length + len(_EDGE)
            row[5:10] = h.get("warc-record-id"), h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to"), _bare(h.get("warc-payload-digest"))
            if skip + length <= len(raw):
                row[10:] = _payload_facts(h["warc-type"], raw[skip : skip + length])
        out.append(tuple(row))
        if len(out) >= 2000:
            yield batch()
    if out:
        yield batch()


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of a split (sorted by file, block, offset) with ``exit``, the first offset beyond the split on their chain; null where it breaks off."""
    for rows in _splits(batches):
        exits: dict[int, int | None] = {}
        for offset, successor in zip(reversed(rows["offset"]), reversed(rows["successor"])):
            exits[offset] = exits[successor] if successor in exits else (successor if successor is not None and successor > rows["offset"][-1] else None)
        yield pa.RecordBatch.from_pydict({"file": rows["file"], "block": rows["block"], "offset": rows["offset"], "exit": [exits[o] for o in rows["offset"]]}, pa.schema([("file", pa.string()), ("block", pa.int64()), ("offset", pa.int64()), ("exit", pa.int64())]))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of one (file, block) at a time, bounded by the size of an input split."""
    held: dict[str, list] = {}
    for batch in batches:
        columns = batch.to_pydict()
        for values in zip(*columns.values()):
            row = dict(zip(columns, values))
            if held and (held["file"][-1], held["block"][-1]) != (row["file"], row["block"]):
                yield held
                held = {}
            for name, value in row.items():
                held.setdefault(name, []).append(value)
    if held:
        yield held


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The offsets of a split that lie on the chain from its entry."""
    for rows in _splits(batches):
        after = dict(zip(rows["offset"], rows["successor"]))
        on = []
        for entry in sorted({o for o, e in zip(rows["offset"], rows["entry"]) if e}):
            while entry in after and (not on or entry > on[-1]):
                on.append(entry)
                entry = after[entry]
        yield pa.RecordBatch.from_pydict({"file": rows["file"][: len(on)], "offset": on}, pa.schema([("file", pa.string()), ("offset", pa.int64())]))


def reachable(candidates: DataFrame) -> DataFrame:
    """``file, offset`` of the candidates that a chain of successors reaches from the start of their file.

    ``candidates``: file, block, offset, successor. Each split's task follows its chains to where they leave the split;
    only those that another split's chain may enter are left for pointer jumping: every round a pointer
    jumps over the one it points to and what is marked marks its target, so rounds grow with the logarithm
    of a file's splits. The chain from each split's true entry then gives its records.
    """
    by_split = candidates.select("file", "block", "offset", "successor").repartition("file", "block").sortWithinPartitions("file", "block", "offset")
    exits = stored(by_split.mapInArrow(_exits, "file string, block long, offset long, exit long"))
    doors = exits.where("exit IS NOT NULL").select("file", F.col("exit").alias("offset")).distinct()
    starts = exits.where("offset = 0").select("file", "offset")
    now = stored(exits.join(doors.unionByName(starts).distinct(), ["file", "offset"], "left_semi").select("file", "offset", F.col("exit").alias("next"), (F.col("offset") == 0).alias("marked")))
    marked = -1
    while (count := now.where("marked").count()) != marked:
        marked = count
        hit = now.where("marked AND next IS NOT NULL").select("file", F.col("next").alias("offset")).distinct().withColumn("hit", F.lit(True))
        ahead = now.select("file", F.col("offset").alias("next"), F.col("next").alias("beyond"))
        jumped = now.join(ahead, ["file", "next"], "left").join(hit, ["file", "offset"], "left")
        now = stored(jumped.select("file", "offset", F.col("beyond").alias("next"), (F.col("marked") | F.coalesce("hit", F.lit(False))).alias("marked")))
    entries = now.where("marked").select("file", "offset", F.lit(True).alias("entry"))
    walked = candidates.select("file", "block", "offset", "successor").join(entries, ["file", "offset"], "left")
    return stored(walked.repartition("file", "block").sortWithinPartitions("file", "block", "offset").mapInArrow(_reached, "file string, offset long"))


def _placed(spark: SparkSession, path: str, bases: DataFrame) -> DataFrame:
    """``file, offset, value``: each chunk with the delimiter that opens it, by its place in the file."""

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for file, block, place, raw in _split_rows(batches):
            first = block == 0 and place == 0
            held.append((file, block, place, raw) if first else (file, block, place - len(_MAGIC), _MAGIC.encode() + raw))
            size += len(raw)
            if size >= SLICE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    chunks = _chunks(spark, path).mapInArrow(run, "file string, block long, place long, value binary")
    return chunks.join(bases, ["file", "block"]).select("file", (F.col("base") + F.col("place")).alias("offset"), "value")


def _whole(pieces: DataFrame) -> DataFrame:
    """``file, offset, block_bytes`` of records whose chunks (file, record, offset, value) are all there; one record is put together at a time."""
    parts = pieces.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, record, parts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = _EDGE.encode().join(p["value"] for p in parts)
                skip, headers = record_head(raw.removeprefix(_MAGIC.encode()))
                body = raw[skip + len(_MAGIC) :][: int(headers["content-length"])]
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([record], pa.int64()), pa.array([body], pa.binary())], ["file", "offset", "body"])

    return parts.mapInArrow(run, "file string, offset long, body binary")


def _pieces(spark: SparkSession, path: str, bases: DataFrame, chunks: DataFrame, broadcast_rows: int) -> DataFrame:
    """The bytes of ``chunks`` (file, offset, record), read from the archives once more."""
    wanted = stored(chunks)
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    return _placed(spark, path, bases).join(wanted, ["file", "offset"])


def read_archives(spark: SparkSession, path: str, payload: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``file, offset, record_id, record_type, uri, refers_to, payload_bytes, payload_digest, intact`` of every record below ``path``, with ``body`` (the record's block) if ``payload``.

    Uncompressed WARC files are read in Spark's input splits, cut at every place where a record could begin. Tasks emit a candidate
    there with the offset of its successor (by its own Content-Length); pointer jumping from each file's start keeps the candidates that the
    chain reaches, so a record's magic inside a payload is none. Records with such a place inside are read once more and put together
    from their chunks; no other payload is moved. ``payload_digest`` is the SHA-1 of the payload as read (of a revisit, as stated), ``intact`` whether
    that is the stated one (null if none is stated).

    An empty folder gives no rows; a chain that breaks off (cut file, wrong length) ends its file's records there. A single record must fit in a task (2 GB).
    """
    found = stored(_chunks(spark, path).mapInArrow(_candidates, _FOUND))
    # the chunks of a file tile it, so the bytes of earlier splits say where a split's first chunk stands
    sizes = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(sizes.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base")))
    moved = found.join(bases, ["file", "block"])
    all_ = stored(moved.withColumn("offset", F.col("base") + F.col("place")).withColumn("successor", F.col("base") + F.col("successor")).drop("place", "base"))
    true = all_.join(reachable(all_), ["file", "offset"], "left_semi").where("successor IS NOT NULL")
    digest = F.when(F.col("type") == "revisit", F.coalesce("stated_digest", "digest")).otherwise(F.col("digest"))
    intact = F.when(F.col("type") == "revisit", F.lit(None)).otherwise(F.col("digest") == F.col("stated_digest"))
    fields = ["file", "offset", "record_id", F.col("type").alias("record_type"), "uri", "refers_to", "payload_bytes", digest.alias("payload_digest"), intact.alias("intact")]
    # chunks that lie inside a reached record; a split's records are in order, so the last one before a chunk owns it
    spanning = true.where("digest IS NULL")
    if not payload and spanning.isEmpty():
        return true.select(*fields)
    marked = all_.join(true.select("file", "offset", F.col("successor").alias("until")), ["file", "offset"], "left")
    last = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("record", F.last(F.when(F.col("until").isNotNull(), F.col("offset")), ignorenulls=True).over(last)).withColumn("until", F.last("until", ignorenulls=True).over(last))
    owned = owned.where(F.col("offset") < F.col("until")).select("file", "offset", "record")
    if not payload:
        owned = owned.join(spanning.select("file", F.col("offset").alias("record")), ["file", "record"], "left_semi")
    bodies = stored(_whole(_pieces(spark, path, bases, owned, broadcast_rows)))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_payload_facts("response", body.as_py()) for body in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("offset"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())], ["file", "offset", "real_bytes", "real_digest"])

    known = bodies.mapInArrow(facts, "file string, offset long, real_bytes long, real_digest string")
    filled = true.join(known, ["file", "offset"], "left").withColumn("digest", F.coalesce("digest", "real_digest")).withColumn("payload_bytes", F.coalesce("payload_bytes", "real_bytes"))
    out = filled.select(*fields)
    return out.join(bodies, ["file", "offset"], "left") if payload else out


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d*)>$", 1).try_cast("long")


def archive_pages(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per row of ``pages``, from archives written and read back.

    A null html is an empty payload, a null url has no Target-URI. Rows with the same id and payload are all responses if their id is the group's largest; a group
    without any id has no revisits. Very long pages are one record each; one below ``least`` bytes is never a revisit. Other columns are ignored, an empty table gives an empty result. The archives
    stay in the shared folder.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.warc"
    write_archives(pages, path, least)
    records = read_archives(spark, path)
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


OP13_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, coalesce(html, '') AS body FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 1000 AND page_id < first THEN first END AS refers_to FROM r"""
