"""WARC archives: writing pages as records, reading them back by their boundary chain.

A record is found by its magic, but a payload may hold the magic too.  So every
block of an archive emits *candidates* with the offset of the record that would
follow, and only those on the chain that starts at offset 0 are records.  The
chain is followed by pointer jumping: a block shortcuts it to where it leaves
the block, and rounds that double the shortcuts find where each block is entered.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmill.llm.common import marked_among, stage

MAGIC = b"WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Copies of the join's small side, so that one payload's pages meet in several tasks.
SALTS = 16
BLOCK = 4 << 20


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four letters."""
    digest = F.sha1(payload)

    def letters(i: Column) -> Column:
        bits = F.conv(F.substring(digest, i * 5 + 1, 5), 16, 10).cast("int")
        return F.concat(
            *(F.substring(F.lit(BASE32), F.pmod(F.floor(bits / (1 << s)), F.lit(32)).cast("int") + 1, 1) for s in (15, 10, 5, 0))
        )

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, bytes, top: of equal payloads the page with the largest id is the response.

    Payloads under ``least_bytes`` are all responses (top is null).  Only digests
    are brought together; a payload moves where a bounded bitmap of the digests
    found twice says that it may have equals.  Pages that share a payload are dealt
    out by a salt, the small side is repeated for it.
    """
    keyed = pages.select(
        "page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload")
    ).select(
        "*", sha1_base32(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"),
    )
    shared = stage(
        keyed.where(F.col("bytes") >= least_bytes)
        .groupBy("digest", "bytes").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n")
    )
    marked = marked_among(keyed, ["digest", "bytes"], shared, "met")
    alone = marked.where("NOT met").drop("met").withColumn("top", F.lit(None).cast(pages.schema["page_id"].dataType))
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    meeting = marked.where("met").drop("met").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return alone.unionByName(meeting.join(salted, ["digest", "bytes", "salt"], "left").drop("salt"))


def record_of(page: DataFrame, date: str) -> Column:
    """A record as text without its last line end."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload").cast("string")))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("top"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, block, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of page_id, url, html (string or binary); an archive per task.

    Null html is an empty payload; null url leaves the header out; a null page_id
    is written as "none" (and is the response only where no page of the payload
    has an id); repeated rows are records of their own; an empty table gives an
    archive without records.  Other columns are not read.  Spark's own writer
    commits the files, so a task that is lost leaves nothing behind.
    """
    rows = with_roles(pages, least_bytes)
    rows.select(record_of(rows, date).alias("value")).write.option("lineSep", "\r\n").option("compression", "none").text(path)


def opened(path: str):
    """The archive as a seekable file, from whatever store its URI names."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", path))
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


#: Bytes of a field name at most, and what may begin a line: an end, a name, or a name with its colon.
LONGEST_NAME = 256
MAYBE_NAME = re.compile(rb"\r\Z|[!-9;-~]{1,%d}(?::|\r?\Z)" % LONGEST_NAME)


def header_at(file, offset: int, size: int) -> tuple[dict[str, str], int] | None:
    """Fields of a header and the offset behind it; None where the lines are none.

    Bytes are read and searched once, and a line is given up as soon as what
    stands before a colon cannot be a name.
    """
    data, at, end, searched, step = bytearray(), offset + len(MAGIC), 0, 0, 4096
    fields: dict[str, str] = {}
    while True:
        stop = data.find(b"\r\n", max(end, searched - 1))
        if stop < 0:
            searched = len(data)
            name = bytes(data[end : end + LONGEST_NAME + 1])
            if at >= size or name and not MAYBE_NAME.match(name):
                return None
            more = file.read_at(min(step, size - at), at)
            data += more
            at, step = at + len(more), step * 2
            continue
        line, end = bytes(data[end:stop]), stop + 2
        if not line:
            return fields, offset + len(MAGIC) + end
        name, colon, value = line.partition(b":")
        if not colon or len(name) > LONGEST_NAME or not re.fullmatch(rb"[!-9;-~]+", name):
            return None
        fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")


def block_candidates(archive: str, size: int, block: int, block_bytes: int) -> pd.DataFrame:
    """Candidates that begin in a block, each with its successor and where its chain leaves the block.

    Candidates whose chains pass through one another form a forest in the block;
    ``first`` and ``last`` number it so that c lies behind e if and only if
    c.first <= e.first <= c.last.
    """
    start, stop = block * block_bytes, min((block + 1) * block_bytes, size)
    found = []
    with opened(archive) as file:
        data = file.read_at(min(stop + len(MAGIC) - 1, size) - start, start)
        at = data.find(MAGIC)
        while at >= 0:
            if head := header_at(file, start + at, size):
                fields, body = head
                length = fields.get("content-length", "")
                if length.isascii() and length.isdigit() and body + int(length) + 4 <= size:
                    found.append((start + at, body, int(length), fields))
            at = data.find(MAGIC, at + 1)
    place = {c[0]: i for i, c in enumerate(found)}
    after = [place.get(body + length + 4, -1) for _, body, length, _ in found]
    inside = [1] * len(found)
    for i, j in enumerate(after):  # offsets ascend, so a successor comes later
        if j >= 0:
            inside[j] += inside[i]
    exits, first, free, roots = [0] * len(found), [0] * len(found), [0] * len(found), 0
    for i in range(len(found) - 1, -1, -1):
        j = after[i]
        if j < 0:
            exits[i], first[i] = found[i][1] + found[i][2] + 4, roots
            roots += inside[i]
        else:
            exits[i], first[i] = exits[j], free[j]
            free[j] += inside[i]
        free[i] = first[i] + 1
    get = lambda name: [c[3].get(name) for c in found]
    return pd.DataFrame({
        "archive": archive, "size": size, "block": block, "offset": [c[0] for c in found], "exit": exits,
        "first": first, "last": [f + n - 1 for f, n in zip(first, inside)],
        "body": [c[1] for c in found], "length": [c[2] for c in found],
        "record_id": get("warc-record-id"), "record_type": get("warc-type"), "refers_to": get("warc-refers-to"),
        "url": get("warc-target-uri"), "digest": get("warc-payload-digest"),
    })


CANDIDATE = (
    "archive string, size long, block long, offset long, exit long, first long, last long, body long, length long,"
    " record_id string, record_type string, refers_to string, url string, digest string"
)


def on_chain(candidates: DataFrame) -> DataFrame:
    """Of staged candidates those on the chain from offset 0 of their archive.

    Each round doubles both how far a shortcut goes and how many entries are
    known, so rounds are the logarithm of the blocks of the longest archive.
    """
    jumps = candidates.select("archive", "offset", "exit")
    entries = candidates.where("offset = 0").select("archive", "offset")
    blocks = candidates.agg(F.max("block")).first()[0]  # one number
    reach = 1
    while blocks is not None and reach <= blocks:
        further = entries.join(jumps, ["archive", "offset"]).select("archive", F.col("exit").alias("offset"))
        entries = stage(entries.union(further).distinct())
        nexts = jumps.select("archive", F.col("offset").alias("exit"), F.col("exit").alias("far"))
        jumps = stage(jumps.join(nexts, ["archive", "exit"], "left").select(
            "archive", "offset", F.coalesce("far", "exit").alias("exit")
        ))
        reach *= 2
    entered = candidates.join(entries, ["archive", "offset"]).select("archive", "block", F.col("first").alias("entry"))
    return candidates.join(entered, ["archive", "block"]).where("first <= entry AND entry <= last").drop("entry")


def read_archives(spark: SparkSession, path: str, block_bytes: int = BLOCK) -> DataFrame:
    """The records of all archives under ``path``: record_id, record_type, refers_to, url, payload, digest, verified.

    Archives are read in blocks, so their size is free.  A payload is what
    follows the HTTP header (null for revisits), digest the base32 SHA-1 of its
    bytes as read (for revisits, the one stated), verified whether it equals the
    one stated.  Where a chain breaks, the archive's records end.  Empty archives
    have none.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    blocks = files.select(
        F.col("path").alias("archive"), F.col("length").alias("size"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))).alias("block"),
    ).repartition(tasks, "archive", "block")

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, size, block in batch.itertuples(index=False):
                found = block_candidates(archive, size, block, block_bytes)
                if len(found):
                    yield found

    def loaded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["record_id", "record_type", "refers_to", "url", "payload", "digest", "verified"]
        rows, waiting = [], 0
        for batch in batches:
            for archive, records in batch.groupby("archive"):
                with opened(archive) as file:
                    for r in records.itertuples(index=False):
                        payload, digest = None, (r.digest or "").removeprefix("sha1:")
                        if r.record_type != "revisit":
                            payload = file.read_at(r.length, r.body).partition(b"\r\n\r\n")[2]
                            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            waiting += len(payload)
                        rows.append((
                            r.record_id, r.record_type, r.refers_to, r.url, payload, digest, r.digest == f"sha1:{digest}"
                        ))
                        if waiting >= block_bytes:
                            yield pd.DataFrame(rows, columns=names)
                            rows, waiting = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    candidates = stage(blocks.mapInPandas(scanned, CANDIDATE))
    kept = on_chain(candidates).repartition(tasks, "archive", "offset")
    return kept.select("archive", "body", "length", "record_id", "record_type", "refers_to", "url", "digest").mapInPandas(
        loaded,
        "record_id string, record_type string, refers_to string, url string, payload binary, digest string, verified boolean",
    )


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def resolved(records: DataFrame) -> DataFrame:
    """Per record page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    Revisits get size and digest from the response they refer to, which is
    repeated for each salt, so that many revisits of one response spread.
    """
    read = stage(records.select(
        page_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("bytes"),
        "digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"), "verified",
    ))
    responses = read.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("bytes").alias("full"), F.col("digest").alias("full_digest"),
    ).dropDuplicates(["refers_to", "full_digest"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = read.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    seen = revisits.join(responses, ["refers_to", "salt"]).where("digest = full_digest")
    return read.where("record_type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"), "verified",
    ).unionByName(seen.select(
        "page_id", F.col("full").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type",
        "refers_to", "verified",
    ))
