"""Media columns: payloads as images, cut into content-defined chunks that are stored once.

A payload becomes a binary PPM image of 64 pixels a row.  A gear hash over the
last 32 bytes cuts it where the content says so; chunk digests meet in Spark
joins, the first image that holds a chunk owns it, and the store keeps of every
image the chunks it owns and the ordered list of all.  Images are rebuilt from
the store and verified against their digest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import marked_among, perhaps_among, stage

UNIT = 192
LEAST, MOST, CUT_BITS = 256, 8192, 10
#: Store rows leave a task in batches of so many bytes.
BATCH = 8 << 20


def gear_table() -> np.ndarray:
    """256 well-mixed 32-bit numbers (the finaliser of splitmix64 over 1 to 256)."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))).astype(np.uint32)


GEAR = gear_table()


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a payload: 256 to 8192 bytes, about 1280 on average.

    The hash at a byte is the sum of the gear numbers of the last 32 bytes, each
    shifted by its distance; doubling the window five times gives all at once.
    """
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    ends, start = [], 0
    for at in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST:
            start = at
            ends.append(start)
    while len(data) - start > MOST:
        start += MOST
        ends.append(start)
    if start < len(data):
        ends.append(len(data))
    return ends


def chunks_of(payload: bytes) -> list[tuple[bytes, int]]:
    """Digest and length of each chunk of a payload, in order."""
    ends = chunk_ends(payload)
    return [(hashlib.sha256(payload[a:b]).digest()[:20], b - a) for a, b in zip([0, *ends[:-1]], ends)]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with blanks to a positive multiple of 192 bytes, and the size without padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" "), len(data)


def image_header(payload_bytes: int) -> bytes:
    return b"P6\n64 %d\n255\n" % (payload_bytes // UNIT)


def image_of(payload: bytes) -> bytes:
    """The lossless stored form: a PPM, three 8-bit samples per pixel, 64 pixels a row."""
    return image_header(len(payload)) + payload


def samples_of(image: bytes) -> bytes:
    """The samples of such an image."""
    kind, size, most, samples = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P6" or most != b"255" or len(samples) != width * height * 3:
        raise ValueError("not an image of this store")
    return samples


def feature_of(samples: bytes) -> str:
    """Mean, variance (both in hundredths, rounded down) and 16-bin histogram in per mille."""
    values = np.frombuffer(samples, np.uint8).astype(np.int64)
    n, total, squares = len(values), int(values.sum()), int((values * values).sum())
    bins = np.bincount(values >> 4, minlength=16) * 1000 // n
    return f"{total * 100 // n};{(squares * n - total * total) * 100 // (n * n)};{','.join(map(str, bins))}"


def each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            payload, n_bytes = payload_of(text)
            yield b.schema.field("doc_id").type, doc_id, payload, n_bytes


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the digest of its image and of its chunks, without bytes."""
    rows: list[tuple] = []
    kind = pa.int64()

    def batch():
        columns = zip(*rows)
        types = (kind, pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["doc_id", "n_bytes", "payload_bytes", "media", "digests", "lengths"],
        )
        rows.clear()
        return out

    for kind, doc_id, payload, n_bytes in each_text(batches):
        digests, lengths = zip(*chunks_of(payload))
        rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(image_of(payload)).digest(), digests, lengths))
        if len(rows) >= 2000:
            yield batch()
    if rows:
        yield batch()


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per image of a task, once, its payload under zstd; so it is small when it moves."""
    import zstandard

    press, seen = zstandard.ZstdCompressor(level=3), set()
    media, packed, size = [], [], 0
    names = ["media", "packed"]
    for _, _, payload, _ in each_text(batches):
        digest = hashlib.sha256(image_of(payload)).digest()
        if digest in seen:
            continue
        seen.add(digest)
        media.append(digest)
        packed.append(press.compress(payload))
        size += len(packed[-1])
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(media, pa.binary()), pa.array(packed, pa.binary())], names=names)
            media, packed, size = [], [], 0
    if media:
        yield pa.RecordBatch.from_arrays([pa.array(media, pa.binary()), pa.array(packed, pa.binary())], names=names)


STORED = "media binary, payload_bytes long, own binary, chunks array<struct<digest binary, length int, owned boolean, shared boolean>>"
CHUNK = pa.struct([("digest", pa.binary()), ("length", pa.int32()), ("owned", pa.bool_()), ("shared", pa.bool_())])


def stored_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Store rows of images that share no chunk: they own all of theirs."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    rows: list[tuple] = []
    size = 0

    def batch():
        types = (pa.binary(), pa.int64(), pa.binary(), pa.list_(CHUNK))
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["media", "payload_bytes", "own", "chunks"]
        )
        rows.clear()
        return out

    for _, _, payload, _ in each_text(batches):
        chunks = [
            {"digest": digest, "length": length, "owned": True, "shared": False} for digest, length in chunks_of(payload)
        ]
        rows.append((hashlib.sha256(image_of(payload)).digest(), len(payload), press.compress(payload), chunks))
        size += len(rows[-1][2])
        if size >= BATCH:
            yield batch()
            size = 0
    if rows:
        yield batch()


def owned_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every image keep the bytes of the chunks it owns; an image that several tasks sent is stored once."""
    import zstandard

    press, free, seen = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), set()
    for b in batches:
        fresh = [i for i, media in enumerate(b["media"].to_pylist()) if not (media in seen or seen.add(media))]
        b = b.take(pa.array(fresh, pa.int64()))
        own = []
        for packed, chunks in zip(b["packed"].to_pylist(), b["chunks"].to_pylist()):
            payload, at, kept = free.decompress(packed), 0, []
            for c in chunks:
                if c["owned"]:
                    kept.append(payload[at : at + c["length"]])
                at += c["length"]
            own.append(packed if len(kept) == len(chunks) else press.compress(b"".join(kept)))
        yield pa.RecordBatch.from_arrays(
            [b["media"], b["payload_bytes"], pa.array(own, pa.binary()), b["chunks"]],
            names=["media", "payload_bytes", "own", "chunks"],
        )


def store_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue, store) of the texts of ``docs`` (doc_id, text; other columns are not read).

    The catalogue has a row per input row: doc_id, n_bytes, payload_bytes, media
    (SHA-256 of its image).  The store has a row per different image: media,
    payload_bytes, own (zstd of the chunks it owns, in order) and chunks (ordered
    list of digest, length, owned, shared).  Null and empty texts are payloads of
    blanks; repeated rows and equal texts share an image; an empty table gives an
    empty catalogue and store.  A chunk is owned by the image with the smallest
    digest among those that hold it, at its first place there.

    Chunks are first counted by 64-bit hashes of their digests; documents none of
    whose chunks come twice are stored where they are read, and only the others,
    copies among them, meet in the joins.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", "text")
    catalogue = stage(narrow.mapInArrow(
        listed, f"doc_id {kind}, n_bytes long, payload_bytes long, media binary, digests array<binary>, lengths array<int>"
    ))
    hashes = catalogue.select("doc_id", F.explode("digests").alias("digest")).select("doc_id", F.xxhash64("digest").alias("k"))
    twice = stage(hashes.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"))
    meeting = stage(perhaps_among(hashes, ["k"], twice).join(twice, "k", "left_semi").select("doc_id").distinct())
    # the flag goes by doc_id on both sides, so catalogue and texts agree on who meets
    images = perhaps_among(catalogue, ["doc_id"], meeting).groupBy("media").agg(
        F.first("payload_bytes").alias("payload_bytes"), F.first("digests").alias("digests"), F.first("lengths").alias("lengths")
    )
    places = images.select(
        "media", "payload_bytes", F.posexplode(F.arrays_zip("digests", "lengths")).alias("seq", "c")
    ).select("media", "payload_bytes", "seq", F.col("c.digests").alias("digest"), F.col("c.lengths").alias("length"))
    places = stage(places)
    owners = places.groupBy("digest").agg(
        F.min(F.struct("media", "seq")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    owned = (F.col("first.media") == F.col("media")) & (F.col("first.seq") == F.col("seq"))
    lists = (
        places.join(owners, "digest")
        .select("media", "payload_bytes", "seq", F.struct(
            "digest", "length", owned.alias("owned"), (F.col("n") > 1).alias("shared")
        ).alias("c"))
        .groupBy("media").agg(F.first("payload_bytes").alias("payload_bytes"), F.sort_array(F.collect_list(F.struct("seq", "c"))).alias("list"))
        .select("media", "payload_bytes", F.col("list.c").alias("chunks"))
    )
    flagged = marked_among(narrow, ["doc_id"], meeting, "meets")
    packed = flagged.where("meets").select("doc_id", "text").mapInArrow(compressed, "media binary, packed binary")
    split = lists.join(packed.hint("merge"), "media").select("media", "payload_bytes", "packed", "chunks").mapInArrow(owned_parts, STORED)
    alone = flagged.where("NOT meets").select("doc_id", "text").mapInArrow(stored_whole, STORED)
    store = stage(split.unionByName(alone))
    return catalogue.select("doc_id", "n_bytes", "payload_bytes", "media"), store


def own_chunks(own: bytes, chunks: list[dict], free) -> dict[int, bytes]:
    """Bytes of an image's owned chunks by their place in its list."""
    data, at, found = free.decompress(own), 0, {}
    for i, c in enumerate(chunks):
        if c["owned"]:
            found[i] = data[at : at + c["length"]]
            at += c["length"]
    return found


def shared_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    free = zstandard.ZstdDecompressor()
    for b in batches:
        digests, data = [], []
        for own, chunks in zip(b["own"].to_pylist(), b["chunks"].to_pylist()):
            parts = own_chunks(own, chunks, free)
            for i, c in enumerate(chunks):
                if c["owned"] and c["shared"]:
                    digests.append(c["digest"])
                    data.append(parts[i])
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], names=["digest", "bytes"])


REBUILT = "media binary, payload binary, tail_crc32 long, media_bytes long, feature string"


def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join owned and fetched chunks to the image, verify it, and compute on its samples."""
    import zstandard

    free = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for media, own, chunks, fetched in zip(*(b[c].to_pylist() for c in ("media", "own", "chunks", "fetched"))):
            parts = own_chunks(own, chunks, free)
            parts.update((f["seq"], f["bytes"]) for f in fetched or ())
            payload = b"".join(parts[i] for i in range(len(chunks)))
            image = image_of(payload)
            if hashlib.sha256(image).digest() != media:
                raise ValueError("an image differs from its digest")
            samples = samples_of(image)
            rows.append((media, hashlib.sha256(samples).digest(), zlib.crc32(samples[-16:]), len(image), feature_of(samples)))
        types = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string())
        columns = list(zip(*rows)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["media", "payload", "tail_crc32", "media_bytes", "feature"],
        )


def read_media(store: DataFrame) -> DataFrame:
    """Rebuild and verify every image: media, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    An image that owns all its chunks is rebuilt where it is read; the others
    fetch what they lack by a join on the digest.  An image that does not come
    out equal to its digest fails the job.
    """
    lacking = F.exists("chunks", lambda c: ~c["owned"])
    whole = store.where(~lacking).select("media", "own", "chunks", F.lit(None).cast("array<struct<seq:int,bytes:binary>>").alias("fetched"))
    parts = store.where(lacking)
    chunks = store.where(F.exists("chunks", lambda c: c["owned"] & c["shared"])).select("own", "chunks").mapInArrow(
        shared_chunks, "digest binary, bytes binary"
    )
    wanted = parts.select("media", F.posexplode("chunks").alias("seq", "c")).where("NOT c.owned").select("media", "seq", "c.digest")
    fetched = wanted.join(chunks, "digest").groupBy("media").agg(F.collect_list(F.struct("seq", "bytes")).alias("fetched"))
    joined = parts.join(fetched, "media").select("media", "own", "chunks", "fetched")
    # the join that filled the store may have split the copies of an image between two tasks
    once = whole.unionByName(joined).mapInArrow(rebuilt, REBUILT).dropDuplicates(["media"])
    return once.select(
        "media", F.lower(F.hex("payload")).alias("payload_sha256"), "tail_crc32", "media_bytes",
        F.lower(F.hex("media")).alias("media_sha256"), "feature",
    )
