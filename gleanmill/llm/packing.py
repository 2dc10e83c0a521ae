"""Packing token sequences by minimum bin slack.

Every document ends with id 0 and is cut into full windows; what remains of it,
shorter than a window, is packed.  Of the remaining lengths only a histogram
counts: the longest is placed first, a bitset of reachable sums tells how close
the others can come to the room that is left, walking back through the bitsets
tells how many of each length that takes, and the pattern is used as often as
the counts allow.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

END_ID = 0
#: Remainders are packed whenever so many ids wait (4 bytes each).
WAITING = 2_000_000
#: Rows leave a task in batches of so many ids.
BATCH = 500_000


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str, specials: tuple[tuple[str, int], ...] = ()):
    """Encoder of a byte-level BPE vocabulary given as ranks; the ids are those of its json form.

    ``specials`` are the json form's added tokens, which its default setting finds in texts;
    without them such a text is encoded as any other.
    """
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))


#: Runs of blanks this long are encoded apart; the pattern itself would try every length of them.
LONG_RUN = 1000
# The blanks of the pattern: the characters with Unicode's property White_Space.
RUNS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_RUN)


def encoded(model, text: str) -> np.ndarray:
    """Ids of a text of any shape.

    The pattern makes one word of a run of blanks, all of it where the text or
    one of its special tokens comes next, else all but its last blank; so a long
    run is such a word by itself and the text around it is encoded as usual.
    """
    parts, start = [], 0
    whole = lambda piece: model.encode_to_numpy(piece, allowed_special="all", disallowed_special=())
    for run in RUNS.finditer(text):
        first, end = run.span()
        last = end == len(text) or any(text.startswith(special, end) for special in model.special_tokens_set)
        stop = end if last else end - 1
        parts += [whole(text[start:first]), np.array(model._encode_single_piece(text[first:stop]), np.uint32)]
        start = stop
    parts.append(whole(text[start:]))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts per length, within those given, whose sum is the largest up to ``room``."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << (length * part) & mask
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + part
            total -= length * part
    return taken


def patterns(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Multisets of lengths, each with how often it is used, until all are placed.

    Each use of a pattern as often as possible exhausts a length, so there are
    about as many patterns as lengths, however many pieces.
    """
    counts = {length: n for length, n in counts.items() if n}
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        taken = fullest({x: n for x, n in counts.items() if n}, capacity - seed)
        counts[seed] += 1
        taken[seed] = taken.get(seed, 0) + 1
        times = min(counts[x] // n for x, n in taken.items())
        for x, n in taken.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        yield taken, times


def powers(length: int) -> list[int]:
    """A length as a sum of different powers of two, largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class Packer:
    """Packs the documents of one task; what it holds is bounded by WAITING."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.by_length: dict[int, list] = {}
        self.waiting = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        full = len(ids) // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            yield from self.sequence([(doc_id, start, ids[start : start + self.capacity], len(ids))])
        if full < len(ids):
            self.by_length.setdefault(len(ids) - full, []).append((doc_id, full, ids[full:].copy(), len(ids)))
            self.waiting += len(ids) - full
            if self.waiting >= WAITING:
                yield from self.flush(False)

    def sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            yield doc_id, start, len(ids), ids.tobytes(), tokens, self.next, offset
            offset += len(ids)
        self.next += 1

    def flush(self, last: bool) -> Iterator[tuple]:
        """Pack what waits.  Windows that stay short wait on; the last are cut at powers of two, without padding."""
        short: list[tuple] = []
        for taken, times in patterns({x: len(rows) for x, rows in self.by_length.items()}, self.capacity):
            for _ in range(times):
                pieces = [self.by_length[x].pop() for x, n in taken.items() for _ in range(n)]
                if sum(x * n for x, n in taken.items()) == self.capacity:
                    yield from self.sequence(pieces)
                elif last:
                    yield from self.cut(pieces)
                else:
                    short += pieces
        self.by_length, self.waiting = {}, 0
        for piece in short:
            self.by_length.setdefault(len(piece[2]), []).append(piece)
            self.waiting += len(piece[2])

    def cut(self, pieces: list[tuple]) -> Iterator[tuple]:
        pieces = pieces[::-1]
        for size in powers(sum(len(p[2]) for p in pieces)):
            own: list[tuple] = []
            while size:
                doc_id, start, ids, tokens = pieces.pop()
                own.append((doc_id, start, ids[:size], tokens))
                if len(ids) > size:
                    pieces.append((doc_id, start + size, ids[size:], tokens))
                size -= min(size, len(ids))
            yield from self.sequence(own)


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, specials: tuple[tuple[str, int], ...] = ()
) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` ids.

    ``docs`` has doc_id and text; other columns are not read.  Returns per piece
    doc_id, start (ids of the document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens (with the end id), sequence_id and offset (place
    in the sequence, without gaps).  Texts of ``specials`` have their own id.  Null and empty texts are documents of the
    end id alone; null ids and repeated rows are documents of their own; an empty
    table gives no pieces.  Packing is a map over the partitions: no row moves,
    a task that is lost repeats its own, and sequence ids are its partition's
    number times 2**33 plus a count.  Sequences are full but for the last of each
    partition, which are cut at powers of two.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(ranks_path, pattern, specials)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []
        kinds = None

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        size = 0
        end = np.array([END_ID], "<u4")
        for b in batches:
            kinds = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                ids = np.append(encoded(model, text or "").astype("<u4"), end)
                for row in packer.add(doc_id, ids):
                    rows.append(row)
                    size += row[2]
                    if size >= BATCH:
                        yield batch()
                        size = 0
        for row in packer.flush(True):
            rows.append(row)
            size += row[2]
            if size >= BATCH:
                yield batch()
                size = 0
        if rows:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(packed, schema)
