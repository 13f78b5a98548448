"""Minimum bin slack: windows filled as closely as the remaining lengths allow."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_ids import cached_byte_tokenizer

END_ID = 0


def closest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of a multiset of lengths (length to count) the sub-multiset with the largest sum up to ``room``, as counts.

    Subset sums are the bits of an integer. A length's count is split into 1, 2, 4, ...
    and a rest, one shift each, longest lengths first; the bits before each shift are kept
    and lead back from the best sum to the counts.
    """
    bits, mask, wanted = 1, (2 << room) - 1, 1 << room
    steps = []
    for length in sorted((v for v in counts if v <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not bits & wanted:
            take = min(take, left)
            steps.append((length, take, bits))
            bits |= bits << (length * take) & mask
            left, take = left - take, take * 2
        if bits & wanted:
            break
    at, found = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            found[length] = found.get(length, 0) + take
    return found


class SlackWindows:
    """Pieces below ``capacity`` wait in a pool by length; windows take the multiset that leaves least slack.

    A window gets the longest waiting piece and the multiset that best fills the rest. As
    all pieces left are longer than its slack, one is cut to fill it exactly. A piece
    is (key, start, ids).
    """

    def __init__(self, capacity: int):
        self.capacity, self.pool, self.counts, self.size, self.tokens = capacity, {}, {}, 0, 0

    def add(self, piece: tuple) -> None:
        n = len(piece[2])
        self.pool.setdefault(n, []).append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.size, self.tokens = self.size + 1, self.tokens + n

    def _take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length], self.pool[length]
        self.size, self.tokens = self.size - 1, self.tokens - length
        return piece

    def window(self) -> list[tuple]:
        """The pieces of the next window; it is full unless the pool holds less than a window."""
        window = [self._take(max(self.counts))]
        room = self.capacity - len(window[0][2])
        for length, n in closest_multiset(self.counts, room).items():
            window += [self._take(length) for _ in range(n)]
            room -= length * n
        if room and self.counts:
            key, start, ids = self._take(max(self.counts))
            window.append((key, start, ids[:room]))
            self.add((key, start + room, ids[room:]))
        return window


def powers_of_two(pieces: list[tuple]) -> list[list[tuple]]:
    """The pieces, cut where needed, in windows whose lengths are powers of two, the longest first."""
    left, out = sum(len(p[2]) for p in pieces), []
    pieces = sorted(pieces, key=lambda p: -len(p[2]))
    while left:
        room = 1 << left.bit_length() - 1
        left -= room
        window = []
        while room:
            key, start, ids = pieces.pop(0)
            window.append((key, start, ids[:room]))
            if len(ids) > room:
                pieces.insert(0, (key, start + room, ids[room:]))
            room -= len(window[-1][2])
        out.append(window)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long"


def pack_windows(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, pool: int = 16_384, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, end_id: int = END_ID, text_bytes: int = 8_000_000) -> DataFrame:
    """Packs all tokens of all documents into windows of ``capacity`` tokens without padding.

    A document is its token ids and an end id. Where texts are read, it is cut into whole
    windows and a rest; rests wait in a pool of at most ``pool`` pieces, of which
    ``SlackWindows`` fills windows: when the pool is full half of it, at a task's end all. A
    task's last tokens, less than a window, go to windows whose lengths are powers of two,
    which need no padding either. Nothing is shuffled, and memory is the pool.

    Result per piece: doc_id, start (ids of its document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset (place there), window (the sequence's length) and, if asked
    for, ids. Null and empty texts are the end id alone; rows that repeat an id are packed once
    each; null ids stay null; an empty table packs into nothing; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def pack(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        encode, open_windows = cached_byte_tokenizer(tokenizer_path).encode, SlackWindows(capacity)
        number = TaskContext.get().partitionId() << 32
        made: list[tuple] = []

        def place(window: list[tuple]) -> None:
            nonlocal number
            offset, whole = 0, sum(len(p[2]) for p in window)
            for (doc, tokens), start, ids in window:
                raw = ids.tobytes()
                made.append((doc, start, len(ids), zlib.crc32(raw), tokens, number, offset, whole, *([raw] if with_ids else [])))
                offset += len(ids)
            number += 1

        def out():
            names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
            arrays = [pa.array([r[i] for r in made], pa.binary() if n == "ids" else pa.int64()) for i, n in enumerate(names)]
            made.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + text_bytes, "right")))
                ids, offsets = encode(batch.column(1).slice(at, upto - at))
                for i, doc in enumerate(batch.column(0).slice(at, upto - at).to_pylist()):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    key, rest = (doc, len(own)), len(own) // capacity * capacity
                    for start in range(0, rest, capacity):
                        place([(key, start, own[start : start + capacity])])
                    if rest < len(own):
                        open_windows.add((key, rest, own[rest:].copy()))
                    if open_windows.size > pool:
                        while open_windows.size > pool // 2 and open_windows.tokens >= capacity:
                            place(open_windows.window())
                    if len(made) > 20_000:
                        yield out()
                at = upto
        while open_windows.tokens >= capacity:
            place(open_windows.window())
        for window in powers_of_two([open_windows._take(n) for n in sorted(open_windows.counts) for _ in range(open_windows.counts[n])]):
            place(window)
        if made:
            yield out()

    return rows.mapInArrow(pack, PIECES + ", ids binary" * with_ids)
