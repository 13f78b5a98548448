"""Bounded-space online best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, written
from .token_ids import by_size, cached_tokenizer

END_ID = 1
#: Characters that a task encodes at once: looking words up takes about 20 bytes for each.
BATCH_CHARACTERS = 2_000_000


class BoundedBestFit:
    """At most ``open_bins`` open bins, found through a bitset keyed by free space.

    Bit ``f`` is set when an open bin has ``f`` free places. A piece goes to the
    open bin with the least free space that still holds it; when none does and all
    bins are open, the fullest closes to make room for a new one. Bins that are
    exactly full close at once.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bitset, self.by_free, self.n_open, self.n_bins = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bitset ^= 1 << free
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece of 1 to ``capacity``."""
        if fitting := self.bitset >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self.n_open >= self.limit:
                self._take((self.bitset & -self.bitset).bit_length() - 1)
            found, free = self.n_bins, self.capacity
            self.n_bins += 1
        if left := free - length:
            self.by_free.setdefault(left, []).append(found)
            self.bitset |= 1 << left
            self.n_open += 1
        return found, self.capacity - free

    def still_open(self, most: int | None = None) -> set[int]:
        """The open bins, or ``most`` of them with the most free space."""
        return set([b for free in sorted(self.by_free, reverse=True) for b in self.by_free[free]][:most])


def repack(capacity: int, open_bins: int, last: bool):
    """Packs one group of carried pieces, longest first; all are placed for good when it is the last.

    All bins of the group stay open until it ends, for the short pieces that fill
    them come last; then the ``open_bins`` emptiest are carried on.
    """

    def pack(table):
        import pyarrow as pa

        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        fit = BoundedBestFit(capacity, table.num_rows)
        places = [fit.place(n) for n in table["length"].to_pylist()]
        still = set() if last else fit.still_open(open_bins)
        new = {"bin": pa.array([b for b, _ in places], pa.int64()), "offset": pa.array([o for _, o in places], pa.int64()), "carried": pa.array([b in still for b, _ in places], pa.bool_())}
        for name, column in new.items():
            table = table.set_column(table.schema.get_field_index(name), name, column)
        return table

    return pack


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, carried boolean"


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, open_bins: int = 256, fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Packs whole documents into sequences of at most ``capacity`` tokens.

    A document is its token ids and an end id; only one longer than ``capacity`` is
    cut, into pieces of ``capacity`` and a rest. Every task that reads texts packs
    its own pieces with ``BoundedBestFit`` while they stream by: nothing is
    shuffled, memory is ``open_bins`` bins. The pieces of bins still open at the end
    (at most ``open_bins`` a task) are packed again, longest first, ``fan_in`` tasks'
    at a time and with all of a group's bins (at most ``fan_in * open_bins``) open,
    until one group is left; each group carries its ``open_bins`` emptiest bins on.

    Result per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    and, if asked for, ids. Null and empty texts are the end id alone; rows that
    repeat an id are packed once each; null ids stay null; an empty table packs into
    nothing; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, fit = cached_tokenizer(tokenizer_path).encode, BoundedBestFit(capacity, open_bins)
        end, size = END_ID.to_bytes(4, "little"), 4 * capacity
        held: dict[int, list] = {}

        def made(rows, carried):
            columns = [[r[i] for r in rows] for i in range(7)]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            n = len(rows)
            arrays[5:5] = [pa.array([part] * n, pa.int64())]
            arrays.append(pa.array([carried] * n, pa.bool_()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "carried"]
            if with_ids:
                arrays.append(pa.array([r[7] for r in rows], pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for cut in by_size(texts, BATCH_CHARACTERS):
                for doc, found in zip(ids[cut], encode(texts[cut])):
                    found += end
                    for piece, at in enumerate(range(0, len(found), size)):
                        own = found[at : at + size]
                        b, offset = fit.place(len(own) // 4)
                        held.setdefault(b, []).append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), b, offset, own if with_ids else None))
                still = fit.still_open()
                closed = [b for b in held if b not in still]
                if closed:
                    yield made([r for b in closed for r in held.pop(b)], False)
        if held:
            yield made([r for own in held.values() for r in own], True)

    schema = PIECES + ", ids binary" * with_ids
    level = written(rows.mapInArrow(giving_back(pack), schema), "packed")
    done = [level.filter(~F.col("carried")).withColumn("level", F.lit(0))]
    number = 0
    while True:
        number += 1
        carried = level.filter("carried").withColumn("part", F.floor(F.col("part") / fan_in))
        top = carried.agg(F.max("part")).first()[0]
        if top is None:
            break
        last = top == 0

        level = written(carried.groupBy("part").applyInArrow(repack(capacity, open_bins, last), schema), "packed")
        done.append(level.filter(~F.col("carried")).withColumn("level", F.lit(number)))
        if last:
            break
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    sequence = F.col("bin") + F.shiftleft(F.col("part"), 32) + F.shiftleft(F.col("level").cast("long"), 58)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset", *["ids"] * with_ids)
