"""Katz back-off language model of word n-grams, trained and evaluated over a whole corpus.

The probability of a word after a context of ``order`` - 1 words is its Good-Turing
discounted count over the count of the context when training has the n-gram; otherwise it
is the context's back-off weight times the probability after the context without its
first word, and so on down to unigrams, which leave what discounting takes to unknown
words. A back-off weight is the mass a context leaves over the lower-order mass of the
words that never followed it, so every distribution sums to one over the training words
and one unknown word.

Tables are kept in blocks, as packed arrays: a shuffled row is a block of texts and a
bucket of n-grams, with the n-grams of a block counted once.

1. vocabulary: each block of texts asks the word buckets for its distinct words; answers
   (word number, training count) are written by reading task.
2. orders from 2 to below the last: the tasks read their texts again, with the answers so
   far, and ask the context buckets for their distinct n-grams. Answers are training
   counts, and for each context what its back-off weight is made of. Counts of counts
   give the order's discounts, so the next reading can work out every token's probability.
3. the last order: n-grams go out with the documents that hold them. A bucket keeps sums
   for each document of all that doesn't depend on the discounts, and the table of
   contexts that have unseen n-grams.
4. scores: sums and back-off weights of those contexts, added up by document.

A context with more than ``hot_share`` of all training tokens is spread over buckets by
its next word; there are fewer than 1 / hot_share of them in an order, and their sums go
through the driver. Apart from where their sums are added, all contexts are treated alike.
"""

from __future__ import annotations

import itertools
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, new_path, open_fs, partitions, written
from .jaccard import MULTIPLIER, changes, mixed, runs, split_by
from .token_ids import by_size

#: Counts up to this are discounted.
DISCOUNTED = 5
BLOCK_CHARACTERS = 4_000_000
#: Text bytes for each bucket, which a task holds whole.
BUCKET_BYTES = 12 << 20
FRAMES = "dest int, part int, block int, kind int, data binary"
ASK, ANSWER, OCCURRENCES, DOCUMENTS, CONTEXTS, COUNTS, HOT = range(7)
#: A context with more than this share of all tokens is hot: its n-grams are dealt out by the next word too.
HOT_SHARE = 1 / 1000


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; unsigned numbers in as few bytes as all fit."""
    import zstandard

    out = []
    for a in arrays:
        if a.dtype.kind == "u" and a.itemsize > 1:
            most = int(a.max()) if len(a) else 0
            a = a.astype(np.min_scalar_type(most), copy=False)
        a = np.ascontiguousarray(a)
        out.append(struct.pack("<4sq", a.dtype.str.encode().ljust(4), len(a)))
        out += [a.view(np.uint8)[i :: a.dtype.itemsize].tobytes() for i in range(a.dtype.itemsize)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<4sq", raw, at)
        kind = np.dtype(kind.decode().strip())
        at += 12
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a position of each, the value's number at each position), as ``np.unique`` gives them.

    The place takes the low bits' place in the sorted numbers, for sorting values is far
    faster than sorting places; where high bits alone don't tell values apart, ``np.unique`` does it.
    """
    n = len(hashes)
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    packed = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
    at = (packed & low).astype(np.int64)
    values = hashes[at]
    new = changes(values)
    if (changes(packed & ~low) != new).any():
        return np.unique(hashes, return_index=True, return_inverse=True)
    inverse = np.empty(n, np.int64)
    inverse[at] = np.cumsum(new) - 1
    return values[new], at[new], inverse


def frames(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows)) if rows else [[]] * 5
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["dest", "part", "block", "kind", "data"])


def discounts(counts: list[int]) -> list[float]:
    """Good-Turing discounts of counts 0 to ``DISCOUNTED`` from counts of counts (index 1 to DISCOUNTED + 1).

    Katz's formula; where the counts of counts don't give a number strictly between
    0 and 1 (small corpora), half a count is taken off instead.
    """
    k = DISCOUNTED
    out = [1.0]
    for r in range(1, k + 1):
        d = (r - 0.5) / r
        if counts[1] and counts[r]:
            tail = (k + 1) * counts[k + 1] / counts[1]
            good = (r + 1) * counts[r + 1] / counts[r] / r
            if tail < 1 and 0 < (good - tail) / (1 - tail) < 1:
                d = (good - tail) / (1 - tail)
        out.append(d)
    return out


def is_training(doc_id: int | None, folds: int, held: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds != held


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text)."""
    import pandas as pd

    words = [(t or "").encode().lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.array([w for ws in words for w in ws], dtype=object)
    hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    return np.maximum(hashes, np.uint64(2)), lengths  # 0 and 1 are the end and the start of a text


def blocks_of(batches, folds: int, held: int, characters: int):
    """(number, ids, training flags, hashes of all words, lengths) of each block of texts. No words are held between blocks."""
    number = 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for cut in by_size(texts, characters):
            train = np.array([is_training(i, folds, held) for i in ids[cut]], bool)
            yield number, ids[cut], train, *hashed(texts[cut])
            number += 1


END, START = 0, 1


def ask_vocabulary(width: int, folds: int, held: int, characters: int):
    """Blocks of texts to word buckets: the distinct words, and how often training texts have them."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, _, train, hashes, lengths in blocks_of(batches, folds, held, characters):
            words, _, index = distinct(hashes)
            counts = np.bincount(index, weights=np.repeat(train, lengths), minlength=len(words)).astype(np.uint32)
            rows = [(bucket, part, number, ASK, pack(words[at], counts[at])) for bucket, at in split_by((words % np.uint64(width)).astype(np.int64))]
            if rows:
                yield frames(rows)

    return giving_back(run)


def answer_vocabulary(width: int):
    """Word buckets to reading tasks: word numbers and training counts, in the order asked; and counts of counts."""

    def run(batches):
        asked: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                words, counts = unpack(r["data"])
                asked.setdefault(r["dest"], []).append((r["part"], r["block"], words, counts))
        for bucket, found in asked.items():
            words, _, index = distinct(np.concatenate([f[2] for f in found]).astype(np.uint64))
            total = np.bincount(index, weights=np.concatenate([f[3] for f in found]), minlength=len(words)).astype(np.int64)
            # frequent words get small numbers, which pack well; 0 and 1 are taken
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(words))
            number, at = rank * width + bucket + 2, 0
            for part, block, own, _ in found:
                own = index[at : at + len(own)]
                at += len(own)
                check = np.array([zlib.crc32(words[own].tobytes())], np.uint32)
                yield frames([(bucket, part, block, ANSWER, pack(check, number[own].astype(np.uint64), total[own].astype(np.uint64)))])
            known = total[total > 0]
            yield frames([(bucket, -1, -1, COUNTS, pack(np.concatenate([[len(known), known.sum()], np.bincount(known[known <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)]).astype(np.int64)))])

    return giving_back(run)


class Unigrams:
    """Unigram probabilities from counts: discounted, with the rest for the unknown word."""

    def __init__(self, n: int, v: int, counts: list[int]):
        self.n, self.v, self.discounts = n, v, discounts(counts)
        seen = sum(d * r * counts[r] for r, d in enumerate(self.discounts) if r)
        large = n - sum(r * counts[r] for r in range(1, DISCOUNTED + 1))
        # without small counts one more count is shared out, for the unknown word
        self.total = n if any(counts[1 : DISCOUNTED + 1]) else n + 1
        self.unknown = 1 - (seen + large) / self.total if self.total else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        d = np.ones(DISCOUNTED + 1)
        d[1:] = self.discounts[1:]
        factor = np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0)
        return np.where(counts == 0, self.unknown, factor * counts / max(self.total, 1))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.n + 0.5 * (self.v + 1)))


@dataclass
class Order:
    """A finished order: its number, discounts, where its answers are, and the sums of hot contexts (small counts, taken mass)."""

    n: int
    discounts: list[float]
    answers: str
    hot: dict[int, tuple] = field(default_factory=dict)

    def seen(self, counts: np.ndarray, divisor: np.ndarray) -> np.ndarray:
        """The discounted probability of n-grams with these training counts; 0 for a count of 0."""
        d = np.array(self.discounts)
        return np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0) * counts / np.maximum(divisor, 1)


def divisor_of(total: np.ndarray, small: np.ndarray) -> np.ndarray:
    """A context's count; one more where no small count leaves mass to back off with."""
    return np.where(small.sum(1) > 0, total, total + 1).astype(np.float64)


def backoff_weight(total: np.ndarray, small: np.ndarray, taken: np.ndarray, discount: list[float]) -> np.ndarray:
    """What contexts leave over the lower-order mass that their seen words don't take; 1 for contexts that training hasn't."""
    r, divisor = np.arange(1, DISCOUNTED + 1), divisor_of(total, small)
    mass = (divisor - total + (small * r * (1 - np.array(discount)[1:])).sum(1)) / np.maximum(divisor, 1)
    return np.where(total > 0, mass / (1 - taken), 1.0)


def context_keys(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of contexts given as columns of word numbers, the nearest word first."""
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = (key ^ (c + np.uint64(1))) * MULTIPLIER
        key ^= key >> np.uint64(32)
    return np.maximum(key, np.uint64(1))


class Grams:
    """The distinct n-grams of a block, by (bucket, context, word): what is asked, and how answers meet the tokens."""

    def __init__(self, columns: list[np.ndarray], word: np.ndarray, context: np.ndarray, local: np.ndarray, times: np.ndarray, hot_limit: float, width: int):
        """``context`` and ``local`` number the contexts and words inside the block; the columns are the contexts' words in the whole corpus."""
        key = context_keys(columns)
        bucket = (key % np.uint64(width)).astype(np.int64)
        hot = np.flatnonzero(times > hot_limit)
        bucket[hot] = ((key[hot] + mixed(word[hot], 2)) % np.uint64(width)).astype(np.int64)
        n_contexts, n_words = int(context.max()) + 1, int(local.max()) + 1
        if width * n_contexts * n_words * len(word) < 1 << 63:  # the place goes along in the key: sorting is faster than sorting places
            self.order = np.sort(((bucket * n_contexts + context) * n_words + local) * len(word) + np.arange(len(word))) % len(word)
        elif width * n_contexts * n_words < 1 << 63:
            self.order = np.argsort((bucket * n_contexts + context) * n_words + local)
        else:
            self.order = np.lexsort((local, context, bucket))
        bucket, context = bucket[self.order], context[self.order]
        new = changes(bucket, context, local[self.order])
        self.start = np.flatnonzero(new)
        self.of_sorted = np.cumsum(new) - 1
        self.count = np.diff(np.append(self.start, len(bucket)))
        self.at = self.order[self.start]  # a token of each n-gram
        self.words, self.bucket = word[self.at], bucket[self.start]
        new = changes(self.bucket, context[self.start])
        self.context = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.at_context = self.at[self.first]
        self.columns, self.keys = [c[self.at_context] for c in columns], key[self.at_context]

    def of_token(self) -> np.ndarray:
        """The n-gram that ends at each token."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = self.of_sorted
        return out

    def buckets(self):
        """(bucket, slice of n-grams, slice of contexts, n-grams of each context)."""
        start, n = runs(self.bucket)
        for a, k in zip(start.tolist(), n.tolist()):
            c = slice(int(self.context[a]), int(self.context[a + k - 1]) + 1)
            yield int(self.bucket[a]), slice(a, a + k), c, np.diff(np.append(self.first[c], a + k)).astype(np.uint32)


def read_answers(path: str, part: int) -> dict[int, dict[int, bytes]]:
    """The answers of an order to a reading task: by block and bucket."""
    import pyarrow.parquet as pq
    from pyarrow import fs as arrow_fs

    found: dict[int, dict] = {}
    fs, folder = open_fs(f"{path}/part={part}")
    for info in fs.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                for r in pq.ParquetFile(f).read(columns=["dest", "block", "data"]).to_pylist():
                    found.setdefault(r["block"], {})[r["dest"]] = r["data"]
    return found


def checked(data: bytes, asked: np.ndarray) -> list[np.ndarray]:
    """An answer's arrays; an error where it answers another question than ``asked``."""
    check, *found = unpack(data)
    if check[0] != zlib.crc32(asked.tobytes()):
        raise RuntimeError("the texts were dealt out otherwise than at the reading before")
    return found


class Tokens:
    """The tokens of a block with what the finished orders say of them."""

    def __init__(self, hashes, lengths, vocabulary: dict[int, bytes], width: int, end_count: int, unigrams: Unigrams):
        words, _, index = distinct(hashes)
        numbers, counts = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
        for bucket, at in split_by((words % np.uint64(width)).astype(np.int64)):
            numbers[at], counts[at] = checked(vocabulary[bucket], words[at])
        ends = np.cumsum(lengths + 1) - 1
        n = len(hashes) + len(lengths)
        self.word, self.count = np.zeros(n, np.uint64), np.full(n, end_count, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        self.word[inner], self.count[inner] = numbers[index], counts[index]
        # words and the last order's n-grams, numbered inside the block; words in the order of their numbers, the end first
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(numbers)] = np.arange(1, len(words) + 1)
        self.local = np.zeros(n, np.int64)
        self.local[inner] = rank[index]
        self.gram = self.local
        self.doc = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.begins = ends - lengths  # the first token of each text
        self.unigram_count, self.end_count = self.count, end_count
        self.divisor = np.full(n, max(unigrams.total, 1), np.float64)
        self.p = unigrams.probability(self.count)

    def grams(self, order: int, hot_limit: float, width: int) -> Grams:
        """The n-grams of the next order; ``times`` is set to how often training has their contexts."""
        columns = [self._before(self.word, START)]
        for _ in range(order - 2):
            columns.append(self._before(columns[-1], START))
        self.times = self._before(self.count, self.end_count)
        return Grams(columns, self.word, self._before(self.gram + 1, 0), self.local, self.times, hot_limit, width)

    def _before(self, values: np.ndarray, first: int) -> np.ndarray:
        """What ``values`` say of the token before; ``first`` for a text's first token."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.begins] = first
        return out

    def advance(self, order: Order, grams: Grams, answers: dict[int, bytes]) -> None:
        """Takes in the answers of an order: counts, divisors and probabilities are its own from now on."""
        counts, small, taken = np.zeros(len(grams.words), np.int64), np.zeros((len(grams.first), DISCOUNTED)), np.zeros(len(grams.first))
        for bucket, g, c, _ in grams.buckets():
            r, s, t = checked(answers[bucket], grams.words[g])
            counts[g], small[c], taken[c] = r, s.reshape(-1, DISCOUNTED), t
        for i in np.flatnonzero(np.isin(grams.keys, np.array(list(order.hot), np.uint64))) if order.hot else ():
            small[i], taken[i] = order.hot[int(grams.keys[i])]
        total = self.times[grams.at_context].astype(np.float64)
        divisor, weight = divisor_of(total, small), backoff_weight(total, small, taken, order.discounts)
        seen = order.seen(counts, divisor[grams.context])
        gram = grams.of_token()
        self.count = counts[gram]
        context = grams.context[gram]
        self.divisor = divisor[context]
        self.p = np.where(self.count > 0, seen[gram], weight[context] * self.p)
        # numbered by the last word first: contexts of one nearest word then stand together, which packs best
        n = len(counts)
        rank = np.empty(n, np.int64)
        rank[np.sort(self.local[grams.at] * n + np.arange(n)) % n] = np.arange(n)
        self.gram = rank[gram]


def readings(batches, folds: int, held: int, characters: int, width: int, end_count: int, unigrams: Unigrams, limit: float, vocabulary: str, orders: list[Order]):
    """(part, number, ids, training flags, lengths, tokens, n-grams of the order after ``orders``) of each block."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    known = [read_answers(path, part) for path in (vocabulary, *(o.answers for o in orders))]

    def block(number, ids, train, hashes, lengths):
        answers = [k.pop(number, {}) for k in known]
        tokens = Tokens(hashes, lengths, answers[0], width, end_count, unigrams)
        for order, own in zip(orders, answers[1:]):
            tokens.advance(order, tokens.grams(order.n, limit, width), own)
        return part, number, ids, train, lengths, tokens, tokens.grams(len(orders) + 2, limit, width)

    return (block(*own) for own in blocks_of(batches, folds, held, characters))


def ask_order(width: int, read):
    """Blocks of texts to context buckets: the distinct n-grams of an order and their training counts."""

    def ask(part, number, _ids, train, _lengths, tokens, grams):
        counts = np.bincount(grams.of_sorted, weights=train[tokens.doc][grams.order], minlength=len(grams.words)).astype(np.uint32)
        rows = []
        for bucket, g, c, n in grams.buckets():
            context = [*(x[c] for x in grams.columns), tokens.times[grams.at_context[c]].astype(np.uint64), tokens.divisor[grams.at_context[c]].astype(np.uint64), n]
            # a context's lower-order divisor is the same for all its words
            rows.append((bucket, part, number, ASK, pack(*context, grams.words[g], tokens.count[grams.at[g]].astype(np.uint64), counts[g])))
        return frames(rows)

    def run(batches):
        yield from itertools.starmap(ask, read(batches))

    return giving_back(run)


class Bucket:
    """The n-grams of a bucket, from what blocks send of them: ``order`` - 1 context columns, times, lower divisor, n-grams of each context; word, lower count, training count of each n-gram.

    Contexts and n-grams are equal when their 64-bit names are.
    """

    def __init__(self, sent: list[list[np.ndarray]], order: int, lower: Order, hot_limit: float):
        k = order - 1
        # runs of one context: columns, times, lower divisor, length
        runs_ = [np.concatenate([s[i] for s in sent]) for i in range(k + 3)]
        word, count, training = (np.concatenate([s[k + 3 + i] for s in sent]) for i in range(3))
        names = context_keys(runs_[:k])
        _, start, self.gram = distinct(context_keys([np.repeat(names, runs_[k + 2]), word]))  # the number of each n-gram sent
        self.r = np.bincount(self.gram, weights=training, minlength=len(start)).astype(np.int64)
        self.keys, first, of_run = distinct(names)
        self.context = np.repeat(of_run, runs_[k + 2])[start]
        self.total = runs_[k][first].astype(np.float64)
        self.hot = self.total > hot_limit
        self.lower = lower.seen(count[start], runs_[k + 1][first][self.context])  # of seen n-grams
        self.small = np.empty((len(first), DISCOUNTED))
        for i in range(DISCOUNTED):
            self.small[:, i] = np.bincount(self.context, weights=self.r == i + 1, minlength=len(first))
        self.taken = np.bincount(self.context, weights=np.where(self.r > 0, self.lower, 0.0), minlength=len(first))

    def sums(self, dest: int) -> list[tuple]:
        """Rows for the driver: counts of counts, and the sums of hot contexts."""
        few = self.r[(self.r > 0) & (self.r <= DISCOUNTED + 1)]
        rows = [(dest, -1, -1, COUNTS, pack(np.bincount(few, minlength=DISCOUNTED + 2).astype(np.int64)))]
        if self.hot.any():
            rows.append((dest, -1, -1, HOT, pack(self.keys[self.hot], self.taken[self.hot], self.small[self.hot].ravel())))
        return rows


def gathered(batches, kinds: tuple[int, ...] = ()):
    """(rows of ``kinds``, the others by bucket as (part, block, data)) of a task."""
    passed, held = [], {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] in kinds:
                passed.append(tuple(r[c] for c in ("dest", "part", "block", "kind", "data")))
            else:
                held.setdefault(r["dest"], []).append((r["part"], r["block"], r["data"]))
    return passed, held


def answer_order(order: int, lower: Order, hot_limit: float):
    """Context buckets to reading tasks: training counts of the n-grams asked, small counts and taken mass of their contexts."""

    def answer(dest, own):
        sent = [unpack(data) for _, _, data in own]
        bucket, at = Bucket(sent, order, lower, hot_limit), 0
        for (part, block, _), s in zip(own, sent):
            words, n = s[order + 2], s[order + 1]
            gram = bucket.gram[at : at + len(words)]
            at += len(words)
            context = bucket.context[gram[np.cumsum(n) - n]]
            check = np.array([zlib.crc32(words.astype(np.uint64).tobytes())], np.uint32)
            yield frames([(dest, part, block, ANSWER, pack(check, bucket.r[gram].astype(np.uint64), bucket.small[context].ravel().astype(np.uint64), bucket.taken[context]))])
        yield frames(bucket.sums(dest))

    def run(batches):
        _, held = gathered(batches)
        while held:
            yield from answer(*held.popitem())

    return giving_back(run)


def deal_last(width: int, read, unigrams: Unigrams):
    """Blocks of texts to context buckets: n-grams of the last order with the documents that hold them; and what needs lower orders alone, by document."""

    def deal(part, number, ids, train, lengths, tokens, grams):
        base, known = unigrams.base(tokens.unigram_count), np.array([i is not None for i in ids], np.uint8)
        sums = [np.bincount(tokens.doc, weights=w, minlength=len(ids)) for w in (base, np.log10(tokens.p), tokens.unigram_count > 0)]
        rows = [(number % width, part, number, DOCUMENTS, pack(np.array([i or 0 for i in ids], np.int64), known, train.astype(np.uint8), (lengths + 1).astype(np.int64), *sums[:2], sums[2].astype(np.int64)))]
        flagged = (tokens.doc * 2 + train[tokens.doc]).astype(np.uint32)[grams.order]
        for bucket, g, c, n in grams.buckets():
            context = [*(x[c] for x in grams.columns), tokens.times[grams.at_context[c]].astype(np.uint64), tokens.divisor[grams.at_context[c]].astype(np.uint64), n]
            held = slice(int(grams.start[g.start]), int(grams.start[g.stop - 1] + grams.count[g.stop - 1]))
            rows.append((bucket, part, number, OCCURRENCES, pack(*context, grams.words[g], tokens.count[grams.at[g]].astype(np.uint64), grams.count[g].astype(np.uint32), flagged[held])))
        return frames(rows)

    def run(batches):
        yield from itertools.starmap(deal, read(batches))

    return giving_back(run)


def count_last(order: int, lower: Order, hot_limit: float):
    """Context buckets: sums by document, contexts that have unseen n-grams, counts of counts."""

    def count(dest, own):
        sent = [unpack(data) for _, _, data in own]
        own[:] = [(part, block) for part, block, _ in own]
        for s in sent:  # n-grams with the documents that hold them: the training ones count
            *_, times, flagged = s
            s[-2:] = [np.add.reduceat((flagged & 1).astype(np.uint32), np.cumsum(times, dtype=np.int64) - times), times, flagged]
        b, at = Bucket(sent, order, lower, hot_limit), 0
        sent = [s[order + 5 :] for s in sent]
        divisor = divisor_of(b.total, b.small)
        value = np.log10(np.maximum(b.r, 1)) - np.where(b.hot, 0.0, np.log10(np.maximum(divisor, 1)))[b.context] - np.log10(np.where(b.r > 0, b.lower, 1.0))
        for (part, block), (times, flagged) in zip(own, sent):
            gram = np.repeat(b.gram[at : at + len(times)], times)
            at += len(times)
            doc, r, context = (flagged >> 1).astype(np.int64), b.r[gram], b.context[gram]
            n, seen = int(doc.max()) + 1, r > 0
            few = np.flatnonzero(seen & (r <= DISCOUNTED))
            classes = np.bincount((r[few] - 1) * n + doc[few], minlength=DISCOUNTED * n).astype(np.uint32)
            packed = [np.bincount(doc, weights=np.where(seen, value[gram], 0.0), minlength=n), classes]
            # contexts that training has; without one the lower order stands
            for rows in (np.flatnonzero(~seen & (b.total[context] > 0)), np.flatnonzero(seen & b.hot[context]) if b.hot.any() else few[:0]):
                rows = rows[np.argsort(context[rows])]
                at_run, times = runs(context[rows])
                which = context[rows][at_run]
                packed += [np.where(b.hot[which], b.keys[which], np.uint64(0)), b.total[which], b.taken[which], b.small[which].ravel().astype(np.uint64), times.astype(np.uint32), doc[rows].astype(np.uint32)]
            yield frames([(dest, part, block, CONTEXTS, pack(*packed))])
        yield frames(b.sums(dest))

    def run(batches):
        passed, held = gathered(batches, (DOCUMENTS,))
        if passed:
            yield frames(passed)
        del passed
        while held:
            yield from count(*held.popitem())

    return giving_back(run)


def hot_rows(batches):
    """Packed sums of hot contexts to rows."""
    import pyarrow as pa

    for batch in batches:
        for data in batch.column(0).to_pylist():
            name, taken, small = unpack(data)
            values = np.column_stack([taken, small.reshape(-1, DISCOUNTED)])
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(list(values), pa.list_(pa.float64()))], ["name", "value"])


def sums_of(tables: DataFrame) -> tuple[list[float], dict[int, tuple]]:
    """(discounts, hot contexts' small counts and taken mass) of an order, from its buckets' sums."""
    counts = add_arrays([r["data"] for r in tables.filter(f"kind = {COUNTS}").select("data").collect()], DISCOUNTED + 2)
    parts = tables.filter(f"kind = {HOT}").select("data").mapInArrow(hot_rows, "name long, value array<double>")
    sums = parts.groupBy("name").agg(*[F.sum(F.col("value")[i]).alias(f"v{i}") for i in range(DISCOUNTED + 1)]).collect()  # fewer than 1 / HOT_SHARE
    return discounts(counts), {int(np.int64(r["name"]).astype(np.uint64)): (np.array([r[f"v{i}"] for i in range(1, DISCOUNTED + 1)]), r["v0"]) for r in sums}


def add_up(discount: list[float], n_train: int, hot: dict[int, tuple]):
    """All rows of a block of texts to a score for each of its documents. ``hot``: (small counts, taken mass) of hot contexts."""

    def run(key, table):
        import pyarrow as pa

        head, scores = None, []
        for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist()):
            if kind == DOCUMENTS:
                head = unpack(data)
                continue
            value, classes, *rest = unpack(data)
            value = value + np.log10(np.array(discount)[1:]) @ classes.reshape(DISCOUNTED, len(value))
            for part, (name, total, taken, small, n, docs) in enumerate((rest[:6], rest[6:])):
                small, taken = small.reshape(-1, DISCOUNTED).astype(np.float64), taken.copy()
                for i in np.flatnonzero(name):
                    small[i], taken[i] = hot[int(name[i])]
                each = np.log10(backoff_weight(total, small, taken, discount)) if part == 0 else -np.log10(divisor_of(total, small))
                value = value + np.bincount(docs, weights=np.repeat(each, n), minlength=len(value))[: len(value)]
            scores.append(value)
        ids, known, train, n_tokens, base, lower, n_known = head
        total = lower.copy()
        for s in scores:
            total[: len(s)] += s
        columns = [pa.array(ids, mask=known == 0), pa.array(train == 0), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(ids), n_train, np.int64)), pa.array(base), pa.array(total)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, order: int = 3, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text", hot_share: float = HOT_SHARE, block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """Trains on the documents whose crc32(id as text) mod ``folds`` isn't ``held``, and scores all.

    Words are what stands between ASCII white space, A-Z in lower case; each text has
    an end token. Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-half unigrams), score (log10 of the probability under the model of n-grams up to
    ``order``, 2 at least).

    A context with no count up to ``DISCOUNTED`` leaves no mass of its own; it counts one
    more, which is its to back off with. Null and empty texts are the end token alone.
    Very long texts are scored whole. Null ids hash as the empty string and stay null.
    Repeated rows are scored, and trained on, each. An empty table gives no rows. Other
    columns are ignored.

    The input is read ``order`` times, and all readings must deal it out alike, as scans of
    files do; answers carry a checksum of their question, so a difference stops the job.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    checksum = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    n_bytes, n_train_docs = rows.agg(F.sum(F.octet_length("text")), F.count(F.when(checksum % folds != held, 1))).first()
    width = max(partitions(spark), -(-(n_bytes or 0) // BUCKET_BYTES))
    n_parts = max(1, rows.rdd.getNumPartitions())

    def answered(asked, answer) -> str:
        path = new_path(spark, "katz-order")
        asked.repartitionById(width, F.col("dest")).mapInArrow(answer, FRAMES).repartitionById(n_parts + 1, F.col("part") + 1).write.partitionBy("part").parquet(path)
        return path

    vocabulary = answered(rows.mapInArrow(ask_vocabulary(width, folds, held, block_characters), FRAMES), answer_vocabulary(width))
    found = spark.read.schema(FRAMES).parquet(vocabulary).filter(f"part = -1 and kind = {COUNTS}").select("data").collect()
    v, n, *counts = add_arrays([r["data"] for r in found], 2 + DISCOUNTED + 2)
    counts[0] = 0
    if n_train_docs:  # the end token is a word of training
        v, n = v + 1, n + n_train_docs
        if n_train_docs <= DISCOUNTED + 1:
            counts[n_train_docs] += 1
    unigrams = Unigrams(n, v, counts)
    orders: list[Order] = []
    lower = Order(1, unigrams.discounts, vocabulary)

    def reader():
        before = list(orders)
        return lambda batches: readings(batches, folds, held, block_characters, width, n_train_docs, unigrams, hot_share * n, vocabulary, before)

    for k in range(2, order):
        path = answered(rows.mapInArrow(ask_order(width, reader()), FRAMES), answer_order(k, lower, hot_share * n))
        lower = Order(k, *_placed(path, sums_of(spark.read.schema(FRAMES).parquet(path).filter("part = -1"))))
        orders.append(lower)
    dealt = rows.mapInArrow(deal_last(width, reader(), unigrams), FRAMES).repartitionById(width, F.col("dest"))
    tables = written(dealt.mapInArrow(count_last(order, lower, hot_share * n), FRAMES), "katz-last")
    discount, hot = sums_of(tables)
    kept = tables.filter(f"kind in ({DOCUMENTS}, {CONTEXTS})").select("part", "block", "kind", "data")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return kept.groupBy("part", "block").applyInArrow(add_up(discount, n, hot), schema)


def _placed(path: str, sums: tuple) -> tuple:
    return sums[0], path, sums[1]


def add_arrays(packed: list[bytes], size: int) -> list[int]:
    """The sum of arrays of ``size`` counts, one for each bucket."""
    total = np.zeros(size, np.int64)
    for p in packed:
        total += unpack(p)[0]
    return [int(x) for x in total]
