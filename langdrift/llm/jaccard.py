"""Exact n-gram Jaccard join of whole texts through a token-group matrix.

1. Texts become sets of 64-bit shingle tokens. Equal sets are one class, named by a
   63-bit digest; all that follows works on classes, so copies cost one row each.
2. A class can only be linked when at least the threshold's share of its tokens also
   occurs in other classes. Tokens are counted in packed blocks, one row for each
   block of documents and token bucket; all other classes are done.
3. The others are partitioned into groups of similar classes: for a few seeds, classes
   with the same minimum hash are compared in bounded blocks. Pairs that reach the
   threshold join a cluster, pairs of some likeness a family; families are cut into
   groups of bounded size that keep clusters together. A cluster too large for that is a
   group of its own, kept in several parts.
4. Members of one group that no cluster joins yet are compared inside it.
5. Token-group matrix: for each token the groups whose token union holds it. Only tokens
   of two groups can link classes of different groups. A class with fewer of them than
   the threshold needs is done; the others ask for the groups that hold one of the rarest
   tokens that any linked class must share. A pair of groups that ask for one another is
   a candidate: there a class's overlap with the union of each part bounds its overlap
   with every member, and members are only opened for classes that reach the threshold.
6. Verified links join clusters to components.

Steps 2, 4 and 5 are exact, step 3 only decides which classes are in a group; so no
link is lost, whatever the minimum hashes do.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, join_small_values, partitions, unused_name, written
from .token_ids import by_size

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BATCH_CHARACTERS = 3_000_000
#: Text bytes for each partition of the token and class buckets, which tasks hold whole.
BUCKET_BYTES = 64 << 20
#: Classes and tokens of a block or part, which a task holds whole.
PART_CLASSES, PART_TOKENS = 512, 1_000_000
#: Percentage of Jaccard similarity from which classes are of one family.
FAMILY = 30


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of 64-bit integers."""
    h = h.astype(np.uint64) + np.uint64((seed * 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``size``-word shingles.

    Words are what stands between ASCII white space, with A-Z in lower case; a text
    with fewer words is one shingle, without words it has none.
    """
    import pandas as pd

    words = [(t or "").encode().lower().split() for t in texts]
    counts = [len(w) for w in words]
    flat = np.array([w for ws in words for w in ws], dtype=object)
    hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for j in range(size):
        rolled = rolled * MULTIPLIER + hashes[j : j + len(rolled)]
    rolled = mixed(rolled)
    out, at = [], 0
    for n in counts:
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            whole = np.zeros(1, np.uint64)
            for h in hashes[at : at + n]:
                whole = whole * MULTIPLIER + h
            out.append(mixed(whole, 1))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def class_of(tokens: np.ndarray) -> int:
    """The name of the class of documents with this set: 63 bits of a digest."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little") >> 1


def needed(n, percent: int):
    """The least intersection with which a set of ``n`` can be linked."""
    return -(-percent * n // 100)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first positions, lengths) of the runs of equal values."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return first, np.diff(np.append(first, len(values)))


def split_by(keys: np.ndarray):
    """(key, positions) for each distinct key, positions in order."""
    order = np.argsort(keys, kind="stable")
    first, n = runs(keys[order])
    for f, k in zip(first.tolist(), n.tolist()):
        yield int(keys[order[f]]), order[f : f + k]


#: A row for partition ``dest``, which passes it on to partition ``then`` where that is set.
BLOCKS = "dest int, kind int, then int, owners binary, counts binary, tokens binary, marks binary"
POSTINGS, KNOWN, SHARED, MEMBERS, SIZES = range(5)


class Blocks:
    """Rows of ``BLOCKS``: postings as owners, the number of tokens of each, and the tokens."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, dest: int, kind: int, then: int = -1, owners=b"", counts=b"", tokens=b"", marks=b"") -> None:
        self.rows.append((dest, kind, then, owners, counts, tokens, marks))

    def postings(self, dest: int, kind: int, then: int, owners: np.ndarray, tokens: np.ndarray) -> None:
        """``owners`` in order, one for each token."""
        first, n = runs(owners)
        self.add(dest, kind, then, owners[first].astype("<i8").tobytes(), n.astype("<u4").tobytes(), tokens.astype("<u8").tobytes())

    def batch(self):
        import pyarrow as pa

        types = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        names = ["dest", "kind", "then", "owners", "counts", "tokens", "marks"]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), types)], names)
        self.rows = []
        return out


def repeated(owners: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(owners, "<i8"), np.frombuffer(counts, "<u4"))


def to_blocks(size: int, width: int):
    """Documents to blocks: their tokens to token buckets, sizes and members to class buckets.

    The tokens of a class go out once in each task.
    """

    def emit(blocks: Blocks, ids: list, texts: list, spread: int, seen: set) -> None:
        sets = shingle_sets(texts, size)
        classes = np.array([class_of(s) if len(s) else -1 for s in sets], np.int64)
        sizes = np.array([len(s) for s in sets], np.int64)
        known = np.array([i is not None for i in ids], np.uint8)
        blocks.add(spread, MEMBERS, -1, classes.tobytes(), sizes.astype("<i8").tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), known.tobytes())
        names, first = np.unique(classes, return_index=True)
        first = np.array([i for c, i in zip(names.tolist(), first.tolist()) if c >= 0 and c not in seen], int)
        seen.update(names.tolist())
        if not len(first):
            return
        owners = np.repeat(classes[first], sizes[first])
        tokens = np.concatenate([sets[i] for i in first])
        for dest, at in split_by(classes[first] % width):
            blocks.postings(spread, SIZES, dest, classes[first][at], sizes[first][at])
        # tokens of several classes of this block are shared already: the bucket needs them once
        order = np.lexsort((owners, tokens))
        start, n = runs(tokens[order])
        here = np.zeros(len(tokens), bool)
        here[order] = np.repeat(n > 1, n)
        bucket = (tokens % np.uint64(width)).astype(np.int64)
        alone = np.flatnonzero(~here)
        for b, at in split_by(bucket[alone]):
            blocks.postings(b, POSTINGS, -1, owners[alone[at]], tokens[alone[at]])
        several = order[start[n > 1]]
        for b, at in split_by(bucket[several]):
            blocks.add(b, KNOWN, -1, b"", b"", tokens[several[at]].astype("<u8").tobytes())
        both = np.flatnonzero(here)
        for dest, at in split_by(owners[both] % width):
            blocks.postings(spread, SHARED, dest, owners[both[at]], tokens[both[at]])

    def run(batches):
        from pyspark import TaskContext

        blocks, number, seen = Blocks(), TaskContext.get().partitionId(), set()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for cut in by_size(texts, BATCH_CHARACTERS):
                number += 1
                emit(blocks, ids[cut], texts[cut], number % width, seen)
                yield blocks.batch()

    return giving_back(run)


def count_tokens(width: int):
    """Token buckets to class buckets: keeps the postings of tokens that two classes have."""

    def run(batches):
        out = Blocks()
        owners, tokens, known = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == POSTINGS:
                    owners.append(repeated(r["owners"], r["counts"]))
                    tokens.append(np.frombuffer(r["tokens"], "<u8"))
                elif r["kind"] == KNOWN:
                    known.append(np.frombuffer(r["tokens"], "<u8"))
                else:
                    out.add(r["dest"] if r["then"] < 0 else r["then"], r["kind"], -1, r["owners"], r["counts"], r["tokens"], r["marks"])
            if out.rows:
                yield out.batch()
        owner, once, seen = np.concatenate(owners), np.concatenate(tokens), np.unique(np.concatenate(known))
        del owners, tokens, known
        order = np.lexsort((owner, once))
        start, n = runs(once[order])
        # two classes: the first and the last owner of a token differ
        several = owner[order[start]] != owner[order[start + n - 1]] if len(start) else np.zeros(0, bool)
        several |= np.isin(once[order[start]], seen)
        keep = order[np.repeat(several, n)]
        owner, found = owner[keep], once[keep]
        by_owner = np.lexsort((found, owner))
        owner, found = owner[by_owner], found[by_owner]
        for dest, at in split_by(owner % width):
            out.postings(dest, SHARED, -1, owner[at], found[at])
        if out.rows:
            yield out.batch()

    return giving_back(run)


CLASSES = "class long, n long, tokens array<bigint>, doc_id long"


def gather_classes(percent: int):
    """Class buckets to rows: a row for each member, and one with tokens for each class that may have a link."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("doc_id", pa.int64())])
        owners, tokens, names, sizes = [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == MEMBERS:
                    known = np.frombuffer(r["marks"], np.uint8).astype(bool)
                    columns = [pa.array(np.frombuffer(r["owners"], "<i8")), pa.array(np.frombuffer(r["counts"], "<i8")), pa.nulls(len(known), pa.list_(pa.int64())), pa.array(np.frombuffer(r["tokens"], "<i8"), mask=~known)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                elif r["kind"] == SIZES:
                    names.append(np.frombuffer(r["owners"], "<i8"))
                    sizes.append(np.frombuffer(r["tokens"], "<u8").astype(np.int64))
                else:
                    owners.append(repeated(r["owners"], r["counts"]))
                    tokens.append(np.frombuffer(r["tokens"], "<u8").astype(np.int64))
        if owners:
            owner, token = np.concatenate(owners), np.concatenate(tokens)
            del owners, tokens
            order = np.lexsort((token, owner))
            owner, token = owner[order], token[order]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])])
            owner, token = owner[new], token[new]
            name, at = np.unique(np.concatenate(names), return_index=True)
            size = np.concatenate(sizes)[at]
            start, n = runs(owner)
            n_of = size[np.searchsorted(name, owner[start])]
            rows = [(int(owner[s]), int(z), token[s : s + k]) for s, k, z in zip(start.tolist(), n.tolist(), n_of.tolist()) if k >= needed(z, percent)]
            for a in range(0, len(rows), 2000):
                part = rows[a : a + 2000]
                columns = [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.list_(pa.int64())), pa.nulls(len(part), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return giving_back(run)


def overlaps(asked: list[np.ndarray], members: list[np.ndarray], at_once: int = 4_000_000) -> np.ndarray:
    """The size of the intersection of each of ``asked`` with each of ``members``, counted over postings of ``members``."""
    tokens = np.concatenate([*members, np.zeros(0, np.int64)])
    order = np.argsort(tokens, kind="stable")
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])[order]
    start, held = runs(tokens[order])
    names = tokens[order][start]
    own, who = np.concatenate([*asked, np.zeros(0, np.int64)]), np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    at = np.searchsorted(names, own).clip(max=max(0, len(names) - 1))
    hit = names[at] == own if len(names) else np.zeros(len(own), bool)
    at, who = at[hit], who[hit]
    out, total = np.zeros(len(asked) * len(members), np.int64), np.cumsum(held[at])
    for a, b in by_weight(total, at_once):
        n = held[at[a:b]]
        place = np.repeat(start[at[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out += np.bincount(np.repeat(who[a:b], n) * len(members) + owner[place], minlength=len(out))
    return out.reshape(len(asked), len(members))


def by_weight(total: np.ndarray, limit: int):
    """(begin, end) of stretches whose weight is ``limit`` or just above, from the running sums of weights."""
    at, done = 0, 0
    while at < len(total):
        end = min(len(total), int(np.searchsorted(total, done + limit)) + 1)
        yield at, end
        at, done = end, int(total[end - 1])


def similar(common: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs have a Jaccard similarity of ``percent`` / 100."""
    return (common > 0) & (100 * common >= percent * (n_a[:, None] + n_b[None] - common))


def stars(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the first member of each component of a symmetric relation to its others."""
    left, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        if left[i]:
            left[i], front = False, [i]
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & left)
                left[front] = False
                out += [(i, int(j)) for j in front]
    return out


def sorted_groups(batches, keys: tuple[str, ...], lists: tuple[str, ...] = ("tokens",)):
    """Columns of the rows of each key, from Arrow batches that are sorted by it; ``lists`` are columns of arrays.

    Columns other than ``lists`` have no nulls. What a group of a few rows costs is little more than its slices, where a frame for each group costs milliseconds.
    """
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        found = {}
        for name, column in zip(batch.schema.names, batch.columns):
            if name in lists:
                flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                found[name] = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            else:
                found[name] = column.to_numpy(zero_copy_only=False)
        start = np.flatnonzero(changes(*(found[k] for k in keys)))
        for a, b in zip(start.tolist(), [*start[1:].tolist(), batch.num_rows]):
            piece = {name: c[a:b] for name, c in found.items()}
            if held and any(held[-1][k][0] != piece[k][0] for k in keys):
                yield joined_pieces(held, lists)
                held = []
            held.append(piece)
    if held:
        yield joined_pieces(held, lists)


def joined_pieces(pieces: list[dict], lists: tuple[str, ...]) -> dict:
    if len(pieces) == 1:
        return pieces[0]
    return {name: [x for p in pieces for x in p[name]] if name in lists else np.concatenate([p[name] for p in pieces]) for name in pieces[0]}


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def sets_of(pdf) -> tuple[list[np.ndarray], np.ndarray]:
    """(token arrays, set sizes) of rows."""
    return [np.asarray(t, np.int64) for t in pdf["tokens"]], pdf["n"].to_numpy()


def pieces(classes: Column, tokens: Column) -> Column:
    """In how many parts so many classes with so many tokens are held."""
    return F.ceil(F.greatest(classes / PART_CLASSES, tokens / PART_TOKENS, F.lit(1)))


def similar_pairs(classes: DataFrame, percent: int, seeds: int) -> DataFrame:
    """Edges a, b, linked between classes with an equal minimum hash: linked ones, and others of a family.

    Classes of a hash that needs several blocks are dealt out twice, so that what its
    blocks hold meets in one another's members.
    """
    hashes = F.array(*[F.struct(F.lit(s).alias("seed"), F.array_min(F.transform("tokens", _seeded(s))).alias("least")) for s in range(seeds)])
    size = F.size("tokens").alias("size")
    keyed = written(classes.select("class", size, F.explode(hashes).alias("key")).select("class", "size", F.xxhash64("key.seed", "key.least").alias("key")), "minimum-hashes")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("all")).filter("copies > 1")
    keyed = join_small_values(keyed, counts, "key", "copies", max(1, keyed.count())).filter(F.col("copies").isNotNull())
    blocks = pieces(2 * F.col("copies"), F.col("all"))
    keyed = keyed.withColumn("deal", F.explode(F.when(blocks > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("class", "deal"), blocks))
    held = classes.join(keyed.select("class", "key", "deal", "part"), "class")

    by = ("key", "deal", "part")

    def link(batches):
        import pyarrow as pa

        found: list[tuple] = []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "linked"])

        for g in sorted_groups(batches, by):
            names, n, common = g["class"].tolist(), g["n"], overlaps(g["tokens"], g["tokens"])
            found += [(names[i], names[j], k) for k, limit in ((True, percent), (False, FAMILY)) for i, j in stars(similar(common, n, n, limit))]
            if len(found) > 20_000:
                yield made()
                found = []
        yield made()

    dealt = held.select(*by, "class", "n", "tokens").repartition(*by).sortWithinPartitions(*by, "class")
    return written(dealt.mapInArrow(giving_back(link), "a long, b long, linked boolean").distinct(), "similar-pairs")


def _seeded(seed: int):
    return lambda t: F.xxhash64(t, F.lit(seed))


def group_classes(classes: DataFrame, percent: int, seeds: int) -> DataFrame:
    """``classes`` with cluster (its least class), column (its group) and part (what a task holds of the group)."""
    pairs = similar_pairs(classes, percent, seeds)
    names = classes.select("class", F.size("tokens").alias("size"))
    for column, edges in (("cluster", pairs.filter("linked")), ("family", pairs)):
        roots = components(edges).select(F.col("node").alias("class"), F.col("root").alias(column))
        names = names.join(roots, "class", "left").withColumn(column, F.coalesce(column, "class"))
    names = written(names, "families")
    total = max(1, names.count())
    for column in ("cluster", "family"):
        sums = names.groupBy(column).agg(F.count(F.lit(1)).alias(f"{column}_classes"), F.sum("size").alias(f"{column}_tokens"))
        names = join_small_values(names, sums, column, f"{column}_classes", total)
    own = pieces(F.col("cluster_classes"), F.col("cluster_tokens"))
    shared = pieces(F.col("family_classes"), F.col("family_tokens"))
    group = F.when(own > 1, F.xxhash64(F.lit("cluster"), "cluster")).otherwise(F.xxhash64(F.lit("family"), "family", F.pmod(F.xxhash64("cluster"), shared)))
    names = names.withColumn("column", group).withColumn("part", F.xxhash64("column", F.pmod(F.xxhash64("class"), own)))
    return written(classes.join(names.select("class", "cluster", "column", "part"), "class"), "groups")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, root (the least node).

    Every round takes the least root among neighbours and then the root's root, so long
    chains halve; roots only fall, and the rounds end when none does.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        closer = roots.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = closer.select(F.col("node").alias("at"), F.col("root").alias("jump"))
        new = written(closer.join(jump, F.col("root") == F.col("at"), "left").select("node", "old", F.coalesce(F.least("root", "jump"), "root").alias("root")), "roots")
        roots = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return roots


LINKS = "a long, b long"


def links_inside(groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between clusters of one part, a, b; and the token union of each part: column, part, tokens."""

    def run(batches):
        import pyarrow as pa

        rows: list[tuple] = []
        size = 0

        def made():
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["a", "b", "column", "part", "tokens"])

        for g in sorted_groups(batches, ("part",)):
            sets, n, clusters = g["tokens"], g["n"], g["cluster"]
            if (clusters != clusters[0]).any():
                found = [(int(clusters[i]), int(clusters[j])) for i, j in stars(similar(overlaps(sets, sets), n, n, percent)) if clusters[i] != clusters[j]]
                rows += [(a, b, None, None, None) for a, b in dict.fromkeys(found)]
            rows.append((None, None, int(g["column"][0]), int(g["part"][0]), np.unique(np.concatenate(sets))))
            size += len(rows[-1][4])
            if size > PART_TOKENS:
                yield made()
                rows, size = [], 0
        if rows:
            yield made()

    dealt = groups.select("part", "column", "cluster", "class", "n", "tokens").repartition("part").sortWithinPartitions("part", "class")
    done = written(dealt.mapInArrow(giving_back(run), LINKS + ", column long, part long, tokens array<long>"), "unions")
    return done.filter("tokens is null").select("a", "b"), done.filter("tokens is not null").select("column", "part", "tokens")


def links_between(groups: DataFrame, unions: DataFrame, percent: int) -> DataFrame | None:
    """Links between clusters of different groups, a, b; none where no class has tokens enough of other groups."""
    matrix = unions.select("column", "part", F.explode("tokens").alias("token"))
    holders = matrix.groupBy("token").agg(F.min("column").alias("first"), F.max("column").alias("last"), F.count(F.lit(1)).alias("held"))
    holders = holders.filter("first <> last").select("token", "held")
    crossing = join_small_values(matrix, holders, "token", "held", max(1, matrix.count())).filter("held is not null")
    crossing = crossing.groupBy("part").agg(F.collect_list(F.struct("held", "token")).alias("c"))  # of a part's union, which is bounded
    none = F.lit(None).cast("array<long>").alias("held")
    members = groups.select("part", F.lit(1).alias("side"), "class", "n", "cluster", "column", "tokens", none)
    both = members.unionByName(crossing.select("part", F.lit(0).alias("side"), *[F.lit(0).cast("long").alias(c) for c in ("class", "n", "cluster", "column")], F.col("c.token").alias("tokens"), F.col("c.held").cast("array<long>").alias("held")))

    def keep(batches):
        import pyarrow as pa

        names = ["class", "n", "tokens", "cluster", "column", "part"]
        types = dict.fromkeys(names, pa.int64()) | {"tokens": pa.list_(pa.int64())}
        for g in sorted_groups(batches, ("part",), ("tokens", "held")):
            if g["side"][0]:
                continue  # no token of the part is in another group
            order = np.argsort(g["tokens"][0])
            token, held = g["tokens"][0][order], g["held"][0][order]
            out = []
            for i in range(1, len(g["side"])):
                own = g["tokens"][i]
                at = np.searchsorted(token, own).clip(max=len(token) - 1)
                at = at[token[at] == own]
                if len(at) >= needed(int(g["n"][i]), percent):
                    out.append({c: int(g[c][i]) for c in names if c != "tokens"} | {"tokens": token[at[np.lexsort((token[at], held[at]))]]})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in types.items()], names)

    left = both.repartition("part").sortWithinPartitions("part", "side", "class").mapInArrow(giving_back(keep), "class long, n long, tokens array<long>, cluster long, column long, part long")
    left = written(left, "crossing-classes")
    if left.isEmpty():
        return None
    rarest = F.slice("tokens", 1, (F.size("tokens") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    asks = left.select(F.col("column").alias("a"), F.explode(rarest).alias("token")).distinct()
    holds = left.select(F.col("column").alias("b"), F.explode("tokens").alias("token")).distinct()
    asked = asks.join(holds, "token").filter("a <> b").select("a", "b").distinct()
    mutual = asked.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).count().filter("count = 2")
    # the group with fewer classes asks
    sizes = left.groupBy("column").agg(F.count(F.lit(1)).alias("classes"))
    both = mutual.join(sizes.select(F.col("column").alias("a"), F.col("classes").alias("n_a")), "a").join(sizes.select(F.col("column").alias("b"), F.col("classes").alias("n_b")), "b")
    fewer = F.col("n_a") <= F.col("n_b")
    pairs = both.select(F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("column"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("target"))
    parts = left.select(F.col("column").alias("target"), F.col("part").alias("asked")).distinct()
    pairs = written(pairs.join(parts, "target"), "candidate-groups")
    queries = left.select("class", "n", "tokens", "cluster", "column").join(pairs.select("column", "asked"), "column").select("class", "n", "tokens", "cluster", F.col("asked").alias("part"))
    # a part that many classes ask for is opened by several tasks
    load = pairs.join(sizes, "column").groupBy(F.col("asked").alias("part")).agg(F.ceil(F.sum("classes") / (8 * PART_CLASSES)).cast("int").alias("tasks"))
    queries = queries.join(load, "part").withColumn("task", F.pmod(F.xxhash64("class"), F.col("tasks")))
    members = left.join(load, "part").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks").cast("long") - 1)))

    def open_group(key, members, queries):
        import pandas as pd

        found = set()
        if len(members) and len(queries):
            sets, n = sets_of(members)
            union, cluster = np.unique(np.concatenate(sets)), members["cluster"].to_numpy()
            asked, size = sets_of(queries)
            bound = np.array([np.isin(s, union).sum() for s in asked]) >= needed(size, percent)
            open_for = np.flatnonzero(bound)
            own = queries["cluster"].to_numpy()
            for a in range(0, len(open_for), PART_CLASSES):
                some = open_for[a : a + PART_CLASSES]
                near = similar(overlaps([asked[i] for i in some], sets), size[some], n, percent)
                found |= {(int(own[some[i]]), int(cluster[j])) for i, j in zip(*np.nonzero(near))}
        return pd.DataFrame([p for p in found if p[0] != p[1]], columns=["a", "b"])

    members, queries = (df.select(*[F.col(c).alias(c) for c in ("class", "n", "tokens", "cluster", "part", "task")]) for df in (members, queries))
    return members.groupBy("part", "task").cogroup(queries.groupBy("part", "task")).applyInPandas(open_group, LINKS)


def link_documents(docs: DataFrame, shingle: int = 5, percent: int = 75, seeds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Result, a row for each row of ``docs``: doc_id, n_shingles (size of the set),
    component_id (smallest doc_id that links reach, itself included).

    Null and empty texts and texts of white space have no shingles and no links.
    Rows that repeat an id are rows of their own. Null ids are linked as others are,
    but name a component only where it has no other id (then component_id is null).
    An empty table gives no rows. Very long texts are one set each, which a task holds
    whole. Other columns, whatever their names, are ignored.

    Shingles are equal when their 64-bit hashes are, sets when their 63-bit digests are.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(partitions(spark), -(-n_bytes // BUCKET_BYTES))
    blocks = rows.mapInArrow(to_blocks(shingle, width), BLOCKS).repartitionById(width, F.col("dest"))
    counted = blocks.mapInArrow(count_tokens(width), BLOCKS).repartitionById(width, F.col("dest"))
    found = written(counted.mapInArrow(gather_classes(percent), CLASSES), "classes")
    members = found.filter(F.col("tokens").isNull()).select("doc_id", "n", "class")
    classes = found.filter(F.col("tokens").isNotNull()).select("class", "n", "tokens")
    groups = group_classes(classes, percent, seeds)
    edges, unions = links_inside(groups, percent)
    across = links_between(groups, unions, percent)
    edges = edges if across is None else written(edges.unionByName(across).distinct(), "links")
    clusters = groups.select("class", "cluster")
    if not edges.isEmpty():
        roots = components(edges)
        clusters = clusters.join(roots, F.col("cluster") == F.col("node"), "left").select("class", F.coalesce("root", "cluster").alias("cluster"))
    # the least document of each class, then of each component of classes, and back to the members
    per_class = members.filter("class >= 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = per_class.join(clusters, "class", "left").withColumn("cluster", F.coalesce("cluster", "class"))
    per_cluster = named.groupBy("cluster").agg(F.min("least").alias("component_id"), F.sum("copies").alias("total"))
    named = written(named.join(per_cluster, "cluster").filter("total > 1").select("class", "copies", "component_id"), "class-components")
    joined = join_small_values(members, named, "class", "copies", max(1, members.count()))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those that are not their component's ``component_id``; rows with a null id stay."""
    name = unused_name(docs, "_dropped")
    dropped = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped.hint("shuffle_hash"), F.col(id_col) == F.col(name), "left_anti")
