"""How quality filters interact: an audit by keyed streaming state that retracts what it said too early."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .common import new_path

#: The filters; filter number i has bit 1 << i of a document's mask, set where it fails.
FILTERS = "ABCDE"
LAST = len(FILTERS) - 1
COPY = 1 << LAST
#: A passing candidate or a settled count: bucket, text, doc_id, part, mask, n, good, toxic.
CANDIDATES = "bucket long, text string, doc_id long, part string, mask int, n long, good long, toxic long"
COUNTERS = "part string, mask int, n long, good long, toxic long"


def own_mask(text: Column, words: Column) -> Column:
    """Bits of the filters that look at a text alone, A to D."""
    n, points = F.size(words), F.length(text)
    fails = [
        n < 50,
        100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * points.cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def fold_texts(n_buckets: int, texts: int = 50_000):
    """Of each text that a task has seen, only the rows with the least id can pass: they go to the text's state.

    All others are counted as copies here, whatever other tasks hold, and travel beside the
    state in buckets below 0. After ``texts`` different texts what is held goes out.
    """

    def fold(frames):
        import pandas as pd

        columns = [c.split()[0] for c in CANDIDATES.split(", ")]
        least: dict[str, tuple[int, dict]] = {}
        settled: dict[tuple, list] = {}

        def add(where: dict, key: tuple, more) -> None:
            have = where.setdefault(key, [0, 0, 0])
            for i, x in enumerate(more):
                have[i] += x

        def out():
            rows = [(int(text[:15], 16) % n_buckets, text, doc, part, mask, *c) for text, (doc, held) in least.items() for (part, mask), c in held.items()]
            rows += [(-1 - i % 64, "", 0, part, mask, *c) for i, ((part, mask), c) in enumerate(settled.items())]
            least.clear()
            settled.clear()
            return pd.DataFrame(rows, columns=columns)

        for frame in frames:
            for text, doc, part, mask, good, toxic in zip(frame["text"], frame["doc_id"].astype(object), frame["part"], frame["mask"].tolist(), frame["good"].tolist(), frame["toxic"].tolist()):
                one = (1, good, toxic)
                if doc is None or doc != doc:
                    add(settled, (part, mask), one)
                    continue
                doc = int(doc)
                have = least.get(text)
                if have is None or doc < have[0]:
                    for (p, m), c in have[1].items() if have else ():
                        add(settled, (p, m | COPY), c)
                    least[text] = have = (doc, {})
                if doc == have[0]:
                    add(have[1], (part, mask), one)
                else:
                    add(settled, (part, mask | COPY), one)
            if len(least) > texts:
                yield out()
        if least or settled:
            yield out()

    return fold


def update_minima(key, frames, state):
    """Signed counts of a bucket's new rows; a smaller id takes back what its text's former least rows counted as.

    The state is text to [least id, [[part, mask, n, good, toxic] of its rows]].
    """
    import pandas as pd

    names = [c.split()[0] for c in COUNTERS.split(", ")]
    if key[0] < 0:
        for frame in frames:
            yield frame[names]
        return
    held = json.loads(state.get[0]) if state.exists else {}
    out: list[tuple] = []
    for frame in frames:
        for text, doc, part, mask, *counts in zip(*(frame[c].tolist() for c in ("text", "doc_id", "part", "mask", "n", "good", "toxic"))):
            have = held.get(text)
            if have is None or doc < have[0]:
                for p, m, *c in have[1] if have else ():
                    out += [(p, m, *(-x for x in c)), (p, m | COPY, *c)]
                held[text] = have = [doc, []]
            if doc > have[0]:
                out.append((part, mask | COPY, *counts))
                continue
            out.append((part, mask, *counts))
            for row in have[1]:
                if row[:2] == [part, mask]:
                    row[2:] = [a + b for a, b in zip(row[2:], counts)]
                    break
            else:
                have[1].append([part, mask, *counts])
    state.update((json.dumps(held),))
    yield pd.DataFrame(out, columns=names)


def stream_counters(spark: SparkSession, path: str, labels: DataFrame, micro_batches: int = 4, texts_a_bucket: int = 1000, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counters part, mask, n, good, toxic of the Parquet files at ``path``, as signed rows of every micro-batch.

    All files are read as available-now micro-batches, about ``micro_batches`` of them, each a
    restart point. Texts are hashed and forgotten where they are read; a small row of each
    is joined with its label, and goes to the state of its text: text digests in buckets of
    about ``texts_a_bucket``, for a call of Python has its price, some 100 bytes a text. The
    session's state store keeps them and their checkpoints: Spark's default holds its share in
    each executor's heap, ``spark.sql.streaming.stateStore.providerClass`` can name RocksDB,
    which needs none, but 4 MB of disk for each partition. The sum of the rows up to a batch are
    the counters at its end.
    """
    files = spark.read.parquet(path)
    schema, n_rows, names = files.schema, files.count(), files.inputFiles()
    n_buckets = max(1, n_rows // texts_a_bucket)
    a_batch = max(1, -(-len(names) // micro_batches))
    if names and names[0].rstrip("/").rpartition("/")[2] == path.rstrip("/").rpartition("/")[2]:
        path = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"  # a stream reads folders or patterns, and this is a single file
    out, checkpoint = new_path(spark, "filter-counters"), new_path(spark, "filter-audit")
    spark.createDataFrame([], COUNTERS).write.parquet(f"{out}/batch=-1")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", a_batch).parquet(path)
    rows = stream.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.select("doc_id", "part", own_mask(F.col("_text"), F.col("_words")).alias("mask"), F.md5(F.col("_text").cast("binary")).alias("text"))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(c)
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(flag("quality"), flag("toxic"))
    # a null id has no label; spread, so that many of them don't meet in a task
    meets = F.coalesce("doc_id", -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    rows = rows.withColumn("_meets", meets).join(known, (F.col("_meets") == F.col("_id")) & F.col("doc_id").isNotNull(), "left")
    rows = rows.select("text", "doc_id", "part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    folded = rows.mapInPandas(fold_texts(n_buckets), CANDIDATES)
    deltas = folded.groupBy("bucket").applyInPandasWithState(update_minima, COUNTERS, "held string", "update", GroupStateTimeout.NoTimeout)

    def count(batch: DataFrame, number: int) -> None:
        sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
        batch.groupBy("part", "mask").agg(*sums).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = deltas.writeStream.outputMode("update").foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{COUNTERS}, batch int").parquet(out)


def interactions(counters: DataFrame) -> DataFrame:
    """Every order of the filters applied to counters (part, mask, n, good, toxic; signed rows of a mask are summed).

    Counts need only what comes before a filter, not its order: 80 sums for each part, then
    120 orders of 5 steps look theirs up. Result: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    spark, everything = counters.sparkSession, (1 << len(FILTERS)) - 1
    pairs = [(before, 1 << i) for i in range(len(FILTERS)) for before in range(everything + 1) if not before >> i & 1]
    sums = counters.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    wide = sums.crossJoin(F.broadcast(spark.createDataFrame(pairs, "before int, own int")))
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0)))
    # of a document that fails k filters each is the first in 120 / k orders
    share = F.when(fails, (F.col("n") * 120 / F.bit_count("mask")).cast("long")).otherwise(F.lit(0))
    found = wide.groupBy("part", "before", "own").agg(
        count(~fails & ~earlier).alias("kept"), count(fails & ~earlier).alias("removed"), count(fails & earlier).alias("redundant"), count(F.col("mask") == F.col("own")).alias("unique_fails"),
        count(fails & ~earlier, "good").alias("good_lost"), count(fails & ~earlier, "toxic").alias("toxic_lost"), F.sum(share).alias("shapley"),
    )
    steps = [("".join(p), k + 1, sum(1 << FILTERS.index(x) for x in p[:k]), 1 << FILTERS.index(p[k])) for p in itertools.permutations(FILTERS) for k in range(len(FILTERS))]
    orders = spark.createDataFrame(steps, "filter_order string, step int, before int, own int")
    return found.join(F.broadcast(orders), ["before", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    """Five filters in every order over all documents at ``path``, for each value of the part column.

    A fails under 50 words, B with fewer than 65 different words in 100, C with more than 5
    capital letters A to Z in 100 characters, D with any of ``#$%&*|``, E where the same text
    has a smaller id anywhere in the table. See ``interactions`` for the columns.

    Null texts are empty texts, and copies of each other; a null part is the empty string.
    A row without an id is nobody's copy nor original, and has no label. Rows that repeat an
    id and a text are not copies of each other, and count each. A document is good (toxic) where
    any of its labels says so. An empty table has no rows. Other columns are ignored.
    """
    return interactions(stream_counters(spark, path, labels, **options))
