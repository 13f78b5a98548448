"""What a task of an operator holds between its blocks and when it ends."""

import gc
import weakref

import numpy as np
import pytest

from langdrift.llm import common, katz


class Freed:
    """Counts the objects given to it that are still held."""

    def __init__(self):
        self.seen = []

    def add(self, thing):
        self.seen.append(weakref.ref(thing))
        return thing

    def held(self):
        gc.collect()
        return sum(r() is not None for r in self.seen)


def block(number):
    """What ``readings`` gives of a block of two short texts."""
    lengths = np.array([3, 2])
    hashes = np.array([11, 12, 13, 11, 12], np.uint64)
    unigrams = katz.Unigrams(7, 4, [0, 1, 3, 0, 0, 0, 0])
    words, _, _ = katz.distinct(hashes)
    check = np.array([katz.zlib.crc32(words.tobytes())], np.uint32)
    vocabulary = {0: katz.pack(check, np.array([2, 3, 4], np.uint64), np.array([2, 2, 1], np.uint64))}
    tokens = katz.Tokens(hashes, lengths, vocabulary, 1, 2, unigrams)
    return 0, number, [1, 2], np.array([True, False]), lengths, tokens, tokens.grams(2, 1e9, 1), unigrams


@pytest.mark.parametrize("task", [lambda read, u: katz.ask_order(1, read), lambda read, u: katz.deal_last(1, read, u)])
def test_katz_tasks_hold_one_block(monkeypatch, task):
    tracked, at_end = Freed(), []

    def read(_):
        for number in range(3):
            assert tracked.held() == 0
            own = block(number)[:7]
            tracked.add(own[5]), tracked.add(own[6])
            yield own
            del own

    for module in (common, katz):
        monkeypatch.setattr(module, "give_back", lambda: at_end.append(tracked.held()), raising=False)
    n = 0
    for _ in task(read, block(0)[7])([]):
        n += 1
    assert n >= 3 and at_end == [0]


def test_katz_blocks_keep_no_words():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": pa.array(["a b A", None])})
    blocks = katz.blocks_of([batch], 5, 1, 1000)
    number, ids, train, hashes, lengths = next(blocks)
    assert (number, ids, lengths.tolist(), hashes[0] == hashes[2]) == (0, [1, 2], [3, 0], True)
    assert not {"words", "flat"} & set(blocks.gi_frame.f_locals)


def test_memory_is_given_back_when_a_tasks_variables_are_gone(monkeypatch):
    tracked, at_end = Freed(), []
    monkeypatch.setattr(common, "give_back", lambda: at_end.append(tracked.held()))

    def run(batches):
        for b in batches:
            big = tracked.add(np.zeros(b))
            yield len(big)

    assert list(common.giving_back(run)([3, 4])) == [3, 4] and at_end == [0]


def test_packing_encodes_little_at_once(spark, monkeypatch):
    from langdrift.llm import packing, queries, token_ids

    most = []
    monkeypatch.setattr(packing, "giving_back", lambda run: most.append(run) or run)
    docs = spark.createDataFrame([(i, "word " * 500) for i in range(4)], "doc_id long, text string").coalesce(1)
    packed = packing.pack_documents(docs, queries.tokenizer_path())
    assert sorted((r["doc_id"], r["length"]) for r in packed.collect()) == [(i, 501) for i in range(4)] and len(most) == 1

    class Encoder:
        def encode(self, texts):
            most.append(sum(map(len, texts)))
            return [b"\0" * 4 for _ in texts]

    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(packing, "cached_tokenizer", lambda path: Encoder())
    monkeypatch.setattr(TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(100)), "text": pa.array(["x" * 100_000] * 100)})
    run, most[:] = most[0], []
    assert sum(b.num_rows for b in run([batch])) == 100
    assert len(most) > 1 and sum(most) == 10_000_000 and max(most) <= 2_100_000
    # of a tokenizer file nothing large is kept beside the library's own
    assert not [k for k, v in vars(token_ids.cached_tokenizer(queries.tokenizer_path())).items() if isinstance(v, dict) and "model" in v]
