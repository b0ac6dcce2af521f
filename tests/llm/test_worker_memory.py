"""What a Python worker holds of near-dedup and packing, while they run and afterwards."""

import tracemalloc

import numpy as np

from contestlab.llm import near_copies, packing, simhash
from contestlab.llm.common import rows_a_batch


def held(work):
    """(most MB at once, MB left) of work()."""
    tracemalloc.start()
    try:
        work()
        left, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    return most / 1e6, left / 1e6


def test_words_are_not_remembered():
    def work():
        for i in range(20):
            near_copies.word_hashes(" ".join(f"w{i}x{j}" for j in range(10_000)))

    assert held(work)[1] < 1


def test_patterns_of_many_fingerprints_meet_in_small_passes():
    fps = np.random.default_rng(2).integers(0, 2**63, 4000, dtype=np.uint64)
    fps[1::2] = fps[::2] ^ np.uint64(1 << 7)
    found, low = [], 36
    left, mask = np.full(len(fps), 2), np.uint64((1 << low) - 1)
    most, _ = held(lambda: found.append(simhash.meet(fps, fps & mask, left, low)))
    assert {frozenset(x) for x in zip(fps[::2].tolist(), fps[1::2].tolist())} <= {frozenset(x) for x in zip(*(x.tolist() for x in found[0]))}
    assert most < 60


def test_packing_forgets_what_it_encoded():
    encode = packing.byte_bpe(packing.ranks_path())
    encode.forget()
    assert held(lambda: (encode(" ".join(f"w{j}" for j in range(50_000))), encode.forget()))[1] < 1


def test_batches_of_whole_texts_are_small_and_the_setting_returns(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes():
        import pyarrow as pa

        rows = spark.range(0, 3000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        return max(r.n for r in rows.collect())

    with rows_a_batch(spark, near_copies.TEXTS_AT_ONCE):
        assert sizes() == near_copies.TEXTS_AT_ONCE
        with rows_a_batch(spark, 10_000):
            assert sizes() == near_copies.TEXTS_AT_ONCE
    assert spark.conf.get(name) == before and sizes() == 3000
