"""Suffix-array deduplication against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlab.llm import suffix_index

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(raw[s : s + length] for _, raw in raws for s in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def digest(got):
    rows = got.select("doc_id", "n_bytes", F.size("spans").alias("n"), "kept").collect()
    return [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), r.n, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def planted(seed=3):
    """Passages of lengths about the threshold in texts of their own, copies edited here and there, periodic texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé ") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(n) for n in (8, 9, 10, 12, 20, 60)]
    texts = [prose(rng.randint(0, 30)) + rng.choice(passages) + prose(rng.randint(0, 30)) for _ in range(80)]
    base = prose(60)
    for _ in range(40):
        some = base.split(" ")
        some[rng.randrange(len(some))] = rng.choice(words)
        texts.append(" ".join(some))
    texts += ["ab" * 100, "ab" * 90 + "c", "a" * 300, "a" * 59, "a" * 60, "a" * 61, base, base, "é" * 31, "é" * 29, "", None]
    return list(enumerate(texts))


def test_equals_brute_force_on_planted_passages(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(digest(suffix_index.drop_repeats(docs, length=60, span=40)), brute(rows, 60))


@pytest.mark.parametrize("crowd, block", [(0, 1 << 20), (4, 128)])
def test_crowded_starts_and_small_blocks(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(suffix_index, "BLOCK", block)
    rows = planted(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(digest(suffix_index.drop_repeats(docs, length=60, span=40, crowd=crowd, batches=3)), brute(rows, 60))


def test_equals_brute_force_on_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same([tuple(r) for r in suffix_index.op12_suffix_dedup(spark, SF).collect()], brute(rows, 400))


def test_odd_and_no_rows(spark, odd, none):
    same(digest(suffix_index.drop_repeats(odd)), brute([(r.doc_id, r.text) for r in odd.collect()], 400))
    assert suffix_index.drop_repeats(none).count() == 0


def test_levels_grow_as_the_logarithm(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, text string").where("text is not null").select(F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    index, levels = suffix_index.SuffixIndex(spark, 60, 40), []
    for b in range(5):
        index.add(docs.where(F.pmod("t", F.lit(5)) == b))
        levels.append(sorted(n for n, _ in index.levels))
    assert levels == [[1], [1, 1], [1, 2], [1, 1, 2], [1, 4]]
    index.close()


def test_scan_of_a_level_is_no_shuffle(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, text string").where("text is not null").select(F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    index = suffix_index.SuffixIndex(spark, 60, 40)
    a, b = (index._sorted(suffix_index.suffixes(docs, 60, 40)) for _ in range(2))
    plan = a.hint("merge").join(b.select("key").distinct(), "key", "left_semi")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[-1]


def test_every_window_has_one_owner_and_equal_windows_equal_places():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(0, 3, 3000, dtype=np.uint8))
    anchor, first, last = suffix_index.owned_runs(data, np.array([0, 1500]), np.array([1499 - 60, 2999 - 60]), 60, 40)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert covered.tolist() == [*range(1440), *range(1500, 2940)]
    assert all(a <= p + 40 and p >= a for p, a in zip(anchor, first))
    h = suffix_index.window_hashes(data, 60)
    assert len(h) == 2941 and len(set(h.tolist())) == len({data[i : i + 60] for i in range(2941)})
