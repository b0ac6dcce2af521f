"""Bigram language model by deleted interpolation, trained on and applied to the whole corpus.

P(w | h) = l2 * c(h, w) / c(h) + l1 * c(w) / N + l0 / (V + 1), with weights (l2, l1, l0) for each bucket of the
context's frequency c(h) (a bucket for 0, then one per octave). The weights are learned by expectation-maximisation on
deleted counts: every training token is held out in turn, that is, predicted from all counts less its own.

Documents are encoded once into blocks of about a million tokens. A block sends each range of hash values its distinct
words and bigrams with their training counts, sorted; the range's task adds up the counts and answers each block with
the totals in the order asked. So what moves is one key per distinct n-gram and block, in columns of a few bytes, and
any key, however frequent, is one entry per block. No table of counts is ever broadcast or held whole by a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

BLOCK_TOKENS = 1 << 20
RANGE_KEYS = 1 << 21
END, START = b"\n", b"\t\n"  # no word holds white space
PRIOR = 0.1
BUCKETS = 66  # of context frequencies: 0, then octaves of a 64-bit count
STEP_2, STEP_1 = 8, 4  # grid steps per octave of the bigram's and the word's probability while weights are learned
ROUNDS = 100


def pack(a: np.ndarray) -> bytes:
    """An array of unsigned integers as compressed byte planes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.zeros(1, a.dtype)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def encode_blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """(id, held_out, text) -> blocks: ids, held-out flags and lengths of the documents, the words' hashes (the end
    first), the documents' word numbers, and how many of the tokens are for training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        made = 0
        ids, keys, held, parts, size = _Ids(), [], [], [], 0
        ids[END]

        def block() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))
            lengths = np.array([len(p) for p in parts], np.int64)
            flags = np.array(held, bool)
            out = {
                "block": pa.array([first + made]),
                "ids": pa.array([pa.array(keys, kind)], pa.list_(kind)),
                "held": pa.array([flags.astype(np.uint8).tobytes()]),
                "lengths": pa.array([pack(lengths.astype(np.uint64))]),
                "hashes": pa.array([pack(hashes)]),
                "stream": pa.array([pack(np.concatenate(parts))]),
                "train_tokens": pa.array([int(lengths[~flags].sum())]),
                "tokens": pa.array([int(lengths.sum())]),
            }
            return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                found.append(END)
                keys.append(key)
                held.append(out)
                parts.append(np.fromiter(map(ids.__getitem__, found), np.uint32, len(found)))
                size += len(found)
                if size >= block_tokens:
                    yield block()
                    made += 1
                    ids, keys, held, parts, size = _Ids(), [], [], [], 0
                    ids[END]
        if keys:
            yield block()

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"block long, ids array<{kind}>, held binary, lengths binary, hashes binary, stream binary, train_tokens long, tokens long")


def bigrams(stream: np.ndarray, lengths: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) pairs of a block, which one each token is, and the start of each document; the number
    `words` stands for the start of a document."""
    starts = np.cumsum(lengths) - lengths
    context = np.empty(len(stream), np.int64)
    context[1:] = stream[:-1]
    context[starts] = words
    codes, which = np.unique(context * (words + 1) + stream, return_inverse=True)
    return codes // (words + 1), codes % (words + 1), which, starts


def bigram_hash(hashes: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit key of each pair, mixed so that order and equal words matter."""
    a, b = hashes[context], hashes[word]
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes = np.r_[unpack(row["hashes"], np.uint64), np.uint64(xxhash.xxh64_intdigest(START))]
    held = np.frombuffer(row["held"], np.uint8).astype(bool)
    return hashes, unpack(row["stream"], np.uint32).astype(np.int64), unpack(row["lengths"], np.uint64).astype(np.int64), held


def _asked(row: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, then for bigrams: the sorted keys, their training counts here, and the sorting order."""
    hashes, stream, lengths, held = _opened(row)
    context, word, which, _ = bigrams(stream, lengths, len(hashes) - 1)
    training = np.repeat(~held, lengths)
    ones = np.bincount(stream[training], minlength=len(hashes))
    ones[-1] = int((~held).sum())
    twos = np.bincount(which[training], minlength=len(context))
    out = []
    for keys, counts in ((hashes, ones), (bigram_hash(hashes, context, word), twos)):
        order = np.argsort(keys)
        out.append((keys[order], counts[order].astype(np.uint32), order))
    return out


def questions(blocks: DataFrame, bits: int) -> DataFrame:
    """(range, block, keys, counts): what each block asks of each range of words (0..) and of bigrams (2**bits..)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                for order, (keys, counts, _) in enumerate(_asked(row)):
                    at = np.r_[0, np.searchsorted(keys, edges), len(keys)]
                    some = np.flatnonzero(np.diff(at))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some + (order << bits), pa.int64()),
                            pa.array([row["block"]] * len(some), pa.int64()),
                            pa.array([pack_sorted(keys[at[i] : at[i + 1]]) for i in some], pa.binary()),
                            pa.array([pack(counts[at[i] : at[i + 1]]) for i in some], pa.binary()),
                        ],
                        names=["range", "block", "keys", "counts"],
                    )

    return blocks.select("block", "held", "lengths", "hashes", "stream").mapInArrow(run, "range long, block long, keys binary, counts binary")


def answers(asked: DataFrame, bits: int) -> DataFrame:
    """(block, range, counts, known): totals in the order asked, and once per range of words how many are known."""
    start = np.uint64(xxhash.xxh64_intdigest(START))

    def run(group: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in group["keys"].to_pylist()]
        counts = np.concatenate([unpack(x, np.uint32) for x in group["counts"].to_pylist()])
        ends = np.cumsum([len(k) for k in keys])
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.uint64)
        which = totals[which]
        known = int(((totals > 0) & (distinct != start)).sum()) if group["range"][0].as_py() < 1 << bits else 0
        return pa.table(
            {
                "block": group["block"],
                "range": group["range"],
                "counts": pa.array([pack(x) for x in np.split(which, ends[:-1])], pa.binary()),
                "known": pa.array([known] + [0] * (len(keys) - 1), pa.int64()),
            }
        )

    return asked.groupBy("range").applyInArrow(run, "block long, range long, counts binary, known long")


def _frequency_bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, 0)


def deleted_histogram(one: np.ndarray, two: np.ndarray, context: np.ndarray, word: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens by (bucket, bigram's, word's) probability with themselves held out -> cells and their weight."""
    seen = times > 0
    c2, ch, c1 = two[seen] - 1.0, one[context[seen]] - 1.0, one[word[seen]] - 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        q2 = np.where(c2 > 0, np.round(STEP_2 * np.log2(c2 / ch)), -9999).astype(np.int64)
        q1 = np.where(c1 > 0, np.round(STEP_1 * np.log2(c1 / max(1, n - 1))), -9999).astype(np.int64)
    cell = (_frequency_bucket(ch) * 10_000 - q2) * 10_000 - q1
    cells, which = np.unique(cell, return_inverse=True)
    return cells, np.bincount(which, weights=times[seen], minlength=len(cells)).astype(np.int64)


def learn_weights(cells: np.ndarray, weight: np.ndarray, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Expectation-maximisation over the cells: weights (bigram, word, uniform) for each bucket of the context."""
    out = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    if not len(cells):
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    cells = np.asarray(cells, np.int64)
    q1 = -(cells % 10_000)
    q2 = -(cells // 10_000 % 10_000)
    bucket = cells // 100_000_000
    p = np.stack([np.where(q2 > -9999, np.exp2(q2 / STEP_2), 0), np.where(q1 > -9999, np.exp2(q1 / STEP_1), 0), np.full(len(cells), 1 / (v + 1))], axis=1)
    for b in np.unique(bucket):
        at = bucket == b
        w, pb, now = weight[at].astype(float), p[at], np.array([0.4, 0.5, 0.1]) if b else np.array([0.0, 0.9, 0.1])
        for _ in range(rounds):
            part = now * pb
            part *= (w / part.sum(axis=1))[:, None]
            now = part.sum(axis=0) / w.sum()
        now = np.maximum(now, 1e-6 * (np.array([b > 0, True, True])))  # nothing known is impossible
        out[b] = now / now.sum()
    for b in range(1, BUCKETS):  # frequencies that training never saw use the next smaller ones' weights
        if b not in bucket and b - 1:
            out[b] = out[b - 1]
    return out


def score_corpus(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """docs -> id, held_out, n_tokens, n_known, train_tokens, base_score, score; held_out is a boolean column.

    Tokens are the words in lower case (A-Z) and one end per document; an empty, blank or null text is the end alone.
    Null ids stay rows; repeated rows are documents of their own, and their counts add up; other columns are ignored;
    an empty input gives an empty result. Without training documents every token has the uniform probability.
    """
    rows = docs.select(F.col(id_col).alias("_id"), held_out.alias("_held"), F.col(text_col).alias("_text"))
    blocks = materialize(encode_blocks(rows, block_tokens), "lm-blocks")
    n, tokens = (int(x or 0) for x in blocks.agg(F.sum("train_tokens"), F.sum("tokens")).first())
    bits = max(2, math.ceil(math.log2(max(1, tokens / range_keys))))
    totals = materialize(answers(questions(blocks, bits), bits), "lm-counts")
    v = int(totals.agg(F.sum("known")).first()[0] or 0)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        (hashes, stream, lengths, held), asked = _opened(row), _asked(row)
        got = sorted(zip(right["range"].to_pylist(), right["counts"].to_pylist()))
        counts = []
        for order, (keys, _, at) in enumerate(asked):
            total = np.empty(len(keys), np.uint64)
            total[at] = np.concatenate([unpack(c, np.uint64) for r, c in got if r >> bits == order])
            counts.append(total)
        context, word, which, _ = bigrams(stream, lengths, len(hashes) - 1)
        times = np.bincount(which[np.repeat(~held, lengths)], minlength=len(context))
        cells, weight = deleted_histogram(counts[0].astype(float), counts[1].astype(float), context, word, times, n)
        made = {c: left[c] for c in ("block", "ids", "held", "lengths", "stream")}
        made |= {"ones": pa.array([pack(counts[0])]), "twos": pa.array([pack(counts[1])])}
        return pa.table(made | {"cells": pa.array([cells], pa.list_(pa.int64())), "weight": pa.array([weight], pa.list_(pa.int64()))})

    kind = rows.schema["_id"].dataType.simpleString()
    counted = blocks.groupBy("block").cogroup(totals.select("block", "range", "counts").groupBy("block")).applyInArrow(
        join, f"block long, ids array<{kind}>, held binary, lengths binary, stream binary, ones binary, twos binary, cells array<bigint>, weight array<bigint>"
    )
    counted = materialize(counted, "lm-counted")
    # The grid bounds the number of cells, whatever the corpus.
    cells = counted.select(F.explode(F.arrays_zip("cells", "weight")).alias("z")).groupBy("z.cells").agg(F.sum("z.weight").alias("weight")).toPandas()
    weights = learn_weights(cells["cells"].to_numpy(), cells["weight"].to_numpy(), v)
    scale = n + PRIOR * (v + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("held", "lengths", "stream", "ones", "twos")}
                stream, lengths = unpack(row["stream"], np.uint32).astype(np.int64), unpack(row["lengths"], np.uint64).astype(np.int64)
                one, two = unpack(row["ones"], np.uint64).astype(float), unpack(row["twos"], np.uint64).astype(float)
                context, word, which, starts = bigrams(stream, lengths, len(one) - 1)
                ch = one[context]
                w = weights[_frequency_bucket(ch)]
                p = w[:, 0] * two / np.maximum(ch, 1) + w[:, 1] * one[word] / max(1, n) + w[:, 2] / (v + 1)
                base = np.log10((one + PRIOR) / scale)
                sums = [np.add.reduceat(x, starts) for x in (np.log10(p)[which], base[stream], (one > 0)[stream].astype(np.int64))]
                ids = batch.column("ids")[i].values
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.frombuffer(row["held"], np.uint8).astype(bool)), pa.array(lengths), pa.array(sums[2]), pa.array(np.full(len(ids), n)), pa.array(sums[1]), pa.array(sums[0])],
                    names=["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return counted.select("ids", "held", "lengths", "stream", "ones", "twos").mapInArrow(
        score, f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ).withColumnRenamed("_id", id_col)


def held_out_tenth(id_col: str = "doc_id"):
    """crc32 of the id as text, divisible by ten; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")) % 10 == 0


def op10_language_model(spark, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the model of the other nine tenths, and the unigram base beside it.

    A null, empty or blank text is its end token alone; texts of any length are scored whole; repeated rows count each time;
    null ids stay rows; an empty table gives an empty result; other columns are not read.
    """
    return score_corpus(table(spark, sf_dir, "documents"), held_out_tenth())
