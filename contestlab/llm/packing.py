"""Mixture-controlled packing of tokenised documents into windows of fixed length.

Windows are filled slot by slot (a slot is `quantum` tokens) from one queue per source by deficit round-robin. A source
earns credit in proportion to its target share and is served when it is furthest behind: the next slot goes to the
source with the least (served + 1/2) / share of those with tokens left. What a source is owed at the end of a window
carries over to the next one, so any window holds the shares to within a slot, until a queue is empty and the others
go on in theirs. The k-th slot of a source is thus due at (k + 1/2) / share, and merging the queues in the order of
due times is the same schedule without a sequential pass; the test runs that pass beside it.

A queue is the stream of its documents' tokens, cut at every slot's end. Where a document begins in the stream is the
count of its queue's tokens in the chunks before its own (the partitions that tokenised them) and before it in its
chunk, so what a partition leaves unfilled is filled by the next one. Only a queue's last slot can be part-filled.
Slots are dealt over ranges of due times and ranked range by range, with the counts of the ranges before; no task holds
more than one range or chunk, whatever the skew of sources.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, table

WINDOW = 1024
QUANTUM = 128
ROWS_PER_RANGE = 1 << 16  # pieces ranked in one task
CACHE_ENTRIES = 300_000
END_OF_TEXT = "<|endoftext|>"  # the vocabulary's special token and its id; in a text it stands for itself
END_OF_TEXT_ID = 50256
TEXT_AT_ONCE = 1 << 24  # bytes of whole texts whose chunks are told apart together
CHUNKS_AT_ONCE = 1 << 15  # different chunks encoded in one call
UNITS_AT_ONCE = 1 << 18  # chunks whose ids are put in place together
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNEVEN = rf"^$|^{_SPACE}|{_SPACE}{_SPACE}|{_SPACE}$|<\|endoftext\|>"  # texts that aren't cut at their spaces


class _Chunks(dict):
    """Chunk of text between single spaces -> its ids as little-endian 32-bit bytes; emptied when full."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        made = np.array(self.encode(self.lead + chunk), dtype="<u4").tobytes()
        if len(chunk) <= 64:
            self[chunk] = made
        return made


@cache
def byte_bpe(path: str):
    """text -> ids as little-endian 32-bit bytes, with the ranks at path; one encoder for each worker, what it remembers until forget().

    The pre-tokenizer always starts a new piece at a space between two characters that are not white space, so such
    chunks are encoded one by one and remembered. Texts with longer runs of white space are encoded whole.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    runs = re.compile(r"\s\s")
    inner = _Chunks(encoding.encode_ordinary, " ")

    def plain(text: str) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or runs.search(text):
            return np.array(encoding.encode_ordinary(text), dtype="<u4").tobytes()
        first, _, rest = text.partition(" ")
        head = np.array(encoding.encode_ordinary(first), dtype="<u4").tobytes()
        return head + b"".join(map(inner.__getitem__, rest.split(" "))) if rest else head

    special = np.array([END_OF_TEXT_ID], dtype="<u4").tobytes()

    def encode(text: str) -> bytes:
        return special.join(map(plain, text.split(END_OF_TEXT))) if END_OF_TEXT in text else plain(text)

    encode.forget = inner.clear
    encode.ordinary = encoding.encode_ordinary
    encode.led = np.zeros(max(ranks.values()) + 1, bool)  # the ids of tokens that begin with a space
    encode.led[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    return encode


def encoded(texts: pa.Array, encode, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """texts, none of them null -> the ids of all of them one after another, each text's followed by the end id, and
    how many of them each has. Token ids of 16 bits are kept as such.

    Texts are cut at their spaces, as byte_bpe() cuts them. Each different chunk is encoded once, many in one call: the
    only space in a chunk leads it, so the ids of the next one begin where a token begins with a space. The texts' ids
    are then taken from the chunks'. A text's first chunk, which no space leads, and uneven texts are encoded one by one.
    """
    uneven = pc.match_substring_regex(texts, UNEVEN)
    lists = pc.split_pattern(pc.if_else(uneven, "-", texts), " ")
    chunks, n = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    first = np.cumsum(n) - n
    known = chunks.dictionary_encode()
    ids = []
    for at in range(0, len(known.dictionary), CHUNKS_AT_ONCE):
        some = known.dictionary.slice(at, CHUNKS_AT_ONCE)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
        ids.append(np.array(encode.ordinary(" " + joined), "<u4"))
    sizes = [np.diff(np.append(np.flatnonzero(encode.led[x]), len(x))) for x in ids]
    ids.append(np.array([end_id], "<u4"))
    for i, (whole, head) in enumerate(zip(uneven.to_pylist(), chunks.take(pa.array(first)).to_pylist())):
        ids.append(np.frombuffer(encode(texts[i].as_py()), "<u4") if whole else np.array(encode.ordinary(head), "<u4"))
    sizes = np.concatenate([*sizes, [len(x) for x in ids[len(sizes) :]]])
    ids = np.concatenate(ids)
    ids = ids.astype("<u2") if ids.max() < 1 << 16 else ids
    begins, end = np.cumsum(sizes) - sizes, len(known.dictionary)
    units = np.insert(known.indices.to_numpy(), first + n, end)
    units[first + np.arange(len(n))] = end + 1 + np.arange(len(n))
    made = []
    for at in range(0, len(units), UNITS_AT_ONCE):
        some = units[at : at + UNITS_AT_ONCE]
        size = sizes[some]
        stop = np.cumsum(size)
        made.append(ids[np.repeat(begins[some] - stop + size, size) + np.arange(stop[-1])])
    return np.concatenate(made), np.add.reduceat(sizes[units], first + np.arange(len(n)))


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first, number) of runs of neighbours that together have at most `most`, or are one alone."""
    part, total = [0], 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            part.append(i)
            total = 0
        total += size
    return [(lo, hi - lo) for lo, hi in zip(part, [*part[1:], len(sizes)]) if hi > lo]


def tokenised(docs: DataFrame, ranks: str, end_id: int) -> DataFrame:
    """(doc_id, queue, text) -> with the tokens and their number in place of the text, the chunk that a row was
    tokenised in and the tokens of its queue that came before it there. Token ids of 16 bits are kept as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, chunk, seen = byte_bpe(ranks), TaskContext.get().partitionId(), {}
        for batch in batches:
            texts = batch.column(2).fill_null("")
            for rows in slices(pc.binary_length(texts).to_numpy(), TEXT_AT_ONCE):
                ids, counts = encoded(texts.slice(*rows), encode, int(end_id))
                before, kept, at = [], [], 0
                for queue, n in zip(batch.column(1).slice(*rows).to_pylist(), counts.tolist()):
                    before.append(seen.get(queue, 0))
                    seen[queue] = before[-1] + n
                    kept.append(ids[at : at + n].tobytes())
                    at += n
                made = [pa.array(counts, pa.int64()), pa.array([chunk] * len(counts), pa.int64()), pa.array(before, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(*rows) for c in range(2)), *made], names=["doc_id", "queue", "doc_tokens", "chunk", "before", "ids"])
        encode.forget()  # the worker goes on to other stages

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "queue", "text").mapInArrow(run, f"doc_id {kind}, queue string, doc_tokens long, chunk long, before long, ids binary")


def cut(placed: DataFrame, quantum: int) -> DataFrame:
    """(doc_id, queue, doc_tokens, at, ids) -> a row per piece: start and length in its document, the number of its slot
    in the queue, where in the slot it begins, and its checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, starts, lengths, sums, places = [], [], [], [], []
            for i, (n, at, raw) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4))):
                raw = raw.as_py()
                ids = memoryview(raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                begin = np.r_[0, np.arange(quantum - at % quantum, n, quantum)]
                ends = np.r_[begin[1:], n]
                owner.append(np.full(len(begin), i))
                starts.append(begin)
                lengths.append(ends - begin)
                places.append(at + begin)
                sums += [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(begin.tolist(), ends.tolist())]
            if owner:
                who, place = pa.array(np.concatenate(owner)), np.concatenate(places)
                made = [pa.array(np.concatenate(x)) for x in (starts, lengths)] + [pa.array(place // quantum), pa.array(place % quantum), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(who) for c in range(3)), *made], names=["doc_id", "queue", "doc_tokens", "start", "length", "k", "inner", "ids_crc32"])

    kind = placed.schema["doc_id"].dataType.simpleString()
    rows = placed.select("doc_id", "queue", "doc_tokens", "at", "ids")
    return rows.mapInArrow(run, f"doc_id {kind}, queue string, doc_tokens long, start long, length long, k long, inner long, ids_crc32 long")


def pack(docs: DataFrame, ranks: str, window: int = WINDOW, quantum: int = QUANTUM, end_id: int = 0, shares: dict[str | None, float] | None = None) -> DataFrame:
    """docs(doc_id, source, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    shares: the sources' target proportions of a window's tokens (1 for one that isn't named); without them every
    source weighs the tokens it has, so all queues end together. window is a multiple of quantum. A null text is empty
    and still has its end id; null sources form one queue; repeated rows and null ids are documents of their own; other
    columns are ignored. An empty input gives no pieces. Texts of any length are encoded whole.
    """
    slots_per_window = window // quantum
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    base = materialize(tokenised(docs.select("doc_id", queue.alias("queue"), "text"), ranks, end_id), "pack-tokens")
    chunks = base.groupBy("queue", "chunk").agg(F.sum("doc_tokens").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("queue")
    own = F.ceil(F.sum("n").over(every) / F.lit(quantum)).cast("double")
    named = None if shares is None else F.create_map(*[F.lit(x) for s, w in shares.items() for x in ("" if s is None else "=" + s, float(w))])
    share = own if named is None else F.coalesce(F.try_element_at(named, F.col("queue")), F.lit(1.0))
    chunks = materialize(chunks.select("queue", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), share.alias("share")), "pack-chunks")
    # One row for each chunk and source: Spark broadcasts it if it is small, and else sends a chunk's rows to one task.
    placed = base.join(chunks.drop("share"), ["queue", "chunk"]).withColumn("at", F.col("first") + F.col("before"))
    pieces = materialize(cut(placed, quantum), "pack-pieces")
    forget(base)
    due = pieces.join(chunks.select("queue", "share").distinct(), "queue").withColumn("due", (F.col("k") + 0.5) / F.col("share")).drop("share")
    ranges = max(8, math.ceil(pieces.count() / ROWS_PER_RANGE))
    ranged = materialize(due.repartitionByRange(ranges, "due", "queue", "k").withColumn("range", F.spark_partition_id()), "pack-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.where("inner = 0").groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("range").orderBy("due", "queue", "k")
    ranked = ranged.withColumn("nth", F.dense_rank().over(order) - 1).join(firsts, "range").withColumn("slot", F.col("first") + F.col("nth"))
    ranked = ranked.withColumn("sequence_id", F.floor(F.col("slot") / slots_per_window).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy("slot", "inner").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def ranks_path() -> str:
    """The public byte-level BPE vocabulary as ranks: the ids of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in windows of at most 1024 tokens, every window mixed in the sources' own proportions.

    A null or empty text is its end token alone; texts of any length are packed whole; null sources form one queue; repeated
    rows and null ids are documents of their own; an empty table gives no pieces; other columns are not read.
    """
    return pack(table(spark, sf_dir, "documents"), ranks_path())
