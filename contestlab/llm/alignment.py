"""Alignment of two tokenizers' tokens by a sweep over the byte offsets at which tokens end.

Both tokenizers' end events are united in one table and dealt by document; a document's events are sorted on offset and
stream through a machine whose state is the group that is still open. Where an A and a B token end at one offset a group
closes. Between two neighbouring end offsets lies exactly one A token and one B token, so the sweep emits one link for
each distinct end offset, and has met every pair of tokens whose bytes overlap.

An event row holds the ends of one side within one range of RANGE bytes, so a document of any length is many rows of
bounded size, and rows and not single events are shuffled and sorted; inside a pair of rows the ends are merged by numpy.
A token that straddles a range, or a group that does, is carried to the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, hot_keys, materialize, spread_join, table

RANGE = 1 << 15  # bytes of text to an event row
ROWS_PER_BATCH = 256
MOST_BROADCAST = 1 << 20  # id pairs that are broadcast (16 bytes each); more are joined by a shuffle
DOC, A, B = 0, 1, 2  # kinds of event rows


class Side:
    """text -> (ids, byte lengths) of its tokens, or None where the tokens' bytes aren't those of a space and the text."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.sizes = np.array([len(p) for p in pieces], np.uint16)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        ids = self.encode(text)
        if b"".join(map(self.pieces.__getitem__, ids)) != b" " + text.encode("utf-8", "surrogatepass"):
            return None
        ids = np.array(ids, np.int32)
        return ids, self.sizes[ids]


@cache
def byte_bpe_side(path: str) -> Side:
    """A: a space and the text, by the byte-level ranks at path; special tokens' strings are plain text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    model = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda text: model.encode_ordinary(" " + text), sorted(ranks, key=ranks.get))


@cache
def piece_side(path: str) -> Side:
    """B: the text by a piece model, which puts the space before it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
    return Side(lambda text: model.encode(text, num_threads=1), pieces)


EVENT = "kind byte, range int, n int, ids binary, sizes binary"


def end_events(docs: DataFrame, sides) -> DataFrame:
    """docs(row, doc_id, text) -> (row, doc_id, kind, range, n, ids, sizes): for each document a row of kind DOC, and for
    each side and range of offsets in which its tokens end a row with n tokens' ids and byte lengths, in order, as few
    bytes wide as they fit.

    sides: a function that gives the worker's two Sides. Documents without tokens have their DOC row alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides()
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(begin, ROWS_PER_BATCH)
                owner, kinds, ranges, counts, ids, sizes = [], [], [], [], [], []
                for i, text in enumerate(part.column(2)):
                    text = text.as_py()
                    owner.append(i)
                    kinds.append(DOC)
                    ranges.append(-1)
                    counts.append(0)
                    ids.append(None)
                    sizes.append(None)
                    made = [side(text) for side in both] if text else [None]
                    if any(x is None for x in made):
                        continue
                    for kind, (tokens, lengths) in zip((A, B), made):
                        at = (np.cumsum(lengths, dtype=np.int64) - 1) // RANGE
                        cuts = np.flatnonzero(np.diff(at)) + 1
                        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                            owner.append(i)
                            kinds.append(kind)
                            ranges.append(int(at[lo]))
                            counts.append(hi - lo)
                            ids.append(tokens[lo:hi].astype("<u4" if tokens.max() >> 16 else "<u2").tobytes())
                            sizes.append(lengths[lo:hi].astype("<u2" if lengths.max() >> 8 else "<u1").tobytes())
                who = pa.array(owner, pa.int64())
                made = [pa.array(kinds, pa.int8()), pa.array(ranges, pa.int32()), pa.array(counts, pa.int32()), pa.array(ids, pa.binary()), pa.array(sizes, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who), *made], names=["row", "doc_id", "kind", "range", "n", "ids", "sizes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, {EVENT}")


class Sweep:
    """Takes one document's event rows in order of (range, kind) and gives closed groups.

    State: the tokens since the last offset at which both sides ended, and how far each side has come."""

    def __init__(self):
        self.ids = {A: np.empty(0, np.int32), B: np.empty(0, np.int32)}
        self.ends = {A: np.empty(0, np.int64), B: np.empty(0, np.int64)}
        self.at = {A: 0, B: 0}

    def take(self, kind: int, n: int, ids: bytes, sizes: bytes) -> None:
        lengths = np.frombuffer(sizes, f"<u{len(sizes) // n}")
        tokens = np.frombuffer(ids, f"<u{len(ids) // n}").astype(np.int32)
        ends = self.at[kind] + np.cumsum(lengths, dtype=np.int64)
        self.at[kind] = int(ends[-1])
        self.ids[kind] = np.concatenate([self.ids[kind], tokens])
        self.ends[kind] = np.concatenate([self.ends[kind], ends])

    def closed(self):
        """-> (A ids, B ids, A tokens of each group, B tokens of each group, links' A ids, links' B ids) up to the last
        common end so far, which are then forgotten; None if there is none."""
        a, b = self.ends[A], self.ends[B]
        met = np.concatenate([a, b])
        met.sort(kind="stable")  # merges the two runs
        new = np.ones(len(met), bool)
        np.not_equal(met[1:], met[:-1], out=new[1:])
        common = met[~new]
        if not len(common):
            return None
        ends = met[new]
        ends = ends[: np.searchsorted(ends, common[-1]) + 1]
        of_a, of_b = np.searchsorted(a, ends), np.searchsorted(b, ends)
        at = np.searchsorted(ends, common)
        na, nb = of_a[at] + 1, of_b[at] + 1  # tokens up to each common end
        ia, ib = self.ids[A], self.ids[B]
        made = ia[: na[-1]], ib[: nb[-1]], np.diff(na, prepend=0), np.diff(nb, prepend=0), ia[of_a], ib[of_b]
        for kind, n in ((A, na[-1]), (B, nb[-1])):
            self.ids[kind], self.ends[kind] = self.ids[kind][n:], self.ends[kind][n:]
        return made


PARTS = ("a_ids", "b_ids", "a_sizes", "b_sizes", "link_a", "link_b")
_INTS = T.ArrayType(T.IntegerType())


def align(events: DataFrame) -> DataFrame:
    """Event rows -> (row, doc_id, part, a_ids, b_ids, a_sizes, b_sizes, link_a, link_b): groups and links.

    Part 0 of a document holds nothing and stands for it even where it has no tokens; each further part holds a run of
    groups: their A and B tokens in order, how many of these each group has, and the ids of both tokens of each link."""
    kind = events.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("part", T.IntegerType()), *[T.StructField(c, _INTS) for c in PARTS]])


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sweep, part, out, held = None, None, 0, [], 0

        def batch_of(rows):
            rows_, ids_, parts_, *lists = zip(*rows)
            columns = [pa.array(rows_, pa.int64()), pa.array(ids_, arrow_id), pa.array(parts_, pa.int32())]
            for values in lists:
                offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32, copy=False))))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        nothing = [np.empty(0, np.int32)] * len(PARTS)
        for batch in batches:
            arrow_id = batch.column(1).type
            for row, doc_id, what, n, ids, sizes in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if row != now:
                    now, sweep, part = row, Sweep(), 0
                if what == DOC:
                    out.append((row, doc_id, 0, *nothing))
                    continue
                sweep.take(what, n, ids, sizes)
                made = sweep.closed() if what == B else None
                if made:
                    part += 1
                    out.append((row, doc_id, part, *made))
                    held += len(made[4])
                if held > 1 << 17 or len(out) >= 4 * ROWS_PER_BATCH:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    ordered = events.repartition("row").sortWithinPartitions("row", "range", "kind")
    return ordered.select("row", "doc_id", "kind", "n", "ids", "sizes").mapInArrow(run, schema)


@cache
def _written(size: int) -> list[np.ndarray]:
    """id -> its digits, followed by one of the separators."""
    return [np.array([b"%d%s" % (i, s) for i in range(size)], object) for s in (b",", b"|", b";")]


def group_text(a_ids, b_ids, a_sizes, b_sizes, written) -> bytes:
    """`a1,a2|b1;a3|b2;` of a run of groups."""
    sizes = a_sizes + b_sizes
    first = np.cumsum(sizes) - sizes
    out = np.empty(len(a_ids) + len(b_ids), object)
    for ids, n, before, end in ((a_ids, a_sizes, 0, 1), (b_ids, b_sizes, a_sizes, 2)):
        at = np.repeat(first + before - (np.cumsum(n) - n), n) + np.arange(len(ids))
        out[at] = written[0][ids]
        lasts = np.cumsum(n) - 1
        out[at[lasts]] = written[end][ids[lasts]]
    return b"".join(out)


def digests(aligned: DataFrame, ids: int) -> DataFrame:
    """align()'s rows, in their order -> (row, doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times): a row for each
    part with its distinct linked id pairs (a << 32 | b) and how often it links them; a document's last row has its
    counts and the digest, its other rows nulls. ids: a bound on both sides' ids."""
    kind = aligned.schema["doc_id"].dataType
    counts = ("n_a", "n_b", "n_groups")
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in counts], T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", _INTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, now = _written(ids), None  # now: the document's row, id, counts, hash, its last separator
        for batch in batches:
            arrow_id, out = batch.column(1).type, []
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in map(batch.column, range(3, 3 + len(PARTS)))]

            def ended():
                row, doc_id, n, digest, _ = now
                out.append((row, doc_id, *n, digest.hexdigest() if n[0] else "", (), ()))

            for i, (row, doc_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if now is None or row != now[0]:
                    if now is not None:
                        ended()
                    now = [row, doc_id, (0, 0, 0), hashlib.sha256(), b""]
                a, b, na, nb, la, lb = (v[o[i] : o[i + 1]] for o, v in lists)
                if not len(a):
                    continue
                text = group_text(a, b, na, nb, written)
                now[3].update(now[4])
                now[3].update(memoryview(text)[:-1])
                now[4] = text[-1:]
                now[2] = (now[2][0] + len(a), now[2][1] + len(b), now[2][2] + len(na))
                pairs, times = np.unique(la.astype(np.int64) << 32 | lb, return_counts=True)
                out.append((row, doc_id, None, None, None, None, pairs, times))
            yield _made(out, arrow_id)
        if now is not None:
            out = []
            ended()
            yield _made(out, arrow_id)

    def _made(rows, arrow_id):
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        made = [pa.array(columns[0], pa.int64()), pa.array(columns[1], arrow_id), *[pa.array(columns[i], pa.int64()) for i in (2, 3, 4)], pa.array(columns[5], pa.string())]
        for values, to in zip(columns[6:], (np.int64, np.int32)):
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            made.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, to), *values]).astype(to))))
        return pa.RecordBatch.from_arrays(made, names=schema.names)

    return aligned.mapInArrow(run, schema)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pairs, times) -> (pair, n, best): how many links hold a pair, and whether no pair of its B id has more."""
    each = parts.select(F.explode(F.arrays_zip("pairs", "times")).alias("z")).select(F.col("z.pairs").alias("pair"), F.col("z.times").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per row of docs.

    Null and empty texts, and such whose tokens don't spell a space and the text (those that hold U+2581), have zeros
    and an empty digest. Repeated rows and null ids are documents of their own; other columns are not read, whatever
    their names; an empty input gives an empty result. Texts of any length are swept in bounded memory, but for the
    text itself and its open group; links of an id pair that very many documents share are counted before they move.
    """

    def sides():
        return byte_bpe_side(a_path), piece_side(b_path)

    ids = max(len(s.pieces) for s in sides())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = materialize(digests(align(end_events(rows, sides)), ids), "align-parts")
    counts = materialize(pair_counts(parts), "align-pairs")
    total = counts.count()
    each = parts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    if total <= MOST_BROADCAST:
        told = each.join(F.broadcast(counts), "pair")
    else:
        links = counts.agg(F.sum("n")).first()[0]
        told = spread_join(each, counts, "pair", hot_keys(counts, "pair", links), F.col("row"))
    sums = told.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    found = parts.where("n_a is not null").join(sums, "row", "left")
    return found.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of every whole document's byte-level tokens with its pieces.

    Null, empty and unspellable texts have zeros; null ids and repeated rows are documents of their own; ties of an id's
    highest count all count; an empty table gives an empty result; other columns are not read.
    """
    import public_tokenizers

    return alignment_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
