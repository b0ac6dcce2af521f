"""Removal of long passages that stand elsewhere too, with a logarithmic family of sparse suffix arrays.

Windows of `length` bytes are what may repeat. Each window belongs to one suffix: the one that begins at the window's
anchor, the leftmost of the least hashes of K bytes among the first SPAN places of the window. Equal windows have their
anchors at the same place, so they belong to suffixes that are equal for at least `length` - SPAN + 1 bytes; and each
suffix owns a run of neighbouring windows, SPAN / 2 on average. So a sparse suffix array, one suffix for each run, finds
every repetition: none can hide between sampled positions.

A batch's array is its suffixes, dealt and sorted by the hash of their first bytes, in buckets that all arrays share. A
new array is merge-scanned against each level of the index and against itself, bucket by bucket and without a shuffle,
for suffixes equal in these bytes. Before a batch is added, levels of equal size are merged, so there are only as many
levels as the logarithm of the batches and each suffix is rewritten as often.

What a scan finds is settled on the bytes. Suffixes whose owned windows are equal as a whole (most of a copied passage)
need no more than that. Those that differ somewhere are compared window by window; a suffix start that very many
different texts share is compared by dealing out its windows instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hot_keys, materialize, quoted, shared_dir, spread_join, table, unfold, whole_row

LENGTH = 400
K = 16  # bytes whose hash makes an anchor
SPAN = 320  # places of a window's start among which its anchor is chosen
BLOCK = 1 << 20  # bytes hashed at once
BATCHES = 4
REMEMBERED = 1 << 18  # texts whose copies a task leaves out; more are harmless repetitions
CROWD = 1 << 15  # different contexts of one suffix start from which its windows are dealt out
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    h = a * _ODD[0]
    h ^= h >> np.uint64(29)
    h += b
    h *= _ODD[2]
    h ^= h >> np.uint64(32)
    return h


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes at every place as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)).astype(np.uint64)


def _sixteens(data: bytes) -> np.ndarray:
    e = _eights(data)
    return _mixed(e[:-8], e[8:])


def window_hashes(data: bytes, length: int) -> np.ndarray:
    """A hash of the `length` bytes (16 or more) at every place: doubled from 16 bytes, joined by the length's binary
    digits, and with the last 16 bytes where it is no multiple of 16."""
    least = h = _sixteens(data)
    size, out, done = 16, None, 0
    while True:
        if length & size:
            n = len(data) - done - size + 1
            out = h[:n].copy() if out is None else _mixed(out[:n], h[done : done + n])
            done += size
        if 2 * size > length:
            break
        h, size = _mixed(h[:-size], h[size:]), 2 * size
    n = max(0, len(data) - length + 1)
    return _mixed(out[:n], least[length - 16 : length - 16 + n]) if length % 16 else out[:n]


def owned_runs(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data: texts one after another, of which windows may begin in starts[i]..ends[i] (included) -> (anchor, first
    window, last window) of each suffix, in order."""
    key = (_sixteens(data) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data) - K + 1, dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        key, size = np.minimum(key[:-size], key[size:]), 2 * size
    if size < span:
        key = np.minimum(key[: -(span - size)], key[span - size :])
    owner = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends + 1, -1)
    inside = np.cumsum(inside)[: len(owner)] > 0
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    new[starts] = True
    first = np.flatnonzero(new & inside)
    last = np.minimum(np.append(first[1:] - 1, len(data)), ends[np.searchsorted(starts, first, side="right") - 1])
    return owner[first], first, last


def suffixes(texts: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """texts(t, t2, text) -> (key, whole, t, t2, at, n): a row for each suffix: the hash of its first bytes and of all
    bytes of the windows it owns, its text, and the place of the first of its n windows. Long texts are cut into blocks
    of windows; a run that a cut divides has other bytes than its copies and is compared window by window. A task gives
    the rows of equal texts once, as long as it remembers them."""
    head = length - span + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, seen = xxhash.xxh3_64_intdigest, set()
        for batch in batches:
            ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pieces, size = [], 0  # (text, where in it, bytes)

            def made() -> pa.RecordBatch:
                data = b"".join(p for _, _, p in pieces)
                sizes = np.array([len(p) for _, _, p in pieces])
                begins = np.cumsum(sizes) - sizes
                anchor, first, last = owned_runs(data, begins, begins + sizes - length, length, span)
                view = memoryview(data)
                keys = np.array([digest(view[p : p + head]) for p in anchor.tolist()], np.uint64).view(np.int64)
                wholes = np.array([digest(view[lo : hi + length]) for lo, hi in zip(first.tolist(), last.tolist())], np.uint64).view(np.int64)
                piece = np.searchsorted(begins, first, side="right") - 1
                owner = np.array([i for i, _, _ in pieces])[piece]
                at = first - begins[piece] + np.array([o for _, o, _ in pieces])[piece]
                t, t2 = (np.array(x, np.int64)[owner] for x in ids)
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, wholes, t, t2, at, (last - first + 1).astype(np.int32))], names=["key", "whole", "t", "t2", "at", "n"])

            for i, text in enumerate(batch.column(2)):
                if (one := (ids[0][i], ids[1][i])) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(one)
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for at in range(0, max(0, len(raw) - length + 1), BLOCK):
                    piece = raw[at : at + BLOCK + length - 1]
                    pieces.append((i, at, piece))
                    size += len(piece)
                    if size >= BLOCK:
                        yield made()
                        pieces, size = [], 0
            if pieces:
                yield made()

    return texts.select("t", "t2", "text").mapInArrow(run, "key long, whole long, t long, t2 long, at long, n int")


class SuffixIndex:
    """Levels of sorted suffixes, each as large as a power of two of batches, in buckets of the suffixes' keys."""

    def __init__(self, spark, length: int = LENGTH, span: int = SPAN):
        self.spark, self.length, self.span = spark, length, span
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, DataFrame]] = []

    def _sorted(self, rows: DataFrame) -> DataFrame:
        name = f"suffixes_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        made = self.spark.table(name)
        made.written_at, made.named = path, name
        return made

    def _forget(self, *arrays: DataFrame) -> None:
        for a in arrays:
            self.spark.sql(f"DROP TABLE {a.named}")
        forget(*arrays)

    def add(self, texts: DataFrame) -> DataFrame:
        """Add texts(t, t2, text) -> the rows of suffixes, new and old, whose first bytes a new suffix shares."""
        self.levels.sort(key=lambda x: -x[0])
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, self._sorted(a.union(b))))
            self._forget(a, b)
        new = self._sorted(suffixes(texts, self.length, self.span))
        found = [new.join(new.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")]
        keys = new.select("key").distinct()
        for _, level in self.levels:
            found += [level.join(keys, "key", "left_semi"), new.join(level.select("key").distinct(), "key", "left_semi")]
        self.levels.append((1, new))
        met = found[0]
        for some in found[1:]:
            met = met.union(some)
        return materialize(met, "suffix-matches")

    def close(self) -> None:
        """Delete all levels."""
        self._forget(*[level for _, level in self.levels])
        self.levels = []


def _contexts(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """wanted(t, t2, key, at, n, alone) with texts(t, t2, text), each text once -> with the bytes of its windows."""
    listed = wanted.groupBy("t", "t2").agg(F.collect_list(F.struct("key", "at", "n", "alone")).alias("wanted"))
    joined = texts.join(listed, ["t", "t2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, t2, text, some in zip(*(batch.column(i) for i in range(4))):
                raw, some = text.as_py().encode("utf-8", "surrogatepass"), some.as_py()
                for b in range(0, len(some), 1024):
                    part = some[b : b + 1024]
                    cut = [raw[w["at"] : w["at"] + w["n"] - 1 + length] for w in part]
                    columns = [pa.array([t.as_py()] * len(part)), pa.array([t2.as_py()] * len(part)), *[pa.array([w[c] for w in part], kind) for c, kind in (("key", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("alone", pa.bool_()))]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], names=["t", "t2", "key", "at", "n", "alone", "bytes"])

    return joined.select("t", "t2", "text", "wanted").mapInArrow(run, "t long, t2 long, key long, at long, n int, alone boolean, bytes binary")


def _windows(sizes: np.ndarray, counts: np.ndarray, data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts one after another -> (context, place in it, hash) of every window."""
    begins = np.cumsum(sizes) - sizes
    who = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
    return who, place, window_hashes(data, length)[begins[who] + place]


def _runs(who: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in order -> (context, first place, number) of each run of neighbours."""
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    return who[at], place[at], np.diff(np.append(at, len(who)))


SPANS = "t long, t2 long, at long, n long"


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts, dealt and sorted by key -> (t, t2, at, n): runs of windows that an `alone` context shares with another
    one of its key. At least BLOCK bytes and all of the contexts of a key are compared at once."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        t, t2, key, at, n, alone, data = zip(*rows)
        who, place, h = _windows(np.array([len(d) for d in data]), np.array(n), b"".join(data), length)
        group = np.cumsum(np.append(0, np.diff(np.array(key)) != 0))
        h = _mixed(h, group[who].astype(np.uint64))
        order = np.argsort(h)
        twin = np.zeros(len(h), bool)
        same = h[order][1:] == h[order][:-1]
        twin[order[1:][same]] = twin[order[:-1][same]] = True
        twin &= np.array(alone)[who]
        who, place, count = _runs(who[twin], place[twin])
        made = [np.array(t, np.int64)[who], np.array(t2, np.int64)[who], np.array(at, np.int64)[who] + place, count.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["t", "t2", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if size >= BLOCK and row[2] != held[-1][2]:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield spans(held)

    dealt = contexts.repartition("key").sortWithinPartitions("key")
    return dealt.select("t", "t2", "key", "at", "n", "alone", "bytes").mapInArrow(run, SPANS)


def _dealt_out(contexts: DataFrame, length: int) -> DataFrame:
    """The same for keys of very many contexts: one row for each window, shuffled by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                data = part.column(6).to_pylist()
                who, place, h = _windows(np.array([len(d) for d in data]), part.column(4).to_numpy(), b"".join(data), length)
                key, at = part.column(2).to_numpy()[who], part.column(3).to_numpy()[who] + place
                h = _mixed(h, key.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who)), pa.array(h), pa.array(at), part.column(5).take(pa.array(who))], names=["t", "t2", "h", "at", "alone"])

    each = contexts.select("t", "t2", "key", "at", "n", "alone", "bytes").mapInArrow(run, "t long, t2 long, h long, at long, alone boolean")
    each = materialize(each, "suffix-windows")
    twins = materialize(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "suffix-twins")
    hot = hot_keys(twins, "h", max(1, each.count()))
    met = spread_join(each.where("alone"), twins.select("h"), "h", hot, F.xxhash64("t", "at"))
    return met.select("t", "t2", "at", F.lit(1).cast("long").alias("n"))


def repeated_windows(matches: DataFrame, texts: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """Rows of suffixes, complete for each key, and texts(t, t2, text), each text once -> (t, t2, at, n): the windows,
    n of them from `at` on, that also stand anywhere else."""
    groups = materialize(matches.groupBy("key", "whole").agg(F.count("*").alias("rows"), F.min(F.struct("t", "t2", "at", "n")).alias("one")), "suffix-groups")
    total = groups.agg(F.sum("rows")).first()[0] or 0
    both = F.struct("key", "whole").alias("both")
    several = groups.where("rows > 1").select(both, F.col("rows").alias("n"))
    equal = spread_join(matches.select("*", both), several.select("both"), "both", hot_keys(several, "both", total), F.xxhash64("t", "at"))
    hot = hot_keys(groups.groupBy("key").agg(F.count("*").alias("n")), "key", groups.count())
    kinds = groups.groupBy("key").agg(F.count("*").alias("kinds"), F.min("rows").alias("least")).where("kinds > 1 AND least = 1")
    wanted = spread_join(groups, kinds.select("key", "kinds"), "key", hot, F.xxhash64("whole"))
    wanted = wanted.select("one.*", "key", (F.col("rows") == 1).alias("alone"), (F.col("kinds") > crowd).alias("crowded"))
    wanted = materialize(wanted, "suffix-wanted")
    crowds = wanted.where("crowded").select("key").distinct()
    contexts = _contexts(wanted, texts, length)
    spans = equal.select("t", "t2", "at", F.col("n").cast("long").alias("n"))
    if crowds.isEmpty():
        return spans.union(_compared(contexts, length))
    contexts = materialize(contexts, "suffix-contexts")
    return spans.union(_compared(contexts.join(crowds, "key", "left_anti"), length)).union(_dealt_out(contexts.join(crowds, "key", "left_semi"), length))


def _settled(length: int):
    """(bytes, windows, in copies) -> what is kept and the spans that aren't."""

    @F.arrow_udf("kept binary, spans array<struct<start: long, end: long>>")
    def settle(data: pa.Array, windows: pa.Array, copied: pa.Array) -> pa.Array:
        kept, spans = [], []
        for raw, found, whole in zip(data, windows, copied):
            raw = raw.as_py() or b""
            runs = sorted((w["at"], w["at"] + w["n"] - 1 + length) for w in found.as_py() or ())
            if whole.as_py() and len(raw) >= length:
                runs = [(0, len(raw))]
            joined: list[list[int]] = []
            for lo, hi in runs:
                if joined and lo <= joined[-1][1]:
                    joined[-1][1] = max(hi, joined[-1][1])
                else:
                    joined.append([lo, hi])
            ends = [0, *(hi for _, hi in joined)]
            kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*(lo for lo, _ in joined), len(raw)])) if joined else raw)
            spans.append([{"start": lo, "end": hi} for lo, hi in joined])
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(spans, kinds)], names=["kept", "spans"])

    return settle


def drop_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, span: int = SPAN, batches: int = BATCHES, crowd: int = CROWD) -> DataFrame:
    """docs with n_bytes, kept (binary) and spans (array of start, end) in place of text_col: each text's bytes without
    those of any `length` bytes that also stand anywhere else, in the same text too, and what was taken.

    The texts are added to an index in `batches` parts by their hash, all of them together being all texts. A null text
    is empty; texts shorter than `length` lose nothing; copies of a text lose all. Repeated rows, null ids and other
    columns stay, whatever their names, but columns of the three names are replaced. An empty input gives an empty
    result. Texts of any length are read whole, BLOCK bytes at a time.
    """
    spark, text = docs.sparkSession, F.col(text_col)
    others = docs.drop(text_col)
    keyed = docs.select(whole_row(others).alias("row"), text.alias("text"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("t2"))
    long = keyed.where(F.octet_length("text") >= length).select("t", "t2", "text")
    index, met = SuffixIndex(spark, length, span), []
    for b in range(batches):
        met.append(index.add(long.where(F.pmod("t", F.lit(batches)) == b)))
    index.close()
    matches = met[0]
    for some in met[1:]:
        matches = matches.union(some)
    matches = materialize(matches.distinct(), "suffix-matches")
    forget(*met)
    texts = long.groupBy("t", "t2").agg(F.first("text").alias("text"))
    windows = repeated_windows(matches, texts, length, crowd)
    windows = materialize(windows.groupBy("t", "t2").agg(F.collect_list(F.struct("at", "n")).alias("windows")), "suffix-spans")
    forget(matches)
    copies = materialize(keyed.groupBy("t", "t2").agg(F.count("*").alias("n")).where("n > 1"), "suffix-copies")
    known = windows.join(copies.select("t", "t2", F.lit(True).alias("copied")), ["t", "t2"], "full")
    known = known.groupBy("t").agg(F.collect_list(F.struct(F.col("t2").alias("other"), "windows", F.coalesce("copied", F.lit(False)).alias("copied"))).alias("known"))
    joined = spread_join(keyed, known, "t", hot_keys(copies, "t", keyed.count()), F.monotonically_increasing_id(), "left")
    one = F.try_element_at(F.filter("known", lambda x: x["other"] == F.col("t2")), F.lit(1))
    told = joined.select("row", F.col("text").cast("binary").alias("data"), one.alias("one"))
    told = told.select("row", "data", _settled(length)("data", F.col("one")["windows"], F.coalesce(F.col("one")["copied"], F.lit(False))).alias("made"))
    made = {"n_bytes": F.coalesce(F.octet_length("data"), F.lit(0)).cast("long"), "kept": F.col("made")["kept"], "spans": F.col("made")["spans"]}
    return unfold(told, "row", others.schema, made).select(*quoted(others.drop(*made)), *made)


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every whole document without the bytes of any 400 bytes that also stand elsewhere.

    A null text is empty; empty and short texts lose nothing; repeated rows and copies lose all, whatever their ids;
    null ids stay; an empty table gives an empty result; other columns are not read.
    """
    found = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
