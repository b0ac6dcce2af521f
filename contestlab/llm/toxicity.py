"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A token's input is its word's vector beside the mean of the vectors of its distinct character n-grams, so that new or disguised
words are read by their spelling; tokens of any length are read whole. Windows of WINDOW tokens overlap by half and cover the whole text; in each, two
gated recurrent layers run in opposite directions, attention pools their states, and one unit makes the logit. A
document's logit is that of its most toxic window, calibrated.

Labels mark documents, not windows, so training alternates: the present model picks the windows that speak most for
each labelled document's label, and these train the next model. The first picks are made by log-odds of words and
n-grams over the labelled sample, which also start the vectors' first components. The sample holds at most
DOCS_PER_CLASS labelled documents of either class, chosen by a hash of the id, and sends the driver at most
WINDOWS_PER_DOC windows of each; scoring covers every window of every document and every character of its tokens.
"""

from __future__ import annotations

import copy
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import blank, materialize, table

DOCS_PER_CLASS = 4000
WINDOWS_PER_DOC = 4
WINDOW, STEP = 32, 16
FEATURES = 24_000  # words and n-grams with vectors of their own: those of the greatest log-odds
LEAST_DOCS = 3  # of the sample, in which one of them must occur
GRAM = 5
LONG = 256  # characters from which a token is remembered by its digest
DIM, HIDDEN = 6, 8
ROUNDS, EPOCHS, BATCH, RATE = 2, 4, 128, 0.02
CHUNK = 2048  # windows run at once
CACHE_ENTRIES = 150_000
EDGES = ".,;:!?\"'()[]{}<>|*#$%&@~_-+=/\\"


def features(token: str) -> list[str]:
    """The word, marked, and its character n-grams with the word's ends."""
    word = token.strip(EDGES)
    if not word:
        return []
    bounded = f" {word} "
    return ["=" + word, *(bounded[i : i + GRAM] for i in range(max(1, len(bounded) - GRAM + 1)))]


def starts(n: int) -> list[int]:
    """Where windows begin in a text of n tokens: every STEP, until one reaches the end."""
    return list(range(0, max(1, n - WINDOW + STEP), STEP))


def tokens_of(text: str) -> list[str]:
    return text.lower().split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


class Network:
    """Vectors, two gated recurrent layers, attention and output, with their gradients and Adam's moments."""

    def __init__(self, vocabulary: dict[str, int], odds: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        size = lambda *s: rng.standard_normal(s) * (0.5 / np.sqrt(s[0]))
        vectors = rng.standard_normal((len(odds) + 1, DIM)) * 0.05
        vectors[1:, 0] = odds / 2
        vectors[0] = 0
        self.p = {"e": vectors, "a": size(2 * HIDDEN, 1), "o": size(2 * HIDDEN, 1), "c": np.zeros(1)}
        for side in "fb":
            self.p |= {"w" + side: size(2 * DIM, 3 * HIDDEN), "u" + side: size(HIDDEN, 3 * HIDDEN), "d" + side: np.zeros(3 * HIDDEN)}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0
        self.slope, self.shift = 1.0, 0.0

    def rows(self, token: str) -> list[int]:
        """Numbers of the token's word (0: unknown) and of its distinct known n-grams, fewer than the vocabulary has."""
        found = features(token)
        if not found:
            return [0]
        get = self.vocabulary.get
        return [get(found[0], 0), *sorted(set(filter(None, map(get, found[1:]))))]

    def vectors(self, rows: list[list[int]]) -> np.ndarray:
        """The input of each token."""
        e = self.p["e"]
        words = e[[r[0] for r in rows]]
        counts = np.array([len(r) - 1 for r in rows])
        flat = np.array([i for r in rows for i in r[1:]], np.int64)
        sums = np.zeros((len(rows), DIM))
        if len(flat):
            np.add.at(sums, np.repeat(np.arange(len(rows)), counts), e[flat])
        return np.concatenate([words, sums / np.maximum(counts, 1)[:, None]], axis=1)

    def run(self, inputs: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Logits of windows from each direction's projected inputs (windows, WINDOW, 3 HIDDEN) and their mask."""
        n = len(mask)
        states, tape = [], {}
        for side in "fb":
            h = np.zeros((n, HIDDEN), inputs[side].dtype)
            u = self.p["u" + side].astype(h.dtype)
            out = np.empty((n, WINDOW, HIDDEN), h.dtype)
            steps = []
            for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
                x = inputs[side][:, t]
                hu = h @ u
                z, r = sigmoid(x[:, :HIDDEN] + hu[:, :HIDDEN]), sigmoid(x[:, HIDDEN : 2 * HIDDEN] + hu[:, HIDDEN : 2 * HIDDEN])
                g = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                on = mask[:, t, None]
                new = np.where(on, h + z * (g - h), h)
                if keep:
                    steps.append((t, h, hu, z, r, g))
                h = new
                out[:, t] = h
            states.append(out)
            tape[side] = steps
        both = np.concatenate(states, axis=2)
        energy = np.where(mask, (both @ self.p["a"].astype(both.dtype))[..., 0], -1e9)
        energy = np.exp(energy - energy.max(axis=1, keepdims=True)) * mask
        weight = energy / np.maximum(energy.sum(axis=1, keepdims=True), 1e-12)
        pooled = np.einsum("nt,nth->nh", weight, both)
        logit = (pooled @ self.p["o"].astype(both.dtype))[:, 0] + self.p["c"][0]
        return (logit, both, weight, pooled, tape) if keep else logit

    def learn(self, window_rows: list[list[list[int]]], labels: np.ndarray, importance: np.ndarray) -> None:
        """One step of Adam on weighted cross-entropy."""
        n = len(window_rows)
        mask = np.array([[t < len(w) for t in range(WINDOW)] for w in window_rows])
        flat = [r for w in window_rows for r in w]
        vec = self.vectors(flat)
        x = np.zeros((n, WINDOW, 2 * DIM))
        x[mask] = vec
        inputs = {s: x @ self.p["w" + s] + self.p["d" + s] for s in "fb"}
        logit, both, weight, pooled, tape = self.run(inputs, mask, keep=True)
        d = (sigmoid(logit) - labels) * importance / importance.sum()
        grads = {"o": pooled.T @ d[:, None], "c": np.array([d.sum()])}
        d_pooled = d[:, None] * self.p["o"][:, 0]
        d_both = weight[..., None] * d_pooled[:, None]
        d_weight = np.einsum("nth,nh->nt", both, d_pooled)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        grads["a"] = np.einsum("nth,nt->h", both, d_energy)[:, None]
        d_both += d_energy[..., None] * self.p["a"][:, 0]
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u, w = self.p["u" + side], self.p["w" + side]
            d_in = np.zeros((n, WINDOW, 3 * HIDDEN))
            d_u = np.zeros_like(u)
            d_h = np.zeros((n, HIDDEN))
            for t, h, hu, z, r, g in reversed(tape[side]):
                d_h = d_h + d_both[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                on = mask[:, t, None]
                d_new = np.where(on, d_h, 0)
                d_g = d_new * z * (1 - g * g)
                d_z = d_new * (g - h) * z * (1 - z)
                d_r = d_g * hu[:, 2 * HIDDEN :] * r * (1 - r)
                d_in[:, t] = np.concatenate([d_z, d_r, d_g], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_g * r], axis=1)
                d_u += h.T @ d_hu
                d_h = np.where(on, d_new * (1 - z), d_h) + d_hu @ u.T
            grads["u" + side] = d_u
            grads["d" + side] = d_in.sum(axis=(0, 1))
            grads["w" + side] = np.einsum("nti,ntj->ij", x, d_in)
            d_x += d_in @ w.T
        d_vec = d_x[mask]
        e = np.zeros_like(self.p["e"])
        np.add.at(e, [r[0] for r in flat], d_vec[:, :DIM])
        counts = np.array([len(r) - 1 for r in flat])
        rows = np.array([i for r in flat for i in r[1:]], np.int64)
        if len(rows):
            np.add.at(e, rows, np.repeat(d_vec[:, DIM:] / np.maximum(counts, 1)[:, None], counts, axis=0))
        e[0] = 0
        grads["e"] = e
        self.t += 1
        for key, grad in grads.items():
            self.m[key] = 0.9 * self.m[key] + 0.1 * grad
            self.v[key] = 0.999 * self.v[key] + 0.001 * grad * grad
            rate = RATE * (0.2 if key == "e" else 1.0)
            self.p[key] = self.p[key] - rate * (self.m[key] / (1 - 0.9**self.t)) / (np.sqrt(self.v[key] / (1 - 0.999**self.t)) + 1e-8)

    def frozen(self) -> Scorer:
        """A scorer of this state, without what only training needs."""
        now = copy.copy(self)
        now.p, now.m, now.v = dict(self.p), {}, {}
        return Scorer(now)


class Scorer:
    """A trained network for whole texts: remembers tokens' projected inputs."""

    def __init__(self, network: Network):
        self.net = network
        self.known: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.known[""] = 0
        self.table = {s: np.zeros((1024, 3 * HIDDEN), np.float32) for s in "fb"}

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """Rows of the tokens' inputs in the table; row 0 stands for no token."""
        known = self.known
        keys = [t if len(t) < LONG else hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() + "\n" for t in tokens]
        each = dict(zip(keys, tokens))
        new = [k for k in each if k not in known]
        if len(known) + len(new) > CACHE_ENTRIES and len(known) > 1:
            self.clear()
            known, new = self.known, list(each)
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            vec = self.net.vectors([self.net.rows(each[k]) for k in some])
            first = len(known)
            for side in "fb":
                made = (vec @ self.net.p["w" + side] + self.net.p["d" + side]).astype(np.float32)
                have = self.table[side]
                if first + len(some) > len(have):
                    grown = np.zeros((max(2 * len(have), first + len(some)), 3 * HIDDEN), np.float32)
                    grown[:first] = have[:first]
                    self.table[side] = have = grown
                have[first : first + len(some)] = made
            known.update(zip(some, range(first, first + len(some))))
        return np.fromiter(map(known.__getitem__, keys), np.int32, len(keys))

    def windows(self, index: np.ndarray) -> np.ndarray:
        """Logits of windows given as table rows (0 past the end)."""
        out = np.empty(len(index), np.float64)
        for at in range(0, len(index), CHUNK):
            part = index[at : at + CHUNK]
            out[at : at + CHUNK] = self.net.run({s: self.table[s][part] for s in "fb"}, part > 0)
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the largest logit of its windows (nan if it has no token), where it begins, and how many
        windows there are. Windows of many short texts run together; a long text runs in parts."""
        best, where, count = np.full(len(texts), np.nan), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        held, owner, place = [], [], []

        def flush() -> None:
            if held:
                logits = self.windows(np.stack(held))
                for i, s, x in zip(owner, place, logits.tolist()):
                    if not best[i] >= x:
                        best[i], where[i] = x, s
                held.clear(), owner.clear(), place.clear()

        for i, text in enumerate(texts):
            tokens = tokens_of(text)
            count[i] = len(starts(len(tokens))) if tokens else 0
            for at in range(0, len(tokens), STEP * CHUNK):
                # A part has its last window's tokens beyond its last start.
                part = tokens[at : at + STEP * CHUNK + WINDOW - STEP]
                if at and len(part) <= WINDOW - STEP:
                    break
                if len(self.known) + len(part) > CACHE_ENTRIES:
                    flush()
                row = self.numbers(part)
                begins = starts(len(row))
                padded = np.zeros(begins[-1] + WINDOW, np.int32)
                padded[: len(row)] = row
                held += [padded[s : s + WINDOW] for s in begins]
                owner += [i] * len(begins)
                place += [at + s for s in begins]
                if len(held) >= CHUNK:
                    flush()
        flush()
        return best, where, count


def log_odds(counts: DataFrame, toxic: int, clean: int) -> tuple[dict[str, int], np.ndarray]:
    """counts(feature, toxic, clean) in documents -> numbers from 1 and shrunk log-odds of the most telling ones."""
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    shrunk = odds * (F.col("toxic") + F.col("clean")) / (F.col("toxic") + F.col("clean") + 4.0)
    best = counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCS).withColumn("z", shrunk)
    found = best.orderBy(F.desc(F.abs("z")), "feature").limit(FEATURES).select("feature", "z").toPandas()
    return {f: i + 1 for i, f in enumerate(found["feature"])}, np.clip(found["z"].to_numpy(float), -4, 4)


def sample_documents(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, training: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of at most per_class labelled training documents of either class, and how many of each there are.

    A document with several labels is toxic if one of them says so."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic")).where(training)
    known = materialize(known, "toxicity-labels")
    totals = {int(r["toxic"] > 0): r["count"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    few = [known.where((F.col("toxic") > 0) == F.lit(bool(c))).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for c in (0, 1)]
    picked = few[0].union(few[1])  # at most 2 * per_class ids
    found = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(picked), id_col)
    return materialize(found.select(blank(F.col("text")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic")), "toxicity-sample"), totals


def fit(sample: DataFrame, totals: dict[int, int], seed: int = 3) -> Network | None:
    """A network for sample(text, toxic); None if a class is missing."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found = sorted({f for t in set(tokens_of(text.as_py())) for f in features(t)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["feature", "toxic"])

    spelled = sample.mapInArrow(spell, "feature string, toxic int")
    counts = spelled.groupBy("feature").agg(F.sum("toxic").cast("long").alias("toxic"), F.sum(1 - F.col("toxic")).cast("long").alias("clean"))
    vocabulary, odds = log_odds(counts, sizes[1], sizes[0])
    net = Network(vocabulary, odds, seed)
    rng = np.random.default_rng(seed)
    for turn in range(ROUNDS):
        scorer = net.frozen()
        weights = odds

        def pick(batches: Iterator[pa.RecordBatch], turn=turn, scorer=scorer) -> Iterator[pa.RecordBatch]:
            """Half of a document's windows are those that speak most for toxicity, the others are spread by a hash."""
            for batch in batches:
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    tokens = tokens_of(text)
                    if not tokens:
                        continue
                    begins = np.array(starts(len(tokens)))
                    if turn:
                        row = scorer.numbers(tokens)
                        padded = np.zeros(begins[-1] + WINDOW, np.int32)
                        padded[: len(row)] = row
                        speak = scorer.windows(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begins])
                    else:
                        each = {t: max((weights[r - 1] for r in scorer.net.rows(t) if r), default=0.0) for t in set(tokens)}
                        value = np.array([each[t] for t in tokens])
                        speak = np.array([value[s : s + WINDOW].max() for s in begins])
                    order = np.argsort(-speak, kind="stable")
                    top = order[:1] if toxic else order[: WINDOWS_PER_DOC // 2]
                    rest = order[len(top) :]
                    mixed = sorted(rest.tolist(), key=lambda k: zlib.crc32(f"{k}:{len(tokens)}".encode()))
                    others = [] if toxic else mixed[: WINDOWS_PER_DOC - len(top)]
                    chosen = [*top.tolist(), *others]
                    made = [[scorer.net.rows(t) for t in tokens[begins[k] : begins[k] + WINDOW]] for k in chosen]
                    kind = pa.list_(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(made, kind), pa.array([toxic] * len(chosen), pa.int32())], names=["window", "toxic"])

        # A token's numbers are kept once, however many windows hold it.
        cache: dict[tuple[int, ...], list[int]] = {}
        got = []
        for batch in sample.mapInArrow(pick, "window array<array<int>>, toxic int").toArrow().to_batches(1024):
            for window, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got.append(([cache.setdefault(tuple(r), r) for r in window], toxic))
        got.sort()
        rows = [w for w, _ in got]
        labels = np.array([t for _, t in got], float)
        balance = Counter(labels.tolist())
        importance = np.where(labels > 0, balance[0.0] / max(1, balance[1.0]), 1.0) ** 0.5
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                net.learn([rows[i] for i in some], labels[some], importance[some])
    calibrate(net, sample, totals, sizes)
    return net


def calibrate(net: Network, sample: DataFrame, totals: dict[int, int], sizes: dict[int, int]) -> None:
    """A logistic curve from the largest logit to the label, every class at its true share; one number per sampled
    document reaches the driver."""
    scorer = net.frozen()

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, _, _ = scorer.texts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(best), batch.column(1)], names=["logit", "toxic"])

    found = sample.mapInArrow(logits, "logit double, toxic int").toPandas().dropna().sort_values(["logit", "toxic"])
    if found["toxic"].nunique() < 2:
        return
    x, y = found["logit"].to_numpy(), found["toxic"].to_numpy(float)
    w = np.where(y > 0, totals.get(1, 0) / sizes[1], totals.get(0, 0) / sizes[0])
    w = w / w.sum() * len(w)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        g = np.array([(w * (p - y) * x).sum() + 0.1 * (a - 1), (w * (p - y)).sum() + 0.01 * b])
        s = w * p * (1 - p)
        hessian = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]])
        step = np.linalg.solve(hessian, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    if a > 0:
        net.slope, net.shift = float(a), float(b)


def score_documents(docs: DataFrame, net: Network | None, prior: float = 0.0, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1), worst_start (the first token of the most toxic window) and n_windows.

    A null, empty or blank text has no window, score `prior` and worst_start null; without a network every score is
    `prior`. Texts of any length are scored whole. Repeated rows and null ids stay rows, equal texts score alike;
    other columns are kept, but columns of the three names are replaced. An empty input gives an empty result.
    """
    made = ("score", "worst_start", "n_windows")
    others = [c for c in docs.columns if c.lower() not in made]
    at = others.index(text_col)
    scorer = net.frozen() if net else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            if scorer:
                best, where, count = scorer.texts(texts)
                score = np.where(np.isnan(best), prior, sigmoid(net.slope * np.nan_to_num(best) + net.shift))
            else:
                count = np.array([len(starts(len(t))) if t else 0 for t in map(tokens_of, texts)], np.int64)
                score, where = np.full(len(texts), prior), np.zeros(len(texts), np.int64)
            begin = pa.array([int(w) if n and scorer else None for w, n in zip(where, count)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), begin, pa.array(count)], names=[*plain, *made])

    plain = [f"c{i}" for i in range(len(others))]
    rows = docs.drop(*[c for c in docs.columns if c.lower() in made]).toDF(*plain)
    scored = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("worst_start", LongType()), StructField("n_windows", LongType())]))
    return scored.toDF(*others, *made)


def held_out_fifth(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, divisible by five; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Column | None = None, per_class: int = DOCS_PER_CLASS) -> DataFrame:
    """docs with score, worst_start and n_windows by a network fitted on the labelled rows where `training` holds."""
    chosen = F.lit(True) if training is None else training
    sample, totals = sample_documents(docs, labels, id_col, text_col, chosen, per_class)
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 10.0)
    return score_documents(docs, fit(sample, totals), prior, text_col)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four fifths of the labels.

    Null, empty and blank texts have the prior's score; texts of any length are scored whole; equal texts score alike;
    repeated rows and null ids stay rows; an empty table gives an empty result; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"), training=~held_out_fifth())
    return scored.select("doc_id", held_out_fifth().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "n_windows")
