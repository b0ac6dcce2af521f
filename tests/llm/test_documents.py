"""Operators on documents: odd rows, empty tables, clashing names, and brute force."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contestlab.llm import language_model, line_dedup, mixing, near_copies, packing, sharding, simhash, token_counts, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_token_counts_equal_the_unigram_tokenizer(docs, odd):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = token_counts.vocabulary_path()
    pieces, fallback = token_counts.unigram_pieces(path)
    least = min(s for _, s in pieces)
    exact = Tokenizer(models.Unigram([("<unk>", least), *((f"<0x{i:02X}>", least) for i in range(256)), *pieces], unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = token_counts.token_counts(docs.select("doc_id", "text").union(odd.select("doc_id", "text")).withColumn("n_tokens", F.lit("clash")).withColumn("copy", F.col("text")), path).collect()
    assert fallback and len(rows) == docs.count() + odd.count()
    assert [r["n_tokens"] for r in rows] == [len(exact.encode(r["copy"] or "", add_special_tokens=False).ids) for r in rows]


def test_token_count_ties_and_unknown_runs():
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = np.random.default_rng(4)
    for fuse in range(40):
        pieces = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("bab", -3.0), ("aa", -2.0)][: rng.integers(3, 8)]
        exact = Tokenizer(models.Unigram([("<unk>", -3.0), *pieces], unk_id=0))
        exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        count = token_counts.Counter(pieces, False)
        for _ in range(50):
            text = "".join(rng.choice(list("aabbx "), rng.integers(0, 14)))
            assert count(text)[0] == len(exact.encode(text).ids), text


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    net = toxicity.Network({f: i + 1 for i, f in enumerate("abcdef")}, rng.standard_normal(6))
    windows = [[[1, 2, 3], [0], [4, 5]], [[2, 6]], [[0, 1]] * 5]
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        mask = np.array([[t < len(w) for t in range(toxicity.WINDOW)] for w in windows])
        x = np.zeros((3, toxicity.WINDOW, 2 * toxicity.DIM))
        x[mask] = net.vectors([r for w in windows for r in w])
        z = net.run({s: x @ net.p["w" + s] + net.p["d" + s] for s in "fb"}, mask)
        return float((weight * (np.log1p(np.exp(z)) - labels * z)).sum() / weight.sum())

    before = {k: v.copy() for k, v in net.p.items()}
    net.learn(windows, labels, weight)
    grads = {k: m / 0.1 for k, m in net.m.items()}
    net.p = before
    for key, g in grads.items():
        for at in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(4)]:
            if key == "e" and at[0] == 0:
                continue
            keep = net.p[key][at]
            net.p[key][at] = keep + 1e-5
            up = loss()
            net.p[key][at] = keep - 1e-5
            down = loss()
            net.p[key][at] = keep
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_toxicity_learns_and_scores_every_window(spark, odd, none):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(words, rng.integers(20, 200)))
        if i % 4 == 0:
            text[rng.integers(0, len(text))] = ["rotten", "vile"][i % 8 // 4]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs.withColumn("score", F.lit("clash")), marks, training=F.col("doc_id") < 300).collect()}
    assert np.mean([(got[i]["score"] >= 0.5) == (i % 4 == 0) for i in range(300, 400)]) > 0.9
    assert all(got[i]["n_windows"] == len(toxicity.starts(len(rows[i][1].split()))) for i in got)
    scored = toxicity.toxicity(odd, marks.limit(0)).collect()  # nothing to learn from
    assert len(scored) == odd.count() and len({r["score"] for r in scored}) == 1
    assert toxicity.toxicity(none, marks, training=F.lit(True)).count() == 0


def test_a_long_text_scores_as_its_windows_do():
    net = toxicity.Network({f: i + 1 for i, f in enumerate(["=bad", " bad "])}, np.array([4.0, 4.0]))
    tokens = (["fine"] * 70_000) + ["bad"] + ["fine"] * 5000
    best, where, count = net.frozen().texts([" ".join(tokens), "", "fine"])
    begins = toxicity.starts(len(tokens))
    scorer = net.frozen()
    row = scorer.numbers(tokens)
    padded = np.zeros(begins[-1] + toxicity.WINDOW, np.int32)
    padded[: len(row)] = row
    logits = scorer.windows(np.stack([padded[s : s + toxicity.WINDOW] for s in begins]))
    assert count.tolist() == [len(begins), 0, 1] and best[0] == pytest.approx(logits.max(), abs=1e-5)
    assert logits[begins.index(where[0])] == pytest.approx(logits.max(), abs=1e-5) and np.isnan(best[1])


def test_mix_comes_near_its_targets(docs, odd, none):
    rows = mixing.copies_to_target(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size")).withColumn("copies", F.lit("clash"))).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    size = sum(r["size"] for r in rows)
    assert sum(target.values()) == pytest.approx(1.5 * size)
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(none).count() == 0


def test_shards_are_exact_and_gapless(odd, none, spark):
    rows = sharding.shuffle_shards(spark.range(10_007).withColumn("shard", F.lit("clash")), 16).collect()
    by = Counter(r["shard"] for r in rows)
    assert len({r["id"] for r in rows}) == 10_007 and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in by.items())
    assert sharding.shuffle_shards(odd).count() == odd.count() and sharding.shuffle_shards(none).count() == 0


def test_the_final_permutation_is_uniform(spark):
    """Places of neighbouring rows under many seeds: every shard and every half of a shard equally often, and pairs apart."""
    n, shards, runs = 960, 4, 3
    places, together = np.zeros((shards, 2)), 0
    for seed in range(runs):
        rows = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_shards(spark.range(n), shards, seed=seed * 7919 + 1).collect()}
        for i in range(120):
            places[rows[i][0], int(rows[i][1] >= n // shards // 2)] += 1
        together += sum(rows[i][0] == rows[i + 1][0] for i in range(n - 1))
    expected = 120 * runs / (2 * shards)
    assert ((places - expected) ** 2 / expected).sum() < 24.3  # chi-square, 7 degrees, 0.1 %
    p = (n // shards - 1) / (n - 1)
    assert abs(together - runs * (n - 1) * p) < 4 * (runs * (n - 1) * p * (1 - p)) ** 0.5


def test_hypergeometric_law(spark):
    got = spark.range(4000).select(sharding.hypergeometric(F.lit(50), F.lit(20), F.lit(10), sharding.unit(F.xxhash64("id", F.lit(3)))).alias("x")).groupBy("x").count().collect()
    from math import comb

    for r in got:
        p = comb(20, r["x"]) * comb(30, 10 - r["x"]) / comb(50, 10)
        assert abs(r["count"] / 4000 - p) < 5 * (p * (1 - p) / 4000) ** 0.5 + 1e-3


def brute_fingerprint(text, size):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(docs, odd, none):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: brute_fingerprint(t, 4) for i, t in rows.items()}
    want = roots(rows, [(a, b) for a in rows for b in rows if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    got = simhash.simhash_components(docs).collect()
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == fps and {r["doc_id"]: r["component_id"] for r in got} == want
    strange = simhash.simhash_components(odd).collect()
    assert len(strange) == odd.count() and {r["component_id"] for r in strange if r["fp"] == 0} == {3}
    assert simhash.simhash_components(none).count() == 0


def test_ball_links_find_every_pair_within_the_radius(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in base:
        for _ in range(6):
            fps.append(int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = sorted({f % 2**64 for f in fps})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    rows = spark.createDataFrame([(k, f) for f in signed for k in (0, 1)], "kind int, fp long")
    both = simhash.ball_links(rows, 4, 2 * len(signed)).collect()
    links = [r for r in both if r["kind"] == 1]
    assert {(r["a"], r["b"]) for r in links} == {(r["a"], r["b"]) for r in both if r["kind"] == 0}
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 4 for r in links)
    want = roots(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 4])
    assert roots(signed, [(r["a"], r["b"]) for r in links]) == want


def test_links_that_may_be_rejected_are_told_under_every_prefix(spark):
    # 0 is in all patterns that the others share under the prefix of 7, and in none of those under the other prefix.
    rows = spark.createDataFrame([(0, 0), (0, 7), (0, 1 << 60)], "kind int, fp long")
    links = {(r["a"], r["b"]) for r in simhash.ball_links(rows, 4, 3, every=True).collect()}
    assert links == {(7, 0), (1 << 60, 0), (1 << 60, 7)}


def test_near_copies_keep_one_of_each_group(docs, odd, none):
    rows = {r["doc_id"]: WORD.findall((r["text"] or "").lower()) for r in docs.collect()}
    sets = {i: frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for i, w in rows.items()}
    alike = lambda a, b: (not a and not b) or len(a & b) >= 0.8 * len(a | b)
    want = set(roots(rows, [(a, b) for a in rows for b in rows if a < b and alike(sets[a], sets[b])]).values())
    kept = {r["doc_id"] for r in near_copies.near_copies(docs).collect()}
    assert want <= kept and len(kept - want) <= 0.03 * (len(rows) - len(want)) + 1
    got = near_copies.near_copies(odd)
    assert got.columns == odd.columns and sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 1, 3, 6, 7, 8]
    assert near_copies.near_copies(none).count() == 0


def test_near_copies_that_differ_by_a_block_meet(spark):
    rng = np.random.default_rng(6)
    words = lambda n: ["".join(rng.choice(list("abcdefghij"), 8)) for _ in range(n)]
    texts = []
    for _ in range(30):
        whole = words(200)
        texts += [whole, whole[:90] + words(30) + whole[90:], words(200), words(200)]
        texts.append(texts[-1][:170])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in near_copies.near_copies(docs).collect()}
    assert kept == {i for i in range(150) if i % 5 in (0, 2, 3)}


def brute_boilerplate(texts):
    """Where lines go, from the rule alone: lines match if they have as many tokens and differ, digits aside, only inside one field."""
    digits = lambda t: "<*>" if re.search("[0-9]", t) else t
    lines = {x: [[digits(t) for t in WORD.findall(line)] for line in x.split("\n")] for x in set(texts)}

    def fields(n):
        at = [n * j // 8 for j in range(9)]
        return [(at[v], at[v + 2]) for v in range(7)] if n >= 4 else [(n, n)]

    def need(x):
        constants = sum(t != "<*>" and bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", t)) for t in x)
        return None if constants == 0 or 2 * constants < len(x) else 3 if len(x) >= 8 else 5 if len(x) >= 4 else 10

    where = {}
    for x, ls in lines.items():
        for i, line in enumerate(ls):
            for a, b in fields(len(line)) if line else ():
                where.setdefault((len(line), a, b, tuple(line[:a]), tuple(line[b:])), []).append((x, i))
    passages = {}
    for x in lines:
        for line in filter(WORD.search, x.split("\n")):
            for part in re.sub(" ([lnpwLNPW])", "\n\\1", line).split("\n"):
                if len(part) >= 20:
                    passages.setdefault(part, []).append(x)
    total, own = Counter(), Counter()
    for part, held in passages.items():
        for x in held:
            total[x] += len(part)
            own[x] += len(part) if len(set(held)) == 1 else 0
    apart = {x for x in lines if 5 * own[x] > 2 * total[x]}
    gone = {x: set() for x in lines}
    for held in where.values():
        held = [(x, i) for x, i in held if need(lines[x][i])]
        if held and len({x for x, _ in held} & apart) >= need(lines[held[0][0]][held[0][1]]):
            for x, i in held:
                gone[x].add(i)
    return {x: "\n".join(l for i, l in enumerate(x.split("\n")) if i not in gone[x]) for x in lines}


def boilerplate_cases():
    """Distinct texts, ten to a notice: blocks of one, two and five lines, a varying word, short lines, copies, and what must stay."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    line = lambda n=12: " ".join(word() for _ in range(n))
    rows, want = [], []

    def add(before, middle, after, stays=False):
        rows.append("\n".join([*before, *middle, *after]))
        want.append("\n".join([*before, *(middle if stays else []), *after]))

    for size in (1, 2, 5):
        block = [line() for _ in range(size)]
        for _ in range(10):
            add([line(), line()], block, [line(), line()])
    for _ in range(10):
        add([line(), line()], [f"posted by {word()} in the general news section"], [line()])
        add([line(), line()], [f"{word()} wrote this for our weekly letter to members"], [line()])
        add([line(), line()], [f"page {rng.integers(1000)} of {rng.integers(1000)} printed by the office of the town"], [line()])
    same_start = line(8)
    for _ in range(10):
        add([line()], [same_start + " " + line(8)], [line()], stays=True)  # alike in eight tokens only
        add([line()], ["---", "12 34 56 78"], [line()], stays=True)
    for _ in range(12):
        add([line()], ["read more"], [line()])
    for _ in range(6):
        add([line()], ["also read"], [line()], stays=True)  # too few for so short a line
    original, common = [line() for _ in range(8)], line()
    for _ in range(60):  # near copies, one word of one line another: none of their lines goes but the common one
        copy = [x.split() for x in original]
        copy[int(rng.integers(8))][int(rng.integers(12))] = word()
        add([" ".join(x) for x in copy[:4]], [common], [" ".join(x) for x in copy[4:]])
    for _ in range(5):
        add([line()], [common], [line(), line()])
        add(original, [], [])
    return rows, want


def test_recurring_lines_go_and_copies_stay(spark, odd, none):
    rows, want = boilerplate_cases()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("Keys", F.col("doc_id"))
    got = line_dedup.drop_boilerplate(docs)
    assert got.columns == ["doc_id", "text", "Keys", "n_lines", "n_dropped"]
    got = {r["doc_id"]: r for r in got.collect()}
    assert [got[i]["text"] for i in range(len(rows))] == want
    assert all(got[i]["n_dropped"] == len(rows[i].split("\n")) - len(want[i].split("\n")) and got[i]["n_lines"] == len(rows[i].split("\n")) for i in got)
    assert line_dedup.drop_boilerplate(odd).count() == odd.count() and line_dedup.drop_boilerplate(none).count() == 0


def test_line_dedup_equals_brute_force(docs):
    texts = [r["text"] for r in docs.collect() if r["text"] is not None] + boilerplate_cases()[0]
    want = brute_boilerplate(texts)
    assert any(x != y for x, y in want.items())
    rows = docs.sparkSession.createDataFrame([(x,) for x in texts], "text string")
    got = line_dedup.drop_boilerplate(rows.withColumn("at", F.col("text"))).collect()
    assert len(got) == len(texts) and all(r["text"] == want[r["at"]] for r in got)


def test_packing_loses_no_token(docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    both = docs.select("doc_id", "text", "source").union(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", "source"))
    count = {}
    for r in both.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        count.setdefault(r["doc_id"], []).append(ids)
    pieces = packing.pack(both.withColumn("k", F.lit("clash")), packing.ranks_path()).collect()
    want, got = Counter(), Counter()
    for i, many in count.items():
        for ids in many:
            want[i] += len(ids)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        assert any(len(ids) == p["doc_tokens"] and zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for ids in count[p["doc_id"]])
    assert got == want
    for i, many in count.items():  # of documents with an id of their own, the pieces tile the ids
        if len(many) == 1:
            at = 0
            for p in sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
            assert at == len(many[0])
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(p["length"] for p in pieces)
    assert sorted(windows) == list(range(len(windows))) and len(windows) * 1024 <= total + 20 * 128 + 1024
    assert packing.pack(none, packing.ranks_path()).count() == 0


def round_robin(tokens, shares, slots, quantum):
    """Tokens of each source in each window, filled one slot after the other; credit that is not spent carries over."""
    left, served, out = dict(tokens), dict.fromkeys(tokens, 0), []
    while any(left.values()):
        window = Counter()
        for _ in range(slots):
            waiting = [s for s in left if left[s]]
            if not waiting:
                break
            s = min(waiting, key=lambda s: ((served[s] + 0.5) / shares[s], s))
            got = min(quantum, left[s])
            window[s], left[s], served[s] = window[s] + got, left[s] - got, served[s] + 1
        out.append(window)
    return out


@pytest.mark.parametrize("shares", [None, {"big": 1.0, "mid": 2.0, "small": 5.0}, {"small": 0.1}])
def test_windows_are_those_of_a_sequential_round_robin(spark, shares):
    rng = np.random.default_rng(4)
    rows = [(i, "tok " * int(rng.integers(0, 500)), ["big", "big", "mid", "big", "small"][i % 5]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    pieces = packing.pack(docs, packing.ranks_path(), shares=shares).join(docs.select("doc_id", "source"), "doc_id")
    got = {}
    for r in pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect():
        got.setdefault(r["sequence_id"], Counter())[r["source"]] = r["n"]
    tokens = Counter()
    for w in got.values():
        tokens += w
    owed = {s: -(-n // packing.QUANTUM) for s, n in tokens.items()} if shares is None else {s: shares.get(s, 1.0) for s in tokens}
    want = round_robin(tokens, owed, packing.WINDOW // packing.QUANTUM, packing.QUANTUM)
    assert [got[i] for i in range(len(got))] == want
    if shares is None:
        whole = sum(tokens.values())
        assert all(abs(w[s] - tokens[s] / whole * sum(w.values())) <= 2 * packing.QUANTUM for w in want for s in tokens)


def test_language_model_base_and_normalisation(docs, odd, none):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = language_model.score_corpus(both.withColumn("score", F.lit("clash")), language_model.held_out_tenth()).collect()
    rows = [(r["doc_id"], [*(x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(r["text"] or "")), None]) for r in both.collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, len(ws), sum(w in c for w in ws), round(sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in rows)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    judged = [r for r in got if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in judged) > sum(r["base_score"] for r in judged)
    assert language_model.score_corpus(none, language_model.held_out_tenth()).count() == 0


def brute_model(rows, held):
    """Counts of a bigram model from its definition, and its weights learned on counts less the token's own."""
    one, two = Counter(), Counter()
    for i, ws in rows:
        if not held(i):
            one["<start>"] += 1
            for h, w in zip(["<start>", *ws], ws):
                one[w] += 1
                two[h, w] += 1
    n, v = sum(c for w, c in one.items() if w != "<start>"), len(one) - 1
    cells = Counter()
    log = lambda c, of, step: -round(step * np.log2(c / of)) if c > 0 else 9999
    for (h, w), c in two.items():
        ch = one[h] - 1
        bucket = int(np.floor(np.log2(ch))) + 1 if ch > 0 else 0
        cells[(bucket * 10_000 + log(c - 1, ch, language_model.STEP_2)) * 10_000 + log(one[w] - 1, max(1, n - 1), language_model.STEP_1)] += c
    weights = language_model.learn_weights(np.array(sorted(cells)), np.array([cells[k] for k in sorted(cells)]), v)

    def chance(h, w):
        b = int(np.floor(np.log2(one[h]))) + 1 if one[h] else 0
        return weights[b][0] * two[h, w] / max(1, one[h]) + weights[b][1] * (one[w] if w != "<start>" else 0) / n + weights[b][2] / (v + 1)

    return one, chance


def test_language_model_scores_equal_brute_force(docs):
    rows = [(r["doc_id"], ["".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(r["text"] or "")] + ["\n"]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    one, chance = brute_model(rows, held)
    words = [w for w in one if w != "<start>"]
    for h in ["<start>", "never seen", *words[:3], max(words[1:], key=lambda w: one[w] if w != "\n" else 0)]:
        if h != "\n":
            assert sum(chance(h, w) for w in words) + chance(h, "an unknown word") == pytest.approx(1, abs=1e-9)
    got = {r["doc_id"]: r["score"] for r in language_model.score_corpus(docs, language_model.held_out_tenth(), block_tokens=5000, range_keys=2000).collect()}
    for i, ws in rows:
        assert got[i] == pytest.approx(sum(log10(chance(h, w)) for h, w in zip(["<start>", *ws], ws)), rel=1e-6)


def test_expectation_maximisation_prefers_what_predicts():
    hit = (5 * 10_000 + 8) * 10_000 + 40  # a context seen 16 to 31 times, its bigram at one half, the word at 2 ** -10
    weights = language_model.learn_weights(np.array([hit]), np.array([1000]), 1000)
    assert weights[5][0] > 0.99 and weights.sum(axis=1) == pytest.approx(1)
