"""Operators on embeddings against brute force, with copies, nulls and zeros."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlab.llm import embedding_dedup, nearest

from .test_documents import roots


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + rng.standard_normal(16) * rng.choice([0.05, 0.25, 0.6])).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # a large group of copies
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [None] + [1.0] * 15), (3004, [float("inf")] * 16), (3005, []), (3050, None), (5, rows[5][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def usable(rows):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    return ids, x, np.sqrt((x**2).sum(1))


def test_nearest_reaches_the_recall(vectors, spark):
    rows, df = vectors
    ids, x, n = usable(rows)
    got = {}
    for r in nearest.nearest(df, lambda i: i % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = np.flatnonzero(ids % 50 == 0)
    assert set(got) == set(ids[asked].tolist())
    hit = 0
    for q in asked:
        s = (x @ x[q]) / (n * n[q])
        s[q] = -9
        found = sorted(got[ids[q]])
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5]
        kth = np.sort(s)[-5]
        hit += sum(score >= kth - 1e-12 for _, _, score in found)
        for _, i, score in found:
            assert score == pytest.approx(max(s[ids == i]), abs=1e-12)
        keys = [(-round(score, 12), i) for _, i, score in found]
        assert keys == sorted(keys)
    assert hit / (5 * len(asked)) >= 0.9
    assert nearest.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_few_vectors_are_all_found(spark):
    rows = [(50, [1.0, 0.0, 0.0]), (1, [-1.0, 0.1, 0.0]), (2, [0.0, 0.0, -5.0]), (100, [0.0, 1.0, 0.0]), (3, None)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("bucket", F.lit("clash")), lambda i: i % 50 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {50: [2, 100, 1], 100: [1, 2, 50]}  # ties to the smaller id
    far = [(i, (np.eye(20)[i] * (1 if i % 2 else -1)).tolist()) for i in range(20)]
    got = nearest.nearest(spark.createDataFrame(far, "vec_id long, embedding array<double>"), lambda i: i == 0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(i, i) for i in range(1, 6)]
    alone = nearest.nearest(spark.createDataFrame(far[:1], "vec_id long, embedding array<double>"), lambda i: i == 0)
    assert alone.count() == 0


@pytest.mark.parametrize("n, most", [(4000, 0.5), (50_000, 0.36)])
def test_the_share_of_vectors_visited_falls(n, most):
    """On directions without any structure, the hardest case."""
    rng = np.random.default_rng(2)
    u = rng.standard_normal((n, 64))
    u /= np.sqrt((u**2).sum(1))[:, None]
    asked = range(60)
    s = u[:60] @ u.T
    s[np.arange(60), np.arange(60)] = -9
    best = np.argsort(-s, axis=1)[:, :5]
    tables = nearest.Tables(64, n, float(np.sqrt(2 - 2 * s[np.arange(60), best[:, 4]]).mean()))
    seen = np.zeros((60, n), bool)
    for t in range(nearest.TABLES):
        buckets = tables.number(np.floor(tables.project(u, t)), t)
        for i in asked:
            seen[i] |= np.isin(buckets, tables.probes(tables.project(u[i], t), t))
    recall = np.mean([seen[i, best[i]].mean() for i in asked])
    assert recall >= 0.9 and seen.mean() <= most


def test_links_and_components(vectors):
    rows, df = vectors
    ids, x, n = usable(rows)
    s = (x @ x.T) / (n[:, None] * n[None])
    np.fill_diagonal(s, -1)
    linked = s >= 0.95
    got = embedding_dedup.embedding_links(df).collect()
    assert len(got) == len(rows)
    want = roots(range(len(ids)), list(zip(*np.nonzero(np.triu(linked)))))
    least = {}
    for k, r in want.items():
        least[r] = min(least.get(r, 10**9), ids[k])
    links = {i: 0 for i in ids.tolist()}
    for i, c in zip(ids.tolist(), linked.sum(1).tolist()):
        links[i] = max(links[i], c)
    component = {ids[k]: least[r] for k, r in want.items()}
    off = [r for r in got if r["vec_id"] in links and (r["n_links"] != links[r["vec_id"]] or r["component_id"] != component[r["vec_id"]])]
    assert len(off) <= 0.02 * len(got)
    assert sum(r["n_links"] for r in got) >= 0.99 * linked.sum() and all(r["n_links"] <= links.get(r["vec_id"], 0) for r in got)
    alone = [r for r in got if r["vec_id"] >= 3000]
    assert len(alone) == 7 and all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"] for r in alone)
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_links_of_floats_doubles_and_many_blocks(spark, monkeypatch):
    """Blocks, lots and passes of a few rows give the links of brute force, and no shuffle file outlives a pass."""
    for name, few in (("PER_CELL", 20), ("MEMBERS", 16), ("VISITORS", 32), ("LEAST_PASS", 500), ("VISITORS_AT_ONCE", 8), ("PAIRS", 64)):
        monkeypatch.setattr(embedding_dedup, name, few)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 24))
    x[300:420] = x[0] + 0.1 * rng.standard_normal((120, 24))  # a crowded cell
    x[420:560] = x[1:141] + 0.2 * rng.standard_normal((140, 24))
    for kind, width in (("float", np.float32), ("double", np.float64)):
        v = x.astype(width)
        df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], f"vec_id long, embedding array<{kind}>")
        u = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(1))[:, None]
        linked = u @ u.T >= 0.95
        np.fill_diagonal(linked, False)
        want = roots(range(len(v)), list(zip(*np.nonzero(np.triu(linked)))))
        got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(df).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == dict(want)
        assert sum(r["n_links"] for r in got.values()) >= 0.995 * linked.sum() > 10_000
        assert all(r["n_links"] <= linked[i].sum() for i, r in got.items())


def test_what_a_pass_sends_does_not_grow_with_the_visits():
    """A vector of 600,000 visits 12 cells ahead: a pass sends PASS_ROWS rows for each vector, not 12."""
    rng = np.random.default_rng(1)
    members = rng.poisson(1000, 576)
    blocks = embedding_dedup.Blocks(members, 13 * members, int(members.sum()))
    sent = [0] * blocks.passes
    cell = rng.integers(0, 576, 40_000)
    for now in range(blocks.passes):
        sent[now] = len(blocks.of(np.arange(40_000), cell, True, now)[0])
    assert sum(sent) == 40_000 and blocks.passes >= 7
    assert 13 * max(sent) <= 1.6 * embedding_dedup.PASS_ROWS * 40_000


def test_nearest_leaves_one_copy_for_one_table(spark, monkeypatch, tmp_path):
    """What the operator writes and leaves is far less than a copy of the vectors for each table; small passes,
    parts, chunks and blocks find the same as large ones, and doubles the same as floats."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[1000:1400] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    path = str(tmp_path / "vectors.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(path)
    df = spark.read.parquet(path)
    write, written, most = nearest.materialize, [], []

    def weighed(*a):
        made = write(*a)
        written.append(Path(made.written_at.removeprefix("file://")))
        most.append(sum(f.stat().st_size for top in written for f in top.rglob("*.parquet")))
        return made

    monkeypatch.setattr(nearest, "materialize", weighed)
    whole = nearest.nearest(df, lambda i: i % 50 == 0).collect()
    assert max(most) < 1_200_000  # a copy as floats has 384 kB; eight copies as doubles had 6 MB
    for name, few in (("QUERIES", 10), ("PART", 100), ("BLOCK", 512), ("LEAST_WAITING", 16), ("PAIRS", 32)):
        monkeypatch.setattr(nearest, name, few)
    some = df.where("vec_id < 400 or vec_id % 50 = 0 or vec_id between 1000 and 1400")
    doubles = some.withColumn("embedding", F.col("embedding").cast("array<double>"))
    parted, doubled = ([tuple(r) for r in nearest.nearest(d, lambda i: i % 200 == 0).collect()] for d in (some, doubles))
    assert len(parted) == 5 * 15 and sorted(parted) == sorted(doubled)
    assert len(whole) == 5 * 60
    copies = {r["vec_id"] for r in whole if r["query_id"] == 1200}
    assert copies == {3, 1000, 1001, 1002, 1003}  # ties to the smaller id
