"""All operators that keep their input's columns give them back, whatever they are called."""

import ast
import pathlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contestlab.llm import alignment, line_dedup, mixing, near_copies, packing, sharding, suffix_index, token_counts, toxicity

SOURCES = pathlib.Path(line_dedup.__file__).parent
OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def names():
    """Every word that stands as a string in the operators' code, so all of their internal and output columns."""
    found = set()
    for path in SOURCES.glob("*.py"):
        found |= {n.value for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Constant) and isinstance(n.value, str)}
    found = {n for n in found if n.isidentifier() and n.lower() not in OWN and len(n) < 20}
    return sorted({n.lower(): n for n in sorted(found)}.values()) + ["a.b", "with space"]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    return docs.select("*", *[F.concat(F.lit(n + "/"), F.col("doc_id").cast("string")).alias(n) for n in names()])


def intact(got, replaced=()):
    kept = [n for n in names() if n.lower() not in replaced]
    rows = got.select("doc_id", *[F.col("`" + n + "`") for n in kept]).collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"{n}/{r['doc_id']}" for n in kept)


@pytest.mark.parametrize(
    "run, replaced",
    [
        (lambda d: mixing.copies_to_target(d.withColumn("size", mixing.words(F.col("text")))), {"source_size", "target", "copies", "size"}),
        (mixing.mix, ()),
        (line_dedup.drop_boilerplate, {"n_lines", "n_dropped"}),
        (lambda d: sharding.shuffle_shards(d, 4), {"shard", "slot"}),
        (near_copies.near_copies, ()),
        (lambda d: token_counts.token_counts(d, token_counts.vocabulary_path()), {"n_tokens", "n_byte_tokens", "log_score"}),
        (lambda d: toxicity.score_documents(d, None), {"score", "worst_start", "n_windows"}),
        (suffix_index.drop_repeats, {"n_bytes", "kept", "spans"}),
    ],
    ids=["copies_to_target", "mix", "drop_boilerplate", "shuffle_shards", "near_copies", "token_counts", "score_documents", "drop_repeats"],
)
def test_operators_give_columns_back(clashing, run, replaced):
    intact(run(clashing), replaced)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_give_columns_back(spark, clashing, name, stage):
    got = stage(spark, clashing, "/root/testdata/sf0.001")
    assert got.columns == clashing.columns
    intact(got)


def test_alignment_ignores_other_columns(clashing):
    got = alignment.alignment_counts(clashing, packing.ranks_path(), token_counts.vocabulary_path())
    assert got.columns[0] == "doc_id" and got.count() == clashing.count()


def test_packing_ignores_other_columns(spark, clashing):
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, "/root/testdata/sf0.001").count() > 0
