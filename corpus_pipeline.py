"""From raw documents to training sequences, in five stages of the llm subpackage.

Every stage works on all that the one before kept, written as Parquet in between, and all but the last return the
columns of documents: toxic documents go; boilerplate lines go; one document of each group of near copies stays; the
sources are mixed to their target weights; what is left is tokenised and packed into windows of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.llm.common import WORD, materialize, quoted, table, unfold, whole_row
from contestlab.llm.line_dedup import drop_boilerplate
from contestlab.llm.mixing import mix
from contestlab.llm.near_copies import near_copies
from contestlab.llm.packing import pack, ranks_path
from contestlab.llm.toxicity import toxicity

REJECTED = 0.5  # the score from which a document is toxic


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on all labelled ones, doesn't take for toxic; their columns untouched.

    Null, empty and blank texts have the prior's score and stay unless most labels are toxic; repeated rows share
    their fate; null ids are scored like any other; an empty input gives an empty result."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", names["doc_id"])
    scored = toxicity(docs.toDF(*names.values()), labels, id_col=names["doc_id"], text_col=names["text"])
    return scored.where(F.col("score") < REJECTED).select(*names.values()).toDF(*names)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; n_chars follows the text, other columns stay. A document that loses all its
    text goes; null, empty and blank texts, repeated rows and null ids stay; an empty input gives an empty result."""
    others = docs.drop("text")
    left = drop_boilerplate(docs.select("text", whole_row(others).alias("row")))
    left = left.where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return unfold(left, "row", others.schema, {"text": F.col("text"), "n_chars": chars}).select(*quoted(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash balls or bands and a similarity of 0.8 in five-word shingles.

    Texts without words, null ones too, are copies of each other; the least id stays, a null one last; repeated rows
    are copies; an empty input gives an empty result."""
    return near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them. Null sources are a source; null, empty and blank
    texts weigh nothing; repeated rows are rows of their own; an empty input gives an empty result."""
    return mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens. A null or empty text is its end token alone; repeated
    rows and null ids are documents of their own; other columns are not read; an empty input gives no pieces."""
    return pack(docs, ranks_path())


STAGES = [
    ("toxicity", keep_civil),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    Null, empty and blank texts pass as each stage says and end as pieces of their end token; texts of any length are used
    whole; repeated rows are copies, of which near-dedup keeps one; null ids stay rows; columns of any name pass until
    packing; an empty table gives no pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
