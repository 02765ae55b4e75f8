"""Five stages from raw documents to token ids; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import bpe, decontam, jaccard, resample, secret_spans
from tallyspark.llm.common import apart, ship, together
from tallyspark.llm.queries import vocabulary
from tallyspark.sources.shared import own_folder


#: Bytes of rows that Spark sends to Python at once, where the session doesn't say; its own 64 MB hold a whole task's texts.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _shipped(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        if spark.conf.get(_BATCH, None) is None:
            spark.conf.set(_BATCH, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@_shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample of good text leaves out go.

    Null, empty and wordless texts weigh least; rows of equal id and text share their fate; an empty table stays empty;
    texts of any length are read whole; all columns stay as they are, whatever their names.
    """
    return resample.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the least id, a null id last, then of the least text hash.

    Null, empty and wordless texts are in no class and stay, every row of them; of other rows that repeat one stays; an
    empty table stays empty; texts of any length are read whole; all columns stay as they are, whatever their names.
    """
    return jaccard.keep_one(docs)


@_shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule names go.

    Null, empty and wordless texts hit nothing and stay; repeated rows share their fate; an empty table stays empty; texts
    of any length are searched whole; all columns stay as they are, whatever their names.
    """
    found = decontam.find(apart(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["text", "row"])
    return together(found.filter(~decontam.contaminated()), docs.columns, "text")


@_shipped
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked and n_chars set anew where that changed the text.

    Null and empty texts stay as they are; repeated rows are masked alike; an empty table stays empty; texts of any length
    are scanned whole; all other columns stay as they are, whatever their names.
    """
    return secret_spans.redact(docs)


@_shipped
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids, the text decoded from them, and the digests of both.

    Null and empty texts have no ids and decode to the empty text; repeated rows each get their row; an empty table gives
    none; texts of any length are encoded whole; columns but id and text are left out.
    """
    return bpe.encode_decode(docs.select("doc_id", "text"), vocabulary(), carry=["doc_id"], digest=True)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding and decoding", encoding),
]

#: Models and tokenizers aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps lies in a folder of its own in the shared one, which goes when the
    driver ends; the last one's rows are the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at = own_folder(spark, f"pipeline/{name.split()[0].lower()}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
