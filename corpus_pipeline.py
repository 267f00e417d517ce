"""A training corpus from the documents: quality, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage's result in the shared folder and reads it back, so a
lost executor costs at most a part of one stage.

Defined results: rows with a null id are scored, pseudonymised and packed, but are no near duplicate of any and hold no
benchmark item. A null or empty text has the score of no features, no shingles and no personal data, and is packed as
its end mark alone. Of rows that share an id one stays; of near duplicates (80 % or more of shingles) that of the least
id. Other columns pass through unread, whatever their names. Without labels all documents are kept; without a benchmark
none is contaminated; without documents there are no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrite.llm import common, decontaminate, near_duplicates, packing, pii_pseudonyms, quality


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on four fifths of the labels, accepts."""
    labels = common.table(spark, sf_dir, "labels").where(common.crc_mod("doc_id", 5) != 0)
    return quality.keep_good(docs, quality.fit(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return near_duplicates.keep_one(docs, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text."""
    out = pii_pseudonyms.pseudonymise(docs, pii_pseudonyms.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("personal data", with_pseudonyms),
    ("packing", packed),
]

#: Stages train models, hash and tokenise; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            common.discard(before)  # nothing reads a stage's rows once the next one's are written
        before = docs
    return docs
