"""A training corpus from raw documents, stage by stage; each stage reads all that its predecessor kept.

quality      documents that the classifier rejects go
near_dups    one document of each group of near copies stays
secrets      credentials in the texts are replaced
mixing       documents are repeated or left out until the sources have their target sizes
tokens       texts become token ids, with the hash of what the ids decode to

Each function takes (spark, docs, sf_dir); all but the last return the columns of docs. Null and empty texts
are scored, linked, scanned, sized and encoded as the operators' modules say; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.llm import bpe_lexicon, mixing, near_dups, quality_pu, secrets
from isoloom.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_pu.keep_good(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded_sha256 of each row."""
    import public_tokenizers

    path = public_tokenizers.path(bpe_lexicon.VOCABULARY)
    made = bpe_lexicon.encode_columns(docs.select("doc_id", "lang", "source", "text"), path, bpe_lexicon.build_lexicon(docs, path), digest=True)
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dups", near_copies), ("secrets", secret_scan), ("mixing", mixed), ("tokens", tokens)]

#: A classifier and a nearest-group search are not SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else stored(docs, f"stage-{name}"), sf_dir)
    return docs
