"""The corpus pipeline: five stages over documents, each over all its predecessor kept.

All stages but the last return the columns of documents, whatever further ones there are and whatever their names.

Defined results: a null text counts as empty: it is rated like any other, links with other texts without words, holds no item and no secret, and has no
tokens. Rows without a doc_id are kept by the deduplication. Repeated rows are one document for it; unlike texts with one id are two, and both may stay; of a
group the row of the smallest id stays, of several texts with that id the one with the smallest hash. Very long texts are worked on whole. An empty table gives an
empty result of the same columns. Without ratings, or with one grade only, the first stage keeps everything. n_chars follows a text that secrets are removed from.
"""

from __future__ import annotations

from rillway.llm import bpe, decontaminate, quality, secrets, simhash
from rillway.llm.common import cut, table


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark, docs, sf_dir):
    """Secrets are replaced by a mark; all documents stay."""
    return secrets.redact(docs)


def bpe_stage(spark, docs, sf_dir):
    """doc_id, n_tokens, ids of every document."""
    return bpe.encode_documents(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("bpe encoding and decoding", bpe_stage),
]

#: Hashing, learned weights and byte-pair merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = cut(docs)
    return docs
