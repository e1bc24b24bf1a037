"""The corpus pipeline: documents through the training-data operators, stage after stage.

toxicity    documents that the factorization machine scores 0.5 or more go
near_dedup  of each group of near-duplicates (five-word shingles, Jaccard 0.8) the smallest doc_id stays
substrings  words under a window of 13 words that a smaller doc_id has too go
mixing      documents are repeated to the temperature-mixed weights of their sources
packing     the token sequences, one row for each piece

Each stage's rows are written and read again as the next one's documents. No SQL expresses the
machine of the first stage, so there is no ORACLE_SQL; tests/llm hold the stages against brute force.
"""

from __future__ import annotations

from tallyline.llm import mixing, packing, simhash, substrings, toxicity
from tallyline.llm.common import materialize, table


def _toxicity(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def _near_dedup(spark, docs, sf_dir):
    return simhash.drop_near_duplicates(docs)


def _substrings(spark, docs, sf_dir):
    return substrings.drop_repeats(docs)


def _mixing(spark, docs, sf_dir):
    return mixing.mix(docs)


def _packing(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [("toxicity", _toxicity), ("near_dedup", _near_dedup), ("substrings", _substrings), ("mixing", _mixing), ("packing", _packing)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
