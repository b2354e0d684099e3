"""Token counts of whole texts by byte-pair merging, without identifiers.

Distinct pre-tokens of a block of texts are merged once, with a heap of adjacent pairs and a
linked list of symbols; a text's count is the sum over its pre-tokens of initial symbols minus
merges. Special strings of the vocabulary count one token each.

Edge cases: null and empty texts have 0 bytes and 0 tokens; very long texts are handled whole;
rows are independent of each other, so ties, copies and empty tables need nothing special.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm import bpe


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row."""
    path = vocabulary or bpe.default_vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = bpe.vocabulary(path)
        for b in batches:
            texts = b["_t"].tolist()
            n = []
            for x, y in bpe.blocks(texts):
                parts, number, between = v.fragments(texts[x:y])
                sums = bpe._sums(v.count(parts), number)
                n += [int(s) + len(i) for s, i in zip(sums, between, strict=True)]
            yield pd.DataFrame({"_id": b["_id"], "n_bytes": b["n_bytes"], "n_tokens": n})

    flat = docs.select(F.col(doc_id).cast("string").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("n_bytes", F.octet_length("_t").cast("long"))
    # ids pass through as text: a null would turn the longs of a batch into doubles
    out = flat.mapInPandas(count, "_id STRING, n_bytes BIGINT, n_tokens BIGINT")
    return out.select(F.col("_id").cast(docs.schema[doc_id].dataType).alias(doc_id), "n_bytes", "n_tokens")
