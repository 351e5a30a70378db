"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A rank file (token in base 64 and its rank on each line) that the executors can read.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# fixed value: the public pattern that splits text before byte-pair merges
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a rank file; one for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, identifier: str, text: str, others: dict[str, str] | None = None, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """Tokens per text: id, the columns ``others`` (new name -> column), n_tokens.

    The whole text is tokenised, once for each distinct text of a batch. NULL
    and empty texts have 0 tokens; blank ones have some. Special-token strings
    are ordinary text.
    """
    others = others or {}
    rows = df.select(F.col(f"`{identifier}`").alias("id"), *(F.col(f"`{c}`").alias(name) for name, c in others.items()), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            if not batch.num_rows:
                continue
            distinct = pc.dictionary_encode(batch.column(batch.num_columns - 1))
            if isinstance(distinct, pa.ChunkedArray):
                distinct = distinct.combine_chunks()
            sizes = pa.array([len(encode(value.as_py())) for value in distinct.dictionary], pa.int64())
            yield pa.record_batch([*batch.columns[:-1], sizes.take(distinct.indices)], schema.names)

    return rows.mapInArrow(count, schema)
