"""Tokenization of text columns under a pinned tokenizer: encode, truncate, pad, mask, audit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import on_workers
from ..contracts import TokenizationAudit, TokenizedBatch, TokenizerConfig, require


@dataclass(frozen=True)
class VocabularyTokenizer:
    """White-space words looked up in a map; stays in the JVM. `encode_content` gives the same
    ids for one text on the driver."""

    identifier: str
    revision: str
    vocabulary: dict[str, int]
    unknown_token_id: int
    pad_token_id: int = 0
    prefix_special_token_ids: tuple[int, ...] = ()
    suffix_special_token_ids: tuple[int, ...] = ()
    separator: str = field(default=r"\s+")

    def encode_column(self, text: Column) -> Column:
        words = F.array_remove(F.split(text, self.separator), "")
        if not self.vocabulary:
            return F.transform(words, lambda w: F.lit(self.unknown_token_id))
        ids = F.create_map(*(F.lit(x) for pair in self.vocabulary.items() for x in pair))
        return F.transform(words, lambda w: F.coalesce(F.element_at(ids, w), F.lit(self.unknown_token_id)))

    def encode_content(self, text: str) -> tuple[int, ...]:
        return tuple(self.vocabulary.get(w, self.unknown_token_id) for w in text.split())


def _ids(tokenizer: object, name: str) -> tuple[int, ...]:
    value = getattr(tokenizer, name, None)
    require((isinstance(value, tuple) and all(type(x) is int for x in value), f"tokenizer {name} must be a tuple of integer special token ids"))
    return value


def _content(tokenizer: object, texts: DataFrame, column: str) -> Column:
    """Token ids: by expression where the tokenizer offers one, else in Arrow batches."""
    if hasattr(tokenizer, "encode_column"):
        return tokenizer.encode_column(F.col(column))

    on_workers(texts.sparkSession)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: list(tokenizer.encode_content(t)))

    return encode(F.col(column))


def check_tokenizer(tokenizer: object, config: TokenizerConfig) -> tuple[tuple[int, ...], tuple[int, ...], int]:
    """The tokenizer's prefix, suffix and pad ids, once it is the one that config pins."""
    identifier, revision = getattr(tokenizer, "identifier", None), getattr(tokenizer, "revision", None)
    try:
        TokenizerConfig(identifier, revision, config.maximum_length, config.truncation_side, config.padding)
    except ValueError:
        raise ValueError("injected tokenizer identifier or revision is invalid") from None
    require(
        (identifier == config.identifier, "tokenizer identifier does not match the explicit config"),
        (revision == config.revision, "tokenizer revision does not match the explicit config"),
    )
    prefix, suffix = _ids(tokenizer, "prefix_special_token_ids"), _ids(tokenizer, "suffix_special_token_ids")
    pad = getattr(tokenizer, "pad_token_id", None)
    require(
        (type(pad) is int, "tokenizer pad_token_id must be an integer"),
        (config.maximum_length >= len(prefix) + len(suffix), "maximum_length leaves insufficient room for special tokens"),
    )
    return prefix, suffix, pad


def tokenized(content: Column, config: TokenizerConfig, prefix=(), suffix=(), pad: int = 0) -> dict[str, Column]:
    """input_ids and attention_mask from an array of content ids."""
    array = lambda ids: F.array(*map(F.lit, ids)).cast("array<int>")
    room = config.maximum_length - len(prefix) - len(suffix)
    start = F.lit(1) if config.truncation_side == "right" else F.greatest(F.size(content) - room + 1, F.lit(1))
    ids = F.concat(array(prefix), F.slice(content, start, F.lit(room)), array(suffix))
    length = F.least(F.size(content), F.lit(room)) + len(prefix) + len(suffix)
    mask = F.array_repeat(F.lit(1), length)
    if config.padding == "max_length":
        missing = F.lit(config.maximum_length) - length
        ids, mask = F.concat(ids, F.array_repeat(F.lit(pad), missing)), F.concat(mask, F.array_repeat(F.lit(0), missing))
    return {"input_ids": ids, "attention_mask": mask}


def token_audit(content: DataFrame, room: int) -> DataFrame:
    """One row of counts over a _content column of ids."""
    n = F.size("_content")
    return content.agg(
        F.count("*").alias("examples"), F.count_if(n > room).alias("truncated"),
        F.coalesce(F.sum(n), F.lit(0)).alias("before"), F.coalesce(F.sum(F.least(n, F.lit(room))), F.lit(0)).alias("after"),
    )


def tokenize_batch(texts: DataFrame, tokenizer: object, config: TokenizerConfig, column: str = "text") -> TokenizedBatch:
    """texts with input_ids and attention_mask.

    Raises ValueError for a tokenizer other than the pinned one, too little room, an empty input,
    a column that is not text or holds nulls."""
    prefix, suffix, pad = check_tokenizer(tokenizer, config)
    require((isinstance(texts.schema[column].dataType, T.StringType), "every tokenization input must be text"))
    n, nulls = texts.agg(F.count("*"), F.count_if(F.col(column).isNull())).first()
    require((n > 0, "tokenization input cannot be empty"), (nulls == 0, "every tokenization input must be text"))
    encoded = texts.withColumn("_content", _content(tokenizer, texts, column))
    special = len(prefix) + len(suffix)
    audit = token_audit(encoded, config.maximum_length - special).first()
    rows = encoded.withColumns(tokenized(F.col("_content"), config, prefix, suffix, pad)).drop("_content")
    return TokenizedBatch(rows, TokenizationAudit(config.identifier, config.revision, config.maximum_length, config.truncation_side, config.padding, *audit, special), checked=True)
