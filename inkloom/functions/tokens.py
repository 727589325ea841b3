"""Token counters: what is passed to packing and plans as the size of a text. Any function from a text column to a number
will do; these are the white-space counter and one by a public tokenizer's file."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.text import word_count
from inkloom.session import checked_broadcast

Counter = Callable[[Column], Column]

#: Tokens by white space, in the JVM.
by_words: Counter = word_count


def by_characters(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def by_tokenizer(spark: SparkSession, path: str) -> Counter:
    """A counter by a tokenizer's JSON file (special tokens are ordinary text); null counts as 0. The file is sent to the
    tasks once; its size is checked."""
    blob = Path(path).read_text(encoding="utf-8")
    shared = checked_broadcast(spark, blob, len(blob.encode()))
    made: list = []

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        if not made:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(shared.value)
            tokenizer.encode_special_tokens = True
            made.append(tokenizer)
        return pd.Series([len(e.ids) for e in made[0].encode_batch_fast([t or "" for t in texts], add_special_tokens=False)])

    return count
