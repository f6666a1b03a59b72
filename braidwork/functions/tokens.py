"""Exact token counts by a public vocabulary, for whatever takes a column of token counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: A vocabulary file above this size isn't sent to the tasks.
MOST_BYTES = 64 << 20


@lru_cache(maxsize=2)
def _tokenizer(content: str) -> Tokenizer:
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(content)
    made.encode_special_tokens = True
    return made


def counted(rows: DataFrame, text: str, vocabulary: str, into: str = "tokens", at_once: int = 256) -> DataFrame:
    """Adds the number of tokens of whole texts; null for null, 0 for an empty text. A column of that name is replaced.

    ``vocabulary`` is the path of a ``tokenizers`` file on the driver. Its content is broadcast, once a process is built
    from it, and its size is checked. At most ``at_once`` texts are encoded together; special tokens in a text are ordinary text."""
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError(f"{vocabulary} has more than {MOST_BYTES} characters")
    shared = rows.sparkSession.sparkContext.broadcast(content)

    @F.pandas_udf("long")  # type: ignore[call-overload]
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = _tokenizer(shared.value)
        for texts in parts:
            out: list[int | None] = [None] * len(texts)
            known = [k for k, t in enumerate(texts) if t is not None]
            for a in range(0, len(known), at_once):
                some = known[a : a + at_once]
                for k, e in zip(some, made.encode_batch_fast([texts.iloc[k] for k in some], add_special_tokens=False)):
                    out[k] = len(e)
            yield pd.Series(out, dtype="Int64")

    return rows.withColumn(into, count(F.col(text)))
