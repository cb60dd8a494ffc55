"""Structure-aware chunking of long texts (STR-01, STR-02).

The boundary of a chunk depends on where the one before ended, so it is a scan within one text: a pandas
UDF that turns a text into its pieces; Spark deals the texts out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SIZE, OVERLAP = 3200, 600
BLANKS = " \t\r\n"


def pieces(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most about `size` characters that end at a blank line, sentence or line end where there is one.

    The next chunk begins `overlap` characters before the end of the last, or at it where that would not move on.
    """
    if not text:
        return []
    if len(text) <= size:
        return [x] if (x := text.strip(BLANKS)) else []
    out, at = [], 0
    while True:
        end = len(text)
        if at + size < end:
            window_end = at + size
            hits = (text.rfind(mark, at + 1, window_end) for mark in ("\n\n", ". ", "\n"))
            hit = next((h for h in hits if h > at), -1)
            end = window_end if hit < 0 else hit + 1
            if end < len(text) and text[end] == "\n":
                end += 1
        piece = text[at:end].strip(BLANKS)
        if piece:
            out.append(piece)
        if end >= len(text):
            return out
        at = end - overlap if end - overlap > at else end


@F.pandas_udf(ArrayType(StringType()))
def _pieces(texts: pd.Series) -> pd.Series:
    return texts.map(pieces)


def chunk_texts(docs: DataFrame, key: str, text: Column | str) -> DataFrame:
    """(key, position, chunk): the chunks of every text, numbered from 0 over the kept ones."""
    return docs.select(key, F.posexplode(_pieces(text)).alias("position", "chunk"))
