"""Table functions for SQL: chunks, sentences and BibTeX records as rows (UDF-08, STR-01, STR-25, SRC-04).

`register` makes them known to a session. Each is a Python UDTF whose `analyze` names the columns: those of the input table come
first, then its own. They take a table argument, which may be dealt with PARTITION BY and ordered:
SELECT * FROM chunks(TABLE(docs), 'text', 3200, 600).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import SkipRestOfInputTableException
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from scholiast.functions.chunking import OVERLAP, SIZE, pieces


def _analyzed(rows: AnalyzeArgument, own: list[StructField], *numbers: AnalyzeArgument) -> AnalyzeResult:
    if not rows.isTable:
        raise ValueError("the first argument must be a table: TABLE(name) or TABLE(SELECT ...)")
    if any(not n.isConstantExpression for n in numbers):
        raise ValueError("arguments after the table must be constants")
    taken = {f.name.lower() for f in rows.dataType.fields}
    fresh = [StructField(f"_{f.name}" if f.name.lower() in taken else f.name, f.dataType) for f in own]
    return AnalyzeResult(StructType([*rows.dataType.fields, *fresh]))


class Chunks:
    """chunks(TABLE, column, size, overlap): each row with `position` and `chunk`, one for each piece of the column's text; a null or blank text has none."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(rows, [StructField("position", IntegerType()), StructField("chunk", StringType())], *[a for a in (column, size, overlap) if a])

    def eval(self, row: Row, column: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple]:
        for i, piece in enumerate(pieces(row[column], size, overlap)):
            yield (*row, i, piece)


# fixed value: abbreviations whose full stop ends no sentence are those of the text functions
def _ends() -> re.Pattern:
    from scholiast.functions.text import ABBREVIATIONS

    return re.compile(rf"""(?P<word>(?<!\w)(?:{ABBREVIATIONS}))?(?P<mark>[.!?])["')\]]*\s+(?=["'(\[]?[A-Z0-9])""", re.IGNORECASE)


class Sentences:
    """sentences(TABLE, column, least): each row with `number` and `sentence`, one for each sentence of at least `least` words of the column's text, which is taken as one paragraph."""

    def __init__(self) -> None:
        self.ends = _ends()

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(rows, [StructField("number", IntegerType()), StructField("sentence", StringType())], *[a for a in (column, least) if a])

    def _cut(self, text: str) -> Iterator[str]:
        begin = 0
        for m in self.ends.finditer(text):
            after = text[m.end() :].lstrip("\"'([")[:1]
            if (m["word"] and m["mark"] == ".") or not (after.isdigit() or after.isupper()):
                continue
            yield text[begin : m.end("mark")]
            begin = m.end()
        yield text[begin:]

    def eval(self, row: Row, column: str, least: int = 4) -> Iterator[tuple]:
        kept = (s for s in self._cut(" ".join((row[column] or "").split())) if len(s.split()) >= least)
        for i, sentence in enumerate(kept):
            yield (*row, i, sentence)


class FirstWithin:
    """first_within(TABLE ... PARTITION BY key ORDER BY place, column, budget): the rows of each partition while the column's sum stays within the budget, with `used`; the rest of a partition isn't read."""

    def __init__(self) -> None:
        self.used = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(rows, [StructField("used", LongType())], column, budget)

    def eval(self, row: Row, column: str, budget: int) -> Iterator[tuple]:
        if self.used + (row[column] or 0) > budget:
            raise SkipRestOfInputTableException("the budget is used")
        self.used += row[column] or 0
        yield (*row, self.used)


FUNCTIONS = {"chunks": Chunks, "sentences_of": Sentences, "first_within": FirstWithin}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL in this session."""
    from pyspark.sql.functions import udtf

    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
