"""Chunkers as table functions of SQL: ``register(spark)``, then ``LATERAL paragraph_chunks(text)``.

The functions are Python table functions that exchange Arrow batches; they give the rows of the DataFrame
operators of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tallyforge.operators.documents import marker_cut
from tallyforge.operators.texts import paragraph_cut

CHUNKS = "chunk int, body string"


class ParagraphChunks:
    """paragraph_chunks(text [, size [, overlap]]): see ``operators.texts.paragraph_chunks``."""

    def eval(self, text: str, size: int = 1000, overlap: int = 2) -> Iterator[tuple[int, str]]:
        yield from enumerate(paragraph_cut(text, size, overlap))


class MarkerChunks:
    """marker_chunks(text, marker [, size [, least]]): see ``operators.documents.marker_chunks``."""

    def eval(self, text: str, marker: str, size: int = 1800, least: int = 200) -> Iterator[tuple[int, str]]:
        yield from enumerate(marker_cut(text, marker, size, least))


def register(spark: SparkSession) -> None:
    """Make the chunkers known to SQL in this session. A null text has no chunks."""
    for name, function in (("paragraph_chunks", ParagraphChunks), ("marker_chunks", MarkerChunks)):
        spark.udtf.register(name, udtf(function, returnType=CHUNKS, useArrow=True))
