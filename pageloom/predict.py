"""The model boundary: pages in, lines out. A model is loaded once per Python worker; no model is part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as t
from .schema import LINES


def predictor(load: Callable[[], Callable[[bytes], list[dict]]]):
    """Arrow UDF image -> lines. A page that fails gives no lines, as an unreadable page would."""

    @F.pandas_udf(LINES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def one(image):
            try:
                return model(image)
            except Exception:  # noqa: BLE001 - a failed page is an empty hypothesis
                return []

        for batch in batches:
            yield batch.map(one)

    return run


def infer(images: DataFrame, load: Callable[[], Callable[[bytes], list[dict]]], image: str = "content") -> DataFrame:
    """Adds lines and hyp, the joined text, in place of the image."""
    rows = images.withColumn("lines", predictor(load)(image)).drop(image)
    return rows.withColumn("hyp", F.coalesce(t.joined(F.col("lines")), F.lit("")))


def tokens(model_file: str) -> Callable[[Column], Column]:
    """Subword pieces of a SentencePiece model as an Arrow UDF; the file must be readable by every worker."""

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            yield pd.Series(model.encode(batch.fillna("").tolist(), out_type=str, num_threads=1))

    return pieces


def token_text(model_file: str) -> Callable[[Column], Column]:
    """Text of a piece array."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            yield batch.map(lambda seq: model.decode_pieces([] if seq is None else list(seq)))

    return text
