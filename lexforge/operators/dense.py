"""User-supplied models over tables; search over their vectors is in ``dense_index``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EMBED_BATCH


def embed(df: DataFrame, text_col: str, encoder: Callable[[list[str]], np.ndarray], dim: int, prefix: str = "", out_col: str = "embedding", batch: int = EMBED_BATCH) -> DataFrame:
    """df with unit-length vectors from a user's encoder, called with ``batch`` texts at a time. Write the result before using it twice."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = [prefix + (t or "") for t in pdf[text_col]]
            parts = [np.asarray(encoder(texts[i : i + batch]), dtype=np.float64).reshape(-1, dim) for i in range(0, len(texts), batch)]
            v = np.concatenate(parts) if parts else np.zeros((0, dim))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            yield pdf.assign(**{out_col: list(v.astype(np.float32))})

    return df.mapInPandas(run, schema)


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: words hashed to signed dimensions."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1.0 if h & 0x10000 else -1.0
        return out

    return encode


def map_model(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], list]], out_col: str, out_type: str, error_col: str = "error") -> DataFrame:
    """df with one column from a user's model and one with its error.

    ``make`` is called once per task, the model once per batch. A batch that fails is
    tried again row by row: rows that fail then have a null value and the error's text.
    """
    schema = df.withColumns({out_col: F.lit(None).cast(out_type), error_col: F.lit(None).cast("string")}).schema

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in it:
            errors: list[str | None] = [None] * len(pdf)
            try:
                values = list(model(pdf))
            except Exception as failed:  # noqa: BLE001 - a failing model must not fail the job
                values = [None] * len(pdf)
                if len(pdf) == 1:  # nothing to be told apart by asking again
                    errors[0] = str(failed)
                for i in range(len(pdf) if len(pdf) > 1 else 0):
                    try:
                        values[i] = list(model(pdf.iloc[i : i + 1]))[0]
                    except Exception as e:  # noqa: BLE001
                        errors[i] = str(e)
            yield pdf.assign(**{out_col: pd.Series(values, index=pdf.index, dtype=object), error_col: errors})

    return df.mapInPandas(run, schema)
