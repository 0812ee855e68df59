"""Vector columns: L2 normalisation, query text and text encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import WHITE, tokenize

# Fixed values.
DIM = 384
NORM_FLOOR = 1e-9
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def l2_normalise(col: Column) -> Column:
    """Unit-length copy of an array; the divisor is floored so that zeros stay zeros."""
    wide = col.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(wide, lambda x: x / F.greatest(norm, F.lit(NORM_FLOOR)))


def query_text(col: Column) -> Column:
    """The text a query is encoded from; documents are encoded as they are."""
    return F.concat(F.lit(QUERY_PREFIX), F.regexp_replace(col, f"^[{WHITE}]+|[{WHITE}]+$", ""))


def embed_hashed(df: DataFrame, text_col: str = "text", out: str = "embedding", dim: int = DIM) -> DataFrame:
    """Default encoder: hashed term counts of the whole text, scaled to unit length, JVM-side."""
    tokens = df.withColumn("_tokens", tokenize(F.col(text_col)))
    counted = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_counts").transform(tokens)
    unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_counts", "_unit")


def embed_with(
    df: DataFrame,
    load_encoder: Callable[[], Callable],
    text_col: str = "text",
    out: str = "embedding",
) -> DataFrame:
    """Plug in an encoder: ``load_encoder()`` runs once per task and returns texts -> 2-D array."""

    def encode(batches: Iterator) -> Iterator:
        import numpy as np

        encoder = load_encoder()
        for pdf in batches:
            matrix = np.asarray(encoder(pdf[text_col].tolist()), dtype="float64")
            norm = np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
            yield pdf.assign(**{out: list((matrix / norm).astype("float32"))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(encode, f"{fields}, `{out}` array<float>")
