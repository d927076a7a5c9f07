"""What the corpus operators share: the shared folder, materialising, narrow inputs, content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise, shared_dir

__all__ = ["checkpointed", "crc_bucket", "discard", "materialise", "narrow", "shared_dir"]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder, whether the context knows it yet or not."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under private names, so that further columns, however called, cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def crc_bucket(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the split into learning and held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)
