"""What several operators of this subpackage share: tables, written intermediate results, words and labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.shared import drop_written, written

__all__ = ["ascii_words", "bounded_batches", "drop_written", "held_out", "label_votes", "labelled_sample", "per_text", "plain", "squeezed", "table", "written"]

#: ASCII white space that separates words: space and the codes 9 to 13.
WORD_SPACE = " \t\n\x0b\x0c\r"


#: The most bytes of rows that Python gets at once; a longer text is a batch of its own.
BATCH_BYTES = 4 * 2**20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Set the session so that batches that go to Python end at BATCH_BYTES; a task's memory then does not depend on how long its texts are together."""
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text as UTF-8; bytes.split() knows exactly this white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def squeezed(texts: pd.Series) -> pd.Series:
    """Texts as they go through a shuffle, about two thirds of what Spark's own compression leaves."""
    z = zstandard.ZstdCompressor(level=1)
    return texts.map(lambda t: None if t is None else z.compress(t.encode("utf-8", "surrogatepass")))


def plain(raw: bytes | None) -> str | None:
    return None if raw is None else zstandard.decompress(bytes(raw)).decode("utf-8", "surrogatepass")


def label_votes(labels: DataFrame, column: str = "quality") -> DataFrame:
    """One row per labelled doc_id (repeated labels vote, ties count as 0): doc_id, label; null ids and labels are left out."""
    votes = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return votes.groupBy("doc_id").agg((F.avg(F.col(column).cast("double")) > 0.5).cast("int").alias("label"))


def held_out(doc_id="doc_id"):
    """True where crc32 of the id's decimal text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, most: int, column: str = "quality", training_only: bool = False) -> DataFrame:
    """At most `most` labelled ids, picked by hash, so the same labels give the same sample; `most` bounds its size for a broadcast."""
    votes = label_votes(labels, column)
    if training_only:
        votes = votes.where(~held_out())
    return votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def per_text(function: Callable[[str | None], tuple], schema: str):
    """A vectorised function from a text column to a struct of `schema`; `function` gives the values for one text. Integer columns may hold None."""
    names = [c.split()[0] for c in schema.split(", ")]
    whole = {n: "Int64" for n, c in zip(names, schema.split(", ")) if c.endswith(" long")}

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in texts:
            yield pd.DataFrame([function(t) for t in x], columns=names).astype(whole)

    return F.pandas_udf(batches, schema)
