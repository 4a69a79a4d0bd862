"""Lines as a stream: every operator on single lines works on it as it does on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hecespark.functions import chars
from hecespark.operators import normalize, text


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def rendered(lines: DataFrame, fold: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, line, words): each line with its circumflexes folded in words if ``fold``, and the number of its words. Stateless."""
    parts = text.chunks("value")
    shown = F.transform(parts, lambda c: F.when(text.kind(c) == "word", chars.fold(c)).otherwise(c)) if fold else parts
    return lines.select(*keep, F.coalesce(F.array_join(shown, ""), F.lit("")).alias("line"), F.coalesce(F.size(F.filter(parts, lambda c: text.kind(c) == "word")), F.lit(0)).alias("words"))


def summary(lines: DataFrame) -> DataFrame:
    """One row (lines, words), kept up as the stream goes."""
    return rendered(lines).agg(F.count("*").alias("lines"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))


def write(lines: DataFrame, folder: str, checkpoint: str, mode: str = "surface", fold: bool = False, clitics: bool = True, separator: str = normalize.SEPARATOR, **options) -> StreamingQuery:
    """Each line in one of normalize.MODES to text files in folder, once each; a blank line is an empty one."""
    made = normalize.lines(lines, mode, "value", (), fold, clitics, separator, **options)
    return made.withColumnRenamed("line", "value").writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
