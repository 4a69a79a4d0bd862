"""The morphotactic graph and the lexicon as tables: reachability, references that lead nowhere, roots that begin a word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hecespark.runtime import cut


def reachable(edges: DataFrame, starts: list[str]) -> DataFrame:
    """(start, state): all states that can be reached from each start, itself among them. The graph is of fixed size; rounds end when nothing is new."""
    spark = edges.sparkSession
    e = F.broadcast(edges.select("from_state", "to_state").distinct())
    found = frontier = spark.createDataFrame([(s, s) for s in starts], "start string, state string")
    while not frontier.isEmpty():
        frontier = frontier.join(e, F.col("state") == F.col("from_state")).select("start", F.col("to_state").alias("state")).distinct().join(found, ["start", "state"], "left_anti")
        frontier = cut(frontier)
        found = found.unionByName(frontier)
    return found


def dangling(edges: DataFrame, suffixes: DataFrame, states: DataFrame) -> DataFrame:
    """Edges that name a suffix or a state that isn't there."""
    s, t = suffixes.select(F.col("id").alias("suffix_id")), states.select("state")
    lost = [edges.join(s, "suffix_id", "left_anti"), *(edges.join(t, edges[c] == t["state"], "left_anti") for c in ("from_state", "to_state"))]
    return lost[0].unionByName(lost[1]).unionByName(lost[2]).distinct()


def prefix_match(words: DataFrame, word: str, forms: DataFrame) -> DataFrame:
    """(word, root_id, surf, size): forms (key, surf, root_id) that begin each word, of all lengths: an equi-join on the word's beginnings."""
    longest = forms.agg(F.max(F.length("key"))).first()[0] or 0
    begins = words.where(F.length(word) > 0).select(word, F.explode(F.sequence(F.lit(1), F.least(F.length(word), F.lit(max(1, longest))))).alias("size"))
    return begins.withColumn("key", F.substring(F.col(word), F.lit(1), F.col("size"))).join(forms, "key").select(word, "root_id", "surf", "size")
