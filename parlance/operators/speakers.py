"""Voiceprints matched to speaker profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import similarity

#: Profiles of one search; more are an error, as they are compared one by one.
MOST_PROFILES = 10_000


def profiles(vectors: DataFrame, key: str = "label", vector: str = "embedding") -> DataFrame:
    """(speaker, centroid): the mean of each speaker's vectors, to length 1."""
    each = vectors.select(F.col(key).alias("speaker"), F.posexplode(vector).alias("i", "x"))
    mean = each.groupBy("speaker", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = mean.groupBy("speaker").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("speaker", F.transform("v", lambda s: s["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return listed.select("speaker", F.transform("v", lambda x: x / norm).alias("centroid"))


def match(vectors: DataFrame, known: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = 0.58, margin: float = 0.06, near: float = 0.48) -> DataFrame:
    """(id, speaker, score, second, accepted): the nearest profile of each vector and the next best score.

    Accepted with a score of ``least``, or of ``near`` and a lead of ``margin``.
    Profiles are a bounded list, broadcast with its count checked.
    """
    if known.limit(MOST_PROFILES + 1).count() > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    listed = known.agg(F.sort_array(F.collect_list(F.struct("speaker", "centroid"))).alias("known"))
    # The place in the sorted list, counted back, puts the first of equal scores first whatever a speaker's key is.
    scored = vectors.select(id_col, vector).join(F.broadcast(listed)).select(id_col, "known", F.transform("known", lambda k, i: F.struct(similarity(F.col(vector), k["centroid"]).alias("score"), (-i).alias("back"))).alias("s"))
    ranked = scored.select(id_col, "known", F.sort_array("s", asc=False).alias("s"))
    first = F.get("s", F.lit(0))
    best = ranked.select(id_col, F.get("known", -first["back"])["speaker"].alias("speaker"), first["score"].alias("score"), F.coalesce(F.get("s", F.lit(1))["score"], F.lit(0.0)).alias("second"))
    return best.withColumn("accepted", (F.col("score") >= least) | ((F.col("score") >= near) & (F.col("score") - F.col("second") >= margin)))


def swapped(first_a: Column, first_b: Column, second_a: Column, second_b: Column) -> Column:
    """Whether two sources fit two speakers better the other way round: only if strictly so."""
    return (first_b + second_a) > (first_a + second_b)
