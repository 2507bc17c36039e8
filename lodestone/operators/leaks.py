"""Prompt leaks in cited evidence: fixed phrases, numbered laws, and hints that are contained or nearly repeated."""

from __future__ import annotations

import difflib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.operators.staging import stage
from lodestone.operators.substrings import contained

# Phrases of instructions that no evidence has.
PHRASES = [
    "strict forensic compliance auditor", "adversarial compliance challenger", "universal decision tree", "hallucination self check", "universal document scope",
    "never copy from expected evidence", "case a (grounded exact quote", "case b (partial evidence", "case c (no evidence", "case d (evidence matches", "case e (fuzzy",
    "verify the full lifecycle of identities", "expected evidence", "step 1: fresh start", "decision tree",
]
LAW = r"\blaw\s+([1-9]|10)\b"
QUOTES = "\"'“”"
#: Least characters of a hint, and the ratio of a near repeat.
HINT, RATIO = 15, 0.75
#: Words of the runs by which evidence and hints find each other.
RUN = 2


def bare(text: Column) -> Column:
    """Without white space and quotation marks at the ends, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, rf"^\s*[{QUOTES}]*\s*", ""), rf"\s*[{QUOTES}]*\s*$", ""))


def instructed(text: Column) -> Column:
    """Whether bare evidence has a phrase of the instructions or names a law by number."""
    return F.exists(F.array(*[F.lit(p) for p in PHRASES]), lambda p: F.contains(text, p)) | F.regexp_like(text, F.lit(LAW))


def _bounded_ratio(a: str, b: str, counted: dict[str, Counter]) -> float:
    """The matching-blocks ratio, or 0 where the letters that both have keep it below RATIO."""
    if a not in counted:
        if len(counted) >= 1024:
            counted.clear()
        counted[a] = Counter(a)
    shared = (counted[a] & Counter(b)).total()
    if 2 * shared < RATIO * (len(a) + len(b)):
        return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.arrow_udf(T.DoubleType())
def _ratio(hints: pa.Array, evidence: pa.Array) -> pa.Array:
    """The ratio of two texts, twice the matched characters over all; 0 for some below RATIO."""
    counted: dict[str, Counter] = {}
    return pa.array([_bounded_ratio(a.as_py(), b.as_py(), counted) for a, b in zip(hints, evidence, strict=True)], pa.float64())


def prompt_leaks(evidence: DataFrame, hints: DataFrame, id_cols: list[str], text: str, hint_id: str, hint: str) -> DataFrame:
    """(id columns, rule, hint): the leaks of each piece of evidence: PHRASE, CONTAINED or NEAR, the latter two with the hint's id.

    Hints of HINT characters or more count. CONTAINED is a substring join and
    finds every hint, wherever its words begin and end. For NEAR, evidence and
    hint meet by a shared run of RUN words, each hint by the rarest half of its
    runs and one more; a near repeat shares one of these unless it changes words
    all over. The ratio of a pair whose lengths differ too much for RATIO is not
    worked out (it is at most twice the shorter over the sum). Equal evidence is
    compared once. Null and empty evidence is clean.
    """
    own = evidence.select(*id_cols, bare(F.col(text)).alias("__e")).where("__e <> ''")
    told = own.where(instructed(F.col("__e"))).select(*id_cols, F.lit("PHRASE").alias("rule"), F.lit(None).cast(hints.schema[hint_id].dataType).alias("hint"))
    known = hints.select(F.col(hint_id).alias("hint"), bare(F.col(hint)).alias("__h")).where(F.char_length("__h") >= HINT)
    # lines repeat; each text is looked through once, by its digest
    texts = stage(own.select(F.sha2("__e", 256).alias("__k"), "__e").dropDuplicates(["__k"]), "evidence")
    inside = contained(texts, "__k", "__e", known, "hint", "__h").select(F.col("id").alias("__k"), F.col("needle").alias("hint"), F.lit("CONTAINED").alias("rule"))

    def runs(c: str) -> Column:
        return F.explode(F.array_distinct(X.ngrams(F.split(F.trim(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]+", " ")), " "), RUN))).alias("__r")

    # of the evidence only runs of hints are kept: the hints' runs are many times fewer
    asked = stage(known.select("hint", F.char_length("__h").alias("__n"), runs("__h")), "runs")
    wanted = asked.select("__r").distinct()
    left = stage(texts.select("__k", F.char_length("__e").alias("__m"), runs("__e")).join(wanted, "__r", "left_semi"), "met")
    often = left.groupBy("__r").agg(F.count("*").alias("__often"))
    place = Window.partitionBy("hint").orderBy("__often", "__r")
    ranked = asked.join(often, "__r").withColumn("__place", F.row_number().over(place)).withColumn("__all", F.count("*").over(Window.partitionBy("hint")))
    rare = ranked.where(F.col("__place") <= F.col("__all") / 2 + 1)
    near = 2 * F.least("__m", "__n") >= RATIO * (F.col("__m") + F.col("__n"))
    met = left.join(rare, "__r").where(near).select("__k", "hint").distinct().join(inside.select("__k", "hint"), ["__k", "hint"], "left_anti")
    close = met.join(texts, "__k").join(known, "hint").where(_ratio("__h", "__e") >= RATIO).select("__k", "hint", F.lit("NEAR").alias("rule"))
    found = inside.unionByName(close)
    return told.unionByName(own.withColumn("__k", F.sha2("__e", 256)).join(found, "__k").select(*id_cols, "rule", "hint"))
