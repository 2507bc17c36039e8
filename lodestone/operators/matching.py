"""Join operators: dictionary matches, cascades of keys, defaults for missing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.retrieval import similarities
from lodestone.operators.staging import stage
from lodestone.operators.substrings import contained
from lodestone.operators.windows import first_per


def left_with(df: DataFrame, other: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join whose missing values take ``defaults``."""
    out = df.join(other, on, "left")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def absent(df: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` with no row in ``existing``, nulls being equal to nulls."""
    cond = F.lit(True)
    other = existing.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(other, cond, "left_anti")


def cascade(df: DataFrame, steps: list[tuple[Column, DataFrame, str, str]], out: str) -> DataFrame:
    """The first hit of several equi-joins: each step is (key, table, key column, value column)."""
    found = []
    for i, (key, table, on, value) in enumerate(steps):
        side = table.select(F.col(on).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        df = df.join(side, key == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        found.append(F.col(f"__v{i}"))
    return df.withColumn(out, F.coalesce(*found)).drop(*[f"__v{i}" for i in range(len(steps))])


#: Keywords that are looked for inside each row; more of them meet the texts' runs of words in a join.
INLINE = 256


def longest_keyword(df: DataFrame, id_col: str, text: str, keywords: DataFrame) -> DataFrame:
    """(id, value, keyword): the value of the longest keyword that the text contains; ties by keyword, then value.

    Keywords match whole words. Up to INLINE of them are tested inside the row,
    without a shuffle. Of a larger dictionary, a text gives its distinct runs of
    as many words as keywords have, without the text itself, and these meet the
    keywords in an equi-join: nothing is moved but ids of hits. Both give the
    same rows.
    """

    def bare(c: str) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.col(c)), r"[^a-z0-9]+", " "))

    known = keywords.select(bare("keyword").alias("keyword"), "value").where("keyword <> ''").distinct()
    few = known.limit(INLINE + 1).collect()
    if not few:
        return df.select(F.col(id_col).alias("id"), F.lit(None).cast(known.schema["value"].dataType).alias("value"), F.lit("").alias("keyword")).where(F.lit(False))
    if len(few) <= INLINE:
        # longest first, so the first hit counts
        few.sort(key=lambda r: (-len(r["keyword"]), r["keyword"], r["value"]))
        rows = F.array(*[F.struct(F.lit(r["value"]).alias("value"), F.lit(r["keyword"]).alias("keyword")) for r in few])
        padded = F.concat(F.lit(" "), bare(text), F.lit(" "))
        hit = T.bound(padded, lambda x: F.get(F.filter(rows, lambda k: F.contains(x, F.concat(F.lit(" "), k["keyword"], F.lit(" ")))), F.lit(0)))
        return df.select(F.col(id_col).alias("id"), hit.alias("hit")).where("hit IS NOT NULL").select("id", "hit.value", "hit.keyword")
    # the lengths of keywords, in words: a handful of numbers
    lengths = sorted(r[0] for r in known.select(F.size(F.split("keyword", " "))).distinct().collect())
    words = F.split(bare(text), " ")
    runs = [F.array_distinct(T.ngrams(words, n) if n > 1 else words) for n in lengths]
    left = df.select(F.col(id_col).alias("id"), F.explode(F.concat(*runs)).alias("keyword"))
    return first_per(left.join(known, "keyword"), ["id"], [F.desc(F.char_length("keyword")), F.col("keyword"), F.col("value")]).select("id", "value", "keyword")


def token_overlap(df: DataFrame, id_col: str, text: str, table: DataFrame, key: str, label: str, least: int = 2) -> DataFrame:
    """(id, key, shared): the row of ``table`` whose label shares most distinct words with the text, at least ``least``."""

    def words(c: str) -> Column:
        return F.explode(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.col(c)), r"[^a-z0-9]+", " "), " "), lambda w: F.char_length(w) > 3)))

    left = df.select(F.col(id_col).alias("id"), words(text).alias("word"))
    right = table.select(F.col(key).alias("key"), words(label).alias("word"))
    shared = left.join(right, "word").groupBy("id", "key").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return first_per(shared, ["id"], [F.desc("shared"), F.col("key")])


#: Names of an upload list up to which citations are compared with each.
UPLOADS = 1_000


def containment(df: DataFrame, cited: str, names: DataFrame, name: str) -> DataFrame:
    """(cited, name): the exact name, else the longest name that contains the citation or lies in it; letters compare in lower case.

    A short list of names is compared one by one; a longer one meets the
    citations by two substring joins, one in each direction. Both give the same
    rows; null and empty citations and names match nothing.
    """
    left = df.select(F.col(cited).alias("cited")).where(F.col(cited) != "").distinct()
    right = names.select(F.col(name).alias("name")).where(F.col(name) != "").distinct()
    if right.limit(UPLOADS + 1).count() <= UPLOADS:
        a, b = F.lower("cited"), F.lower("name")
        hits = left.join(F.broadcast(right), F.contains(a, b) | F.contains(b, a))
    else:
        asked, held = left.withColumn("low", F.lower("cited")), right.withColumn("low", F.lower("name"))
        inside = contained(held, "name", "low", asked, "cited", "low").select(F.col("needle").alias("cited"), F.col("id").alias("name"))
        around = contained(asked, "cited", "low", held, "name", "low").select(F.col("id").alias("cited"), F.col("needle").alias("name"))
        hits = inside.unionByName(around).distinct()
    same = F.lower("cited") == F.lower("name")
    return first_per(hits, ["cited"], [F.desc(same), F.desc(F.char_length("name")), F.col("name")])


def first_source(frames: list[DataFrame], key: str) -> DataFrame:
    """Union of frames with one schema; for each key the row of the first frame that has it."""
    both = None
    for i, df in enumerate(frames):
        df = df.withColumn("__i", F.lit(i))
        both = df if both is None else both.unionByName(df)
    return first_per(both, [key], [F.col("__i")]).drop("__i")


def resolve_controls(rows: DataFrame, controls: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, control, step): the control of each row by its id, else its name, else the longest keyword in its text, else its vector.

    ``rows`` are (id, id_text, name_text, text, vector) with unique ids, ``controls``
    (control, name, keyword, vector), one row each. Ids and names compare in lower
    case without white space at their ends; equal names go to the least control.
    A vector counts with a cosine above ``least``. Each step sees only the rows
    that those before it left; a row that none resolves has a null control.
    """
    bare = lambda c: F.lower(F.trim(F.col(c)))

    def equal(left: DataFrame, column: str, of: str) -> DataFrame:
        known = controls.groupBy(bare(of).alias("key")).agg(F.min("control").alias("control")).where("key <> ''")
        return left.join(known, bare(column) == F.col("key")).select("id", "control")

    def by_vector(left: DataFrame) -> DataFrame:
        asked = controls.where(F.size("vector") > 0).select(F.col("control").alias("query"), "vector")
        near = similarities(left.where(F.size("vector") > 0), asked, "id", "vector").where(F.col("similarity") > least)
        return first_per(near, ["id"], [F.desc("similarity"), F.col("query")]).select("id", F.col("query").alias("control"))

    keywords = controls.select("keyword", F.col("control").alias("value"))
    steps = [
        ("id", lambda left: equal(left, "id_text", "control")),
        ("name", lambda left: equal(left, "name_text", "name")),
        ("keyword", lambda left: longest_keyword(left, "id", "text", keywords).select("id", F.col("value").alias("control"))),
        ("vector", by_vector),
    ]
    left, out = rows, None
    for step, found in steps:
        hits = stage(found(left).select("id", "control", F.lit(step).alias("step")), "resolved")
        out = hits if out is None else out.unionByName(hits)
        left = left.join(hits.select("id"), "id", "left_anti")
    return out.unionByName(left.select("id", F.lit(None).cast(out.schema["control"].dataType).alias("control"), F.lit("none").alias("step")))
