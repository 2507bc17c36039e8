"""Many patterns in one pass: an automaton of all of them, and which of overlapping spans count.

The patterns go to each executor once, in blocks of bounded size, and a worker
makes the automaton of a block once. Every text is read once a block, however
many patterns there are.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.staging import stage
from lodestone.operators.windows import free_spans

#: Characters of patterns in a block, about.
BLOCK = 8 << 20
#: Automata that a worker keeps, by the broadcast's number.
_MADE: dict[int, ahocorasick.Automaton] = {}


def _automaton(number: int, patterns: list[str]) -> ahocorasick.Automaton:
    if number not in _MADE:
        _MADE.clear()
        made = ahocorasick.Automaton()
        for i, pattern in enumerate(patterns):
            made.add_word(pattern, i)
        made.make_automaton()
        _MADE[number] = made
    return _MADE[number]


def _wordy(c: str) -> bool:
    return c == "_" or c.isalnum()


def occurrences(df: DataFrame, id_col: str, text_col: str, patterns: DataFrame, pattern: str, whole_words: bool = False, distinct: bool = False) -> DataFrame:
    """(id, start, end, pattern): every place of every pattern, also inside others; characters from 0, end exclusive.

    With ``whole_words`` a letter, digit or underscore must not go on beyond an
    end of the place that is one itself. With ``distinct`` there is one row for
    each id row and pattern, its first place. Null texts have no places, null
    and empty patterns none; repeated patterns count once, repeated rows each.
    """
    kind = df.schema[id_col].dataType.simpleString()
    known = patterns.select(F.col(pattern).alias("p")).where(F.char_length("p") > 0).distinct()
    total = known.agg(F.sum(F.char_length("p"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, start int, end int, pattern string"
    out = df.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        held = sorted(r["p"] for r in known.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == b).collect())
        if held:
            out = out.unionByName(rows.mapInArrow(_search(df.sparkSession.sparkContext.broadcast(held), whole_words, distinct), schema))
    return out


def _search(sent, whole_words: bool, distinct: bool):
    number = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = sent.value
        automaton = _automaton(number, patterns)
        sizes = [len(p) for p in patterns]
        for batch in batches:
            rows, starts, ends, found = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                text, seen = text.as_py() or "", set()
                for last, i in automaton.iter(text):
                    a, z = last + 1 - sizes[i], last + 1
                    if whole_words and ((a and _wordy(text[a - 1]) and _wordy(text[a])) or (z < len(text) and _wordy(text[z]) and _wordy(text[last]))):
                        continue
                    if distinct:
                        if i in seen:
                            continue
                        seen.add(i)
                    rows.append(row)
                    starts.append(a)
                    ends.append(z)
                    found.append(i)
            names = pa.array(patterns, pa.string()).take(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), names], ["id", "start", "end", "pattern"])

    return run


def _span_rows(spans: list[list[tuple[int, int]]], batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, start, end, pattern) of the spans of each row of (id, text, ...)."""
    rows = [row for row, found in enumerate(spans) for _ in found]
    flat = [x for found in spans for x in found]
    texts = batch.column(1).to_pylist()
    names = [texts[row][a:z] for row, (a, z) in zip(rows, flat, strict=True)]
    starts, ends = pa.array([a for a, _ in flat], pa.int32()), pa.array([z for _, z in flat], pa.int32())
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), starts, ends, pa.array(names, pa.string())], ["id", "start", "end", "pattern"])


def longest_spans(df: DataFrame, id_col: str, text_col: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(id, start, end, pattern): the places that a reader from the left takes, the longest at the first one, then on behind it.

    A text is judged where it is read, so no place is moved or stored. With
    several blocks of patterns each passes on the longest place at a start, as
    4-byte numbers beside the text; the last one judges. Each row is judged by
    itself, rows of one id too.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("binary").alias("found"))
    held = _blocks(patterns.select(F.col(pattern).alias("p")).where(F.char_length("p") > 0).distinct())
    if not held:
        return df.sparkSession.createDataFrame([], f"id {kind}, start int, end int, pattern string")
    for i, block in enumerate(held):
        last = i == len(held) - 1
        schema = f"id {kind}, start int, end int, pattern string" if last else f"id {kind}, text string, found binary"
        rows = rows.mapInArrow(_longest(df.sparkSession.sparkContext.broadcast(block), last), schema)
    return rows


def priority_spans(df: DataFrame, id_col: str, text_col: str, rules: DataFrame, pattern: str, priority: str) -> DataFrame:
    """(id, start, end, pattern, priority): the places in the order of their rules' priority (the least first) and place that overlap none taken before.

    Rules of one block of patterns are judged where the text is read, and each
    row by itself; more patterns go by way of all places and ``by_priority``.
    """
    known = rules.where(F.char_length(pattern) > 0).groupBy(F.col(pattern).alias("p")).agg(F.min(priority).alias("priority"))
    held = _blocks(known)
    if len(held) > 1:
        return by_priority(stage(occurrences(df, id_col, text_col, rules, pattern), "places"), rules, pattern, priority)
    kind = df.schema[id_col].dataType.simpleString()
    # one block of patterns at most
    ordered, levels = known.orderBy(F.col("priority").asc_nulls_first(), "p").collect(), []
    for before, here in zip([None, *ordered], ordered, strict=False):
        levels.append(levels[-1] + (here["priority"] != before["priority"]) if before else 0)
    sent = df.sparkSession.sparkContext.broadcast(([r["p"] for r in ordered], levels))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    taken = rows.where(F.lit(bool(ordered))).mapInArrow(_by_level(sent), f"id {kind}, start int, end int, pattern string")
    return taken.join(F.broadcast(known.withColumnRenamed("p", "pattern")), "pattern").select("id", "start", "end", "pattern", "priority")


def _by_level(sent):
    number = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, levels = sent.value
        automaton = _automaton(number, patterns)
        sizes = [len(p) for p in patterns]
        for batch in batches:
            done = []
            for value in batch.column(1):
                text = value.as_py() or ""
                covered, taken = bytearray(len(text)), []
                for _, a, z in sorted([(levels[i], at + 1 - sizes[i], at + 1) for at, i in automaton.iter(text)]):
                    if covered.find(1, a, z) < 0:
                        covered[a:z] = b"\1" * (z - a)
                        taken.append((a, z))
                done.append(taken)
            yield _span_rows(done, batch)

    return run


def _blocks(known: DataFrame) -> list[list[str]]:
    """The patterns ``p`` in blocks of about BLOCK characters."""
    total = known.agg(F.sum(F.char_length("p"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    found = [sorted(r["p"] for r in known.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == b).collect()) for b in range(blocks)]
    return [x for x in found if x]


def _longest(sent, last: bool):
    number = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(number, sent.value)
        sizes = [len(p) for p in sent.value]
        for batch in batches:
            done: list = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                before = array("i", found.as_py() or b"")
                ends = dict(zip(before[::2], before[1::2], strict=True))
                for at, i in automaton.iter(text.as_py() or ""):
                    a = at + 1 - sizes[i]
                    if ends.get(a, 0) <= at:
                        ends[a] = at + 1
                if not last:
                    done.append(array("i", [x for span in ends.items() for x in span]).tobytes())
                    continue
                taken, free = [], 0
                for a in sorted(ends):
                    if a >= free:
                        free = ends[a]
                        taken.append((a, free))
                done.append(taken)
            if last:
                yield _span_rows(done, batch)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.binary())], ["id", "text", "found"])

    return run


def leftmost_longest(places: DataFrame, id_col: str = "id") -> DataFrame:
    """Of ``occurrences``, those that a reader from the left takes: the longest at the first place, then on behind it."""
    ranked = places.withColumn("__rank", F.struct(F.col("start"), (-F.col("end")).alias("end")))
    return free_spans(ranked, id_col, "__rank", "start", "end").drop("__rank")


def by_priority(places: DataFrame, rules: DataFrame, pattern: str, priority: str, id_col: str = "id") -> DataFrame:
    """Of ``occurrences``, in the order of their rules' priority (the least first) and place, those that overlap none taken before, with the priority."""
    known = rules.groupBy(F.col(pattern).alias("pattern")).agg(F.min(priority).alias("priority"))
    return free_spans(places.join(known, "pattern"), id_col, "priority", "start", "end")
