"""Set-similarity join: equal sets are one, rare words come first, and prefixes and counts of shared words bound the overlap.

Rows with equal sets are folded to a class first, so copies cost one row. Words
are ordered by how frequent they are; two similar sets share some words among
the first few of that order, so mostly rare words meet. Sets that share many of
these (near copies of one text) have a home, where blocks of them are compared
at once: what moves for them are sets, not pairs. Only pairs without a common
home meet by words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.staging import stage

#: Words that a pair must share among the first of its sets, or all that it needs if they are fewer.
SHARED = 3
#: Words with their numbers of rows that each task holds; the others are rarer, and ordered by hash.
COMMON = 1 << 20
#: Rows up to which a word is rare, where COMMON allows it.
RARE = 16
#: Words of a set that look for its home, and the least sets of a home.
MARKS, CROWD = 8, 64
#: Sets of a block, and words by which two blocks are multiplied at a time.
BLOCK, WIDTH = 1024, 2048
#: Bits that tell which sets a comparison needs, and those of one of Spark's bitmaps.
BITS, BITMAP = 1 << 26, 1 << 15
#: Bits of a set's sketch.
SKETCH = 512


def _ceil(x: Column) -> Column:
    """Upwards, but for rounding errors of products with the threshold."""
    return F.ceil(x - 1e-9).cast("int")


def _common_words(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, ascending, and numbers of rows of the most frequent words, at most COMMON."""
    words = sets.select(F.explode(_hashes()).alias("key")).groupBy("key").agg(F.count("*").alias("rows"))
    words = stage(words.where(F.col("rows") > RARE), "words")
    # a row for each power of two
    levels = words.groupBy(F.floor(F.log2("rows")).alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    least, held = 1 << 62, 0
    for r in levels:
        held += r["n"]
        if held > COMMON:
            break
        least = 1 << r["level"]
    found = words.where(F.col("rows") >= least).orderBy("key").toArrow()
    return found["key"].to_numpy(), found["rows"].to_numpy()


def _hashes() -> Column:
    return F.transform("w", lambda x: F.xxhash64("g", x))


def _first_words(common: object, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches (id, n, keys), (id, n, first, sketch): a set's first words, by hash, in the order of frequency and hash.

    A bit of the sketch is 1 if an odd number of the set's words have it, so two sets differ by as many words as sketches by bits, or more.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = common.value
        for batch in batches:
            ids, n, lists = batch.columns
            keys, size = lists.flatten().to_numpy(), n.to_numpy()
            of = np.repeat(np.arange(len(size)), size)
            frequency = np.zeros(len(keys), np.int64)
            if len(known):
                near = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                frequency = np.where(known[near] == keys, rows[near], 0)
            order = np.lexsort((keys, frequency, of))
            take = np.minimum(size, size - np.ceil(least * size - 1e-9).astype(np.int64) + SHARED)
            at = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
            kept = keys[order][at < np.repeat(take, size)]
            ends = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
            odd = np.bincount(of * SKETCH + (keys & SKETCH - 1), minlength=len(size) * SKETCH) & 1
            words = np.packbits(odd.astype(np.uint8)).view(np.int64)
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(words))
            yield pa.RecordBatch.from_arrays([ids, n, pa.ListArray.from_arrays(pa.array(ends), pa.array(kept)), sketches], names=["id", "n", "first", "sketch"])

    return first


def _homes(firsts: DataFrame) -> DataFrame:
    """(id, home, n_home): sets that have many words in common with many others; which those are has no effect on the result."""
    marks = F.slice(F.array_sort(F.transform("first", lambda x: F.xxhash64(x))), 1, MARKS)
    marks = firsts.select("id", F.explode(marks).alias("mark"))
    crowds = marks.groupBy("mark").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD)
    marks = stage(marks.join(crowds, "mark"), "marks")
    # the mark that most sets have, then for each mark the home of most of its sets, then for each set that of most of its marks
    begun = marks.groupBy("id").agg(F.max_by("mark", F.struct("n", "mark")).alias("home"))
    told = marks.join(begun, "id").groupBy("mark", "home").agg(F.count("*").alias("n")).groupBy("mark").agg(F.max_by("home", F.struct("n", "home")).alias("home"))
    votes = marks.join(told, "mark").groupBy("id", "home").agg(F.count("*").alias("votes"), F.sum("n").alias("n"))
    homes = votes.groupBy("id").agg(F.max_by("home", F.struct("votes", "n", "home")).alias("home"))
    large = homes.groupBy("home").agg(F.count("*").alias("n_home")).where(F.col("n_home") >= CROWD)
    return stage(homes.join(large, "home").select("id", "home", "n_home"), "homes")


def _compare_blocks(least: float) -> Callable[[pa.Table], pa.Table]:
    """The similar pairs of two blocks, or of one with itself, of rows (id, w, block, i, j)."""

    def compare(rows: pa.Table) -> pa.Table:
        lists = rows["w"].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        codes = lists.flatten().dictionary_encode().indices.to_numpy()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(size)), size)
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        block = rows["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        place = np.zeros(len(size), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        # words of one set are in no overlap
        often = np.bincount(codes) > 1
        number = np.cumsum(often) - 1
        kept = often[codes]
        codes, of = number[codes[kept]], of[kept]
        order = np.argsort(codes, kind="stable")
        codes, of = codes[order], of[order]
        common = np.zeros((len(left), len(right)), np.int64)
        for start in range(0, int(number[-1]) + 1 if len(number) else 0, WIDTH):
            x, y = np.searchsorted(codes, [start, start + WIDTH])
            c, o = codes[x:y] - start, of[x:y]
            sides = []
            for rank, count in ((i, len(left)), (j, len(right))):
                mine = block[o] == rank
                side = np.zeros((count, WIDTH), np.float32)
                side[place[o[mine]], c[mine]] = 1
                sides.append(side)
            common += (sides[0] @ sides[1].T).astype(np.int64)
        a, b = np.nonzero(common / (size[left][:, None] + size[right][None, :] - common) >= least)
        ids = rows["id"]
        ends = pa.table({"a": ids.take(pa.array(left[a])), "b": ids.take(pa.array(right[b]))})
        # each pair once, also of a block with itself
        return ends.filter(pa.array(a < b)) if i == j else ends

    return compare


def _at_home(own: DataFrame, homes: DataFrame, least: float) -> DataFrame:
    """(a, b): the similar sets of one home; a set moves as often as its home has blocks."""
    blocks = F.ceil(F.col("n_home") / BLOCK).cast("int")
    dealt = homes.select("id", "home", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    dealt = dealt.select("id", "home", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = own.join(dealt, "id").select("id", "w", "block", "home", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    kind = own.schema["id"].dataType.simpleString()
    return dealt.groupBy("home", "i", "j").applyInArrow(_compare_blocks(least), f"a {kind}, b {kind}")


def _needed(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """The sets whose id is in ``asked``, and a few others that share a bit with one of these.

    The bits are sent to the sets, BITS of them at most, so that only what is needed is moved afterwards.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(BITS))
    part, bit = F.floor(place / BITMAP), F.pmod(place, F.lit(BITMAP))
    # dealt by part first: else each task would send its own bitmap of a part
    bits = asked.select(part.alias("part"), bit.alias("bit")).repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # BITS / 8 bytes at most
    return sets.join(F.broadcast(bits), part == F.col("part")).where(F.getbit(byte, F.pmod(bit, F.lit(8))) == 1).select(*sets.columns)


def similar_sets(df: DataFrame, id_col: str, within: str, words: Column, least: float) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): (id, within, class) of every row, and (a, b), a < b, of the classes whose sets have a Jaccard similarity of ``least`` or more.

    Rows compare inside one value of ``within``. A class is the least id of the
    rows with its set; ids are unique. Null words are no words, a null array is
    an empty set, and empty sets are alike. Rows whose ``within`` is null have a
    class and no pairs. A frequent word stands in no prefix of a set that has
    enough rarer ones. Words meet by their hashes; sets are compared by the words.
    """
    bare = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(words, F.array().cast("array<string>")))))
    sets = stage(df.select(F.col(id_col).alias("id"), F.col(within).alias("g"), bare.alias("w")).withColumn("d", F.unhex(F.sha2(F.to_json("w"), 256))), "sets")
    folded = stage(sets.groupBy("g", "d").agg(F.min("id").alias("class")), "classes")
    # only digests are fetched for the members
    classes = sets.select("id", "g", "d").join(folded.withColumnRenamed("g", "h"), ["d"]).where(F.col("g").eqNullSafe(F.col("h"))).select("id", F.col("g").alias(within), "class")
    full = sets.where("g IS NOT NULL AND size(w) > 0")
    common = df.sparkSession.sparkContext.broadcast(_common_words(full))
    kind = sets.schema["id"].dataType.simpleString()
    firsts = full.select("id", F.size("w").alias("n"), _hashes().alias("keys")).mapInArrow(_first_words(common, least), f"id {kind}, n int, first array<bigint>, sketch array<bigint>")
    firsts = stage(firsts.join(folded.select(F.col("class").alias("id")), "id", "left_semi"), "firsts")
    homes = _homes(firsts)
    keys = firsts.join(homes.select("id", "home"), "id", "left").select("id", "n", "home", F.posexplode("first").alias("at", "key"))
    # the smaller set of a pair shares its words among still fewer
    short = F.col("at") < F.col("n") - _ceil(2 * least / (1 + least) * F.col("n")) + SHARED
    a, b = ([F.col(c).alias(c if c == "key" else f"{c}{x}") for c in ("key", "id", "n", "home", "at")] for x in ("a", "b"))
    needed = _ceil(least / (1 + least) * (F.col("na") + F.col("nb")))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ida") < F.col("idb")))
    sized = F.col("na") >= _ceil(least * F.col("nb"))
    placed = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) > needed - SHARED
    apart = F.coalesce(F.col("homea") != F.col("homeb"), F.lit(True))
    met = keys.where(short).select(a).join(keys.select(b), "key").where(apart & smaller & sized & placed)
    near = met.groupBy(F.col("ida").alias("a"), F.col("idb").alias("b")).agg(F.count("*").alias("n"), F.min(F.least(needed, F.lit(SHARED))).alias("least"))
    near = near.where(F.col("n") >= F.col("least")).select("a", "b")
    # sketches are smaller than sets, and most of the pairs that are not similar end here
    for x in ("a", "b"):
        near = near.join(firsts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), x)
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = stage(near.where(differ <= F.col("na") + F.col("nb") - 2 * needed).select("a", "b"), "near")
    # the sets that any comparison needs are fetched once, and the others stay where they are
    asked = near.select(F.explode(F.array("a", "b")).alias("id")).union(homes.select("id"))
    own = stage(_needed(full.select("id", "w"), asked), "compared")
    sides = [own.select(F.col("id").alias(x), F.col("w").alias(f"w{x}")) for x in ("a", "b")]
    both = near.join(sides[0], "a").join(sides[1], "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    alike = both.where(shared / (F.size("wa") + F.size("wb") - shared) >= least).select("a", "b").unionByName(_at_home(own, homes, least))
    return classes, alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def class_links(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class, n_links): each row's class, and how many other classes are similar to it."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.count("*").alias("n_links"))
    return classes.join(ends, F.col("class") == F.col("of"), "left").select("id", "class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
