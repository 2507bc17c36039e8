"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut in two segments of 32 bits. Two fingerprints that differ
in at most three bits differ in at most one bit of one segment, so each
fingerprint is stored in two tables under its segments, and looks up the
Hamming ball of radius one about each segment. Fetched fingerprints are
verified over all 64 bits. Links come out as a spanning forest for each table
entry, never as all pairs. Exact repeats are one fingerprint from the start.

``similar_documents`` searches in the same way for a Jaccard similarity of
5-word shingles, where pairs differ in a sixth of the bits: by more segments of
a wider fingerprint, with balls of the bits that are nearest to a tie.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm import common
from lodestone.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE = 3
SEED = 42
RADIUS = 3
#: A table entry with more members than this is cut by bits of the other segment.
DENSE = 8192
#: Bits of the other segment that cut dense entries, level by level: 32 bits in
#: 4 bytes, then each remaining run again in 4. With at most 3 differing bits,
#: one of the 4 cuts is equal, so no link is lost.
LEVELS = 2


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the 3-word shingles of ``text`` as an unsigned number; 0 without words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    words = WORD.findall(data)
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    bits = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        h = np.array([digest(line[a:z], SEED) for a, z in zip(starts[lo:hi].tolist(), ends[lo + SHINGLE - 1 : hi + SHINGLE - 1].tolist(), strict=True)], ">u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


_FOLD = bytes.maketrans(common.UPPER.encode(), common.LOWER.encode())


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64))



def _entries(prints: DataFrame) -> DataFrame:
    """(seg, key, path, fp, probe): each print under its own segments, and as a probe under those one zero bit away.

    Of two segments that differ in one bit, the one with the zero probes the other.
    """
    segments = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), (F.shiftrightunsigned("fp", 32 * (1 - s)).bitwiseAND(F.lit(0xFFFFFFFF))).alias("own")) for s in (0, 1)])).alias("s")
    cut = prints.select("fp", segments).select("fp", "s.seg", "s.own")
    balls = cut.select("fp", "seg", "own", F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("bit"))
    mask = F.when(F.col("bit") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, greatest(bit, 0))"))
    balls = balls.withColumn("mask", mask).where(F.col("own").bitwiseAND(F.col("mask")) == 0)
    return balls.select("seg", F.col("own").bitwiseOR(F.col("mask")).alias("key"), F.lit("").alias("path"), "fp", (F.col("bit") >= 0).alias("probe"))


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``prints``."""
    left, out = prints.view(np.uint64), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(left ^ at) <= RADIUS
            if near.any():
                out += [(int(at), int(x)) for x in left[near]]
                reached += list(left[near])
                left = left[~near]
    return out


FOUND = pa.schema([("seg", pa.int32()), ("key", pa.int64()), ("path", pa.string()), ("fp", pa.int64()), ("probe", pa.bool_()), ("b", pa.int64())])


def _match(last: bool):
    """Read sorted entries; emit links as (fp, b), and the rows of dense entries with a null b."""

    def emit(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        dense: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            seg, key = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            path = batch.column(2).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (key[1:] != key[:-1]) | (path[1:] != path[:-1]))))
            lasts = int(new[-1])
            identity = (int(seg[0]), int(key[0]), str(path[0]))
            begin = 0
            if dense is not None:
                # an entry already found dense goes on: pass its rows through
                stop = (int(new[1]) if len(new) > 1 else batch.num_rows) if dense == identity else 0
                if stop:
                    yield _open(batch.slice(0, stop))
                    begin = stop
                if begin < batch.num_rows:
                    dense = None
            if begin < batch.num_rows:
                if lasts > begin:
                    yield from settle([*held, batch.slice(begin, lasts - begin)])
                    held = [batch.slice(lasts)]
                elif lasts == begin and held and _same(held[-1], batch, begin):
                    held.append(batch.slice(begin))
                else:
                    if held:
                        yield from settle(held)
                    held = [batch.slice(begin)]
                size = sum(x.num_rows for x in held)
                if not last and size > DENSE:
                    dense = _identity(held[-1], held[-1].num_rows - 1)
                    for x in held:
                        if _identity(x, 0) == dense:
                            yield _open(x)
                        else:
                            at = _first_of(x, dense)
                            yield from settle([x.slice(0, at)])
                            yield _open(x.slice(at))
                    held = []
        if held:
            yield from settle(held)

    def settle(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        seg, key = np.asarray(whole.column(0)), np.asarray(whole.column(1))
        path = whole.column(2).to_numpy()
        fp, probe = np.asarray(whole.column(3)), whole.column(4).to_numpy()
        new = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (key[1:] != key[:-1]) | (path[1:] != path[:-1]))))
        sizes = np.diff(np.append(new, len(seg)))
        rows = []
        for a, n in zip(new[(sizes > 1) & ~probe[new].astype(bool)].tolist(), sizes[(sizes > 1) & ~probe[new].astype(bool)].tolist(), strict=True):
            if not last and n > DENSE:
                yield _open(pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in whole.slice(a, n).columns], schema=whole.schema))
                continue
            members = np.unique(fp[a : a + n])
            for u, v in _forest(members):
                rows.append((0, 0, "", u - (1 << 64) if u >> 63 else u, False, v - (1 << 64) if v >> 63 else v))
            if len(rows) > 50_000:
                yield emit(rows)
                rows = []
        if rows:
            yield emit(rows)

    return run


def _identity(batch: pa.RecordBatch, i: int) -> tuple:
    return batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()


def _same(a: pa.RecordBatch, b: pa.RecordBatch, at: int) -> bool:
    return _identity(a, a.num_rows - 1) == _identity(b, at)


def _first_of(batch: pa.RecordBatch, identity: tuple) -> int:
    i = batch.num_rows
    while i and _identity(batch, i - 1) == identity:
        i -= 1
    return i


def _open(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(batch.columns, FOUND, strict=False)], pa.nulls(batch.num_rows, pa.int64())], schema=FOUND)


def links(prints: DataFrame) -> DataFrame:
    """A spanning set of links (a, b) among the distinct fingerprints ``fp``: equal components to all pairs within 3 bits."""
    schema = "seg int, key bigint, path string, fp bigint, probe boolean, b bigint"
    entry = ["seg", "key", "path"]
    entries, found = _entries(prints), None
    for level in range(LEVELS + 2):
        last = level > LEVELS
        placed = entries.select(*entry, "fp", "probe").repartition(*entry).sortWithinPartitions(*entry, "probe")
        out = common.stage(placed.mapInArrow(_match(last), schema), "links")
        here = out.where("b IS NOT NULL").select(F.col("fp").alias("a"), "b")
        found = here if found is None else found.unionByName(here)
        dense = out.where("b IS NULL")
        if last or dense.isEmpty():
            return found.distinct()
        other = "shiftrightunsigned(fp, IF(seg = 0, 0, 32)) & 4294967295"
        if level == 0:
            part = [F.expr(f"concat(path, '{j}:', shiftrightunsigned({other}, {8 * j}) & 255, '/')") for j in range(4)]
        elif level < LEVELS:
            rest = "aggregate(filter(sequence(0, 3), j -> NOT startswith(path, concat(j, ':'))), 0L, (s, j) -> shiftleft(s, 8) | (shiftrightunsigned({o}, 8 * j) & 255))".format(o=f"({other})")
            part = [F.expr(f"concat(path, '{j}:', shiftrightunsigned({rest}, {6 * j}) & 63, '/')") for j in range(4)]
        else:
            # no bits are left to cut by: blocks of the entry, and each pair of them in one place
            sizes = dense.groupBy(*entry).agg(F.count("*").alias("n"))
            dense = dense.join(sizes, entry).withColumn("blocks", F.ceil(F.col("n") * 2 / DENSE).cast("int"))
            part = F.transform(_block_pairs(F.xxhash64("fp")), lambda x: F.concat("path", F.lit("b"), x.cast("string")))
        entries = dense.withColumn("path", F.explode(part if level == LEVELS else F.array(*part)))
    raise AssertionError


def _block_pairs(hashed: Column) -> Column:
    """The numbers of the pairs of blocks (of ``blocks`` of them) that a row belongs to; 0 where there is one block.

    Links inside a block are found in its pairs with the others.
    """
    n = F.col("blocks")
    own = F.pmod(hashed, n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(own, j) * n + F.greatest(own, j))
    return F.filter(pairs, lambda x: (n == 1) | (F.floor(x / n) != x % n))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for each row of ``df``.

    component_id is the least id among all documents reachable by links of at
    most 3 differing bits. Null and empty texts have the fingerprint zero and
    are linked like any other; repeated rows stay; a null id gets the component
    of its fingerprint and is never a component's name unless all ids in it
    are null. Whole texts are read; other columns are left out; an empty table
    gives no rows.
    """
    docs = common.stage(df.select(F.col(id_col).alias("id"), _fingerprints(F.col(text_col)).alias("fp")), "prints")
    prints = docs.groupBy("fp").agg(F.min("id").alias("least"))
    joined = connected_components(links(prints.select("fp")))
    placed = prints.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(names, "component").select(F.col("fp").alias("print"), "component_id")
    return docs.join(known, F.col("fp") == F.col("print"), "left").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a shingle, and least Jaccard similarity of the shingle sets of near-duplicates.
WORDS, SIMILARITY = 5, 0.8
#: Bits of a wide fingerprint and of its segments; the bits of a segment nearest to a tie, which its ball flips.
WIDE, SEGMENT, FLIPS = 512, 32, 4
#: Deviations of the distance that the search allows beyond its mean at SIMILARITY.
MARGIN = 2.0
#: Word hashes that a worker remembers.
REMEMBERED = 300_000
#: Rows of a table entry that are compared in one task; larger entries are cut in blocks, and all pairs of blocks are compared.
BLOCK = 4096


def wide_radius(similarity: float = SIMILARITY) -> int:
    """Differing bits that all but 2 % of pairs of this Jaccard similarity stay within (one random plane a bit)."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(WIDE * share + MARGIN * math.sqrt(WIDE * share * (1 - share)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int, known: dict[bytes, int]) -> np.ndarray:
    """The distinct 64-bit hashes of the ``words``-word shingles (fewer words: the whole sequence; none: none), ASCII letters in lower case."""
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_FOLD))
    if len(known) > REMEMBERED:
        known.clear()
    for w in found:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, np.uint64(min(words, len(h))))
    for i in range(min(words, len(h))):
        out = _mixed(out ^ h[i : i + n])
    return np.unique(out)


def _profile(hashes: np.ndarray) -> np.ndarray:
    """For each of WIDE bits, hashes with the bit set less those without it."""
    steps = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros(WIDE, np.int64)
    for lo in range(0, len(hashes), 1 << 13):
        wide = _mixed(hashes[lo : lo + (1 << 13), None] + steps)
        bits += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return 2 * bits - len(hashes)


_PRINTS = pa.schema([("node", pa.int64()), ("wide", pa.binary()), ("unsure", pa.binary())])


def _wide(words: int):
    """Rows (id, text, th) to (id, th, node, wide fingerprint, unsure): a byte for each of the FLIPS bits of each segment that are nearest to a tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                wide = np.stack([_profile(shingle_hashes(x.as_py(), words, known)) for x in part.column(1)])
                packed = np.packbits(wide > 0, axis=1, bitorder="little")
                cut = np.abs(wide.reshape(len(wide), WIDE // SEGMENT, SEGMENT))
                unsure = np.argsort(cut, axis=2, kind="stable")[:, :, :FLIPS].astype(np.uint8).reshape(len(wide), -1)
                node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in packed], np.uint64).view(np.int64)
                columns = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (packed, unsure)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(node), *columns], ["id", "th", *_PRINTS.names])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, wide, unsure) to table entries (key, node): each segment with its unsure bits set in one of all ways."""
    flips = np.array([[i >> b & 1 for b in range(FLIPS)] for i in range(1 << FLIPS)], np.uint64)
    number = np.arange(WIDE // SEGMENT, dtype=np.uint64)[None, :, None] << np.uint64(SEGMENT)
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            n = part.num_rows
            own = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(n, -1).astype(np.uint64)
            unsure = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(n, -1, FLIPS).astype(np.uint64)
            masks = np.uint64(1) << unsure
            bare = own & ~np.bitwise_or.reduce(masks, axis=2)
            keys = (bare[:, :, None] | (masks[:, :, None, :] * flips[None, None]).sum(axis=3, dtype=np.uint64)) | number
            flat = keys.reshape(n, -1)
            yield pa.RecordBatch.from_arrays([pa.array(flat.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), flat.shape[1]))], ["key", "node"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) sorted by key, those whose key another row has too."""
    held = None
    for batch in batches:
        table = pa.RecordBatch.from_arrays([pa.concat_arrays([held.column(i), batch.column(i)]) for i in range(2)], batch.schema.names) if held else batch
        if table.num_rows:
            # the last two rows wait: the next batch may go on with their key, or they are done with
            key = np.asarray(table.column(0))
            same = key[1:] == key[:-1]
            hit = np.concatenate((same, [False])) | np.concatenate(([False], same))
            seen = 0 if held is None else held.num_rows
            ready = np.arange(len(key)) < len(key) - 1
            if seen == 2:
                ready[0] = False
            yield table.filter(pa.array(hit & ready))
            held = table.slice(max(0, len(key) - 2))
    if held:
        key = np.asarray(held.column(0))
        if len(key) == 2 and key[0] == key[1]:
            yield held.slice(1)


def _nearest_forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (positions) of a minimum spanning forest of the links within ``radius`` among rows of 64-bit words, nearest first."""
    n = len(prints)
    out, left = [], np.arange(n)
    best, link = np.full(n, 1 << 30), np.full(n, -1)
    while len(left):
        i = int(np.argmin(best[left]))
        at = left[i]
        if best[at] <= radius:
            out.append((int(link[at]), int(at)))
        left = np.delete(left, i)
        if len(left):
            d = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1)
            nearer = d < best[left]
            best[left[nearer]], link[left[nearer]] = d[nearer], at
    return out


def _linked(radius: int):
    """Rows (key, part, node, wide) sorted by (key, part) to the links (a, b) of each part's minimum spanning forest."""

    def settle(nodes: list, wide: list) -> list[tuple[int, int]]:
        if len(nodes) < 2:
            return []
        prints = np.frombuffer(b"".join(wide), np.uint64).reshape(len(nodes), -1)
        return [(nodes[a], nodes[b]) for a, b in _nearest_forest(prints, radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, nodes, wide = None, [], []
        found: list[tuple[int, int]] = []
        for batch in batches:
            for *key, node, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != here:
                    found += settle(nodes, wide)
                    here, nodes, wide = key, [], []
                nodes.append(node)
                wide.append(x)
                if len(found) > 50_000:
                    yield pack(found)
                    found = []
        found += settle(nodes, wide)
        if found:
            yield pack(found)

    def pack(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _parts(shared: DataFrame) -> DataFrame:
    """(key, part, node): entries of at most BLOCK rows are part 0; others are cut in blocks, and each pair of blocks is a part.

    The spanning forests of all pairs of blocks hold that of the whole entry.
    """
    large = common.stage(shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large")
    cut = shared.join(large, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") * 2 / BLOCK), F.lit(1)).cast("int"))
    return cut.select("key", F.explode(_block_pairs(F.xxhash64("node"))).alias("part"), "node")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _shingle_sets(texts: pa.Array) -> pa.Array:
    known: dict[bytes, int] = {}
    return pa.array([shingle_hashes(x.as_py(), WORDS, known).view(np.int64) for x in texts], pa.list_(pa.int64()))


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id) for each row: components of documents whose sets of 5-word shingles have this Jaccard similarity or more.

    Candidates come from wide SimHash fingerprints by multi-index hashing: each
    segment is stored and looked up under a small ball of values, those that
    flip its bits nearest to a tie, which near-duplicates differ in first.
    Complete distances are verified, each table entry gives its minimum
    spanning forest, and the shingle sets of its links are compared exactly.
    Equal fingerprints are one node. Texts without words are alike. component_id
    is the least id reachable, null only if all ids are; nulls and repeated rows
    stay, other columns are left out, and an empty table gives no rows.
    """
    return _similar(df, id_col, text_col, similarity).select("id", "component_id")


def _similar(df: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(id, th, component, component_id): ``similar_documents`` with the text's hash and a number of the component, stored."""
    text = F.col(f"`{text_col}`")
    texts = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))
    kind = texts.schema["id"].dataType.simpleString()
    docs = common.stage(texts.mapInArrow(_wide(WORDS), f"id {kind}, th bigint, node bigint, wide binary, unsure binary"), "prints")
    nodes = docs.groupBy("node").agg(F.min("id").alias("least"), F.min("wide").alias("wide"), F.min(F.struct("id", "th")).alias("one"))
    one = docs.select("node", "wide", "unsure").dropDuplicates(["node"])
    entries = one.mapInArrow(_keys, "key bigint, node bigint").repartition("key").sortWithinPartitions("key", "node")
    shared = common.stage(entries.mapInArrow(_shared, "key bigint, node bigint"), "shared")
    met = _parts(shared).join(nodes.select("node", "wide"), "node").select("key", "part", "node", "wide").repartition("key", "part").sortWithinPartitions("key", "part")
    pairs = common.stage(met.mapInArrow(_linked(wide_radius(similarity)), "a bigint, b bigint").distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # one text of each node that has a link
    asked = nodes.join(ends, "node", "left_semi").select("node", F.col("one.id").alias("i"), F.col("one.th").alias("h"))
    found = texts.join(asked, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")))
    sets = common.stage(found.groupBy("node").agg(F.first("text").alias("text")).select("node", _shingle_sets("text").alias("shingles")), "sets")
    sides = [sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    common_n = F.size(F.array_intersect("sa", "sb"))
    links = common.stage(both.where(common_n >= similarity * (F.size("sa") + F.size("sb") - common_n)).select("a", "b"), "links")
    joined = connected_components(links)
    placed = nodes.join(joined, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(names, "component").select(F.col("node").alias("of"), "component", "component_id")
    out = common.stage(docs.join(known, F.col("node") == F.col("of"), "left").select("id", "th", "component", "component_id"), "components")
    common.drop(docs, shared, pairs, sets, links)
    return out


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one document of each group of ``similar_documents``: the one of the least id, and of rows with that id the one whose text's hash is least.

    All columns stay, whatever their names. Rows that share an id are alike
    only if their texts are. Of rows that repeat both id and text one stays (by
    a hash of the row). Rows without an id can't be told apart, so all of them
    stay.
    """
    own = common.Names(df)
    keep, kept_hash, first, cell = own("keep"), own("th"), own("first"), F.col(f"`{id_col}`")
    one = _similar(df, id_col, text_col, similarity).where("id IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "th")).alias("one"))
    one = one.select(F.col("one.id").alias(keep), F.col("one.th").alias(kept_hash))
    hashed = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = df.where(cell.isNotNull()).join(one, (cell == F.col(keep)) & (hashed == F.col(kept_hash)), "left_semi")
    order = Window.partitionBy(cell, hashed).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    rows = rows.withColumn(first, F.row_number().over(order)).where(F.col(first) == 1).drop(first)
    return rows.unionByName(df.where(cell.isNull()))
