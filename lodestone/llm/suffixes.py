"""Suffix dedup: passages of THRESHOLD bytes that occur earlier are removed, found by a depth-limited radix sort.

Every byte position with THRESHOLD bytes left in its document is a suffix, and
only its first THRESHOLD bytes count. A row for each suffix would be many times
the text, so a bucket pass comes first: a run of neighbouring suffixes shares
one *pivot*, the gram of GRAM bytes with the least hash in their first THRESHOLD
bytes, and equal suffixes have equal pivots at equal offsets.

1. Bucket pass: runs are dealt and sorted by their pivot's hash, then by a digest
   of all bytes that the run's suffixes cover. Runs equal to an earlier run
   repeat it whole. Pivots that occur in one run only, or in equal runs only,
   are finished: their suffixes are singletons, or marked.
2. The other runs (one of each digest) fetch their bytes and meet again by pivot.
   Their suffixes are radix sorted from the most significant digit, DIGIT bytes
   a pass: each pass orders the groups of the one before and drops singletons,
   and the last ends at THRESHOLD bytes.
3. Pivots with more than DENSE different runs are counted beforehand and never
   meet in one task. Their runs are cut in two by the next digit: suffixes with
   more bytes before the pivot meet by the bytes right before it, the others by
   those right after it. What is dense even so is dealt by single suffixes, by
   digests of all THRESHOLD bytes.

Equal groups are exactly the repeated windows; all but a group's first
suffix are marked, and marked bytes are removed from the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

THRESHOLD = 100
#: Bytes of a pivot gram, a power of two below THRESHOLD.
GRAM = 32
#: Bytes of text that are worked on at once.
CHUNK = 3 << 20
#: Bytes of a digit.
DIGIT = 8
#: Different runs of one pivot that are sorted in one task.
DENSE = 1024
#: Suffixes that are sorted at once.
SORTED = 50_000
#: Ids are this or greater; below it, rows without an id have numbers by their texts.
LEAST_ID = -(1 << 62)

_POS, _LEN = 32, 7
_MULTIPLIERS = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes, built by doubling the length."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n, level = 1, 0
    while n < gram:
        h = h[:-n] * _MULTIPLIERS[level] + (h[n:] ^ (h[n:] >> np.uint64(29)))
        n, level = n * 2, level + 1
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, pivot hash) of each run of suffixes with one pivot; suffixes that leave their document are left out."""
    wide = threshold - gram + 1
    if len(data) < threshold:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(data, gram)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while n * 2 <= wide:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < wide:
        least = np.minimum(least[: len(least) - (wide - n)], least[wide - n :])
    pivot = (least & low).astype(np.int64)
    valid = np.ones(len(pivot), bool)
    for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
        valid[max(a, z - threshold + 1) : z] = False
    first = np.flatnonzero(np.concatenate(([True], (pivot[1:] != pivot[:-1]) | (valid[1:] != valid[:-1]))))
    last = np.append(first[1:], len(pivot)) - 1
    good = valid[first]
    first, last = first[good], last[good]
    return first, last, h[pivot[first]]


def _tag(texts: Column) -> Column:
    """24 bits that tell apart different texts with one id."""
    return F.xxhash64(texts).bitwiseAND(F.lit((1 << 24) - 1))


def _doc(id_col: str, text: Column) -> Column:
    """The document's number: its id, or for a null id one below all ids by 62 bits of the text's hash, which the tag does not have.

    A real id below LEAST_ID raises an error.
    """
    own = F.col(f"`{id_col}`").cast("long")
    unnamed = F.shiftrightunsigned(F.xxhash64(text), 2) - F.lit(1 << 62) - F.lit(1 << 62)
    low = F.raise_error(F.concat(F.lit(f"ids must be {LEAST_ID} or greater: "), own.cast("string"))).cast("long")
    return F.when(own < LEAST_ID, low).otherwise(F.coalesce(own, unnamed))


_RUN = "pivot bigint, digest bigint, doc bigint, at bigint"
_RUNS = pa.schema([("pivot", pa.int64()), ("digest", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("first", pa.bool_())])


def _pieces(texts: list[bytes], threshold: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, offset, bytes) of about CHUNK bytes; a longer text is cut with an overlap of threshold - 1."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - threshold + 1), CHUNK):
            piece = text[lo : lo + CHUNK + threshold - 1]
            if len(piece) < threshold:
                continue
            group.append((i, lo, piece))
            size += len(piece)
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def _find(threshold: int, gram: int):
    """Documents (doc, tag, text) to runs. Of equal runs in one chunk only the first asks to be compared; the others are marked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for lo in range(0, batch.num_rows, 2000):
                texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(2).slice(lo, 2000)]
                for group in _pieces(texts, threshold):
                    data = b"".join(x for _, _, x in group)
                    sizes = np.array([len(x) for _, _, x in group])
                    ends = np.cumsum(sizes)
                    begins = ends - sizes
                    first, last, pivot = _runs(np.frombuffer(data, np.uint8), begins, ends, threshold, gram)
                    digest = np.array([xxhash.xxh3_64_intdigest(data[a:z]) for a, z in zip(first.tolist(), (last + threshold).tolist(), strict=True)], np.uint64).view(np.int64)
                    own = np.searchsorted(ends, first, side="right")
                    row = lo + np.array([i for i, _, _ in group])[own]
                    start = first - begins[own] + np.array([x for _, x, _ in group])[own]
                    doc = docs[row]
                    at = (tags[row] << (_POS + _LEN)) | (start << _LEN) | (last - first + 1)
                    pivot = pivot.view(np.int64)
                    order = np.lexsort((at, doc, digest, pivot))
                    pivot, digest, doc, at = pivot[order], digest[order], doc[order], at[order]
                    same = np.concatenate(([False], (pivot[1:] == pivot[:-1]) & (digest[1:] == digest[:-1]))) if len(pivot) else np.zeros(0, bool)
                    # the first of a group of equal runs, repeated rows of it included
                    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else np.zeros(0, np.int64)
                    again = same & ~((doc == doc[lead]) & (at == at[lead]))
                    pivot = np.where(again, (doc * np.int64(-7046029254386353131)) ^ (at * np.int64(-4417276706812531889)), pivot)
                    yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(digest), pa.array(doc), pa.array(at), pa.array(~again)], schema=_RUNS)

    return run


#: marked: the run repeats an earlier one; otherwise it must be compared at full depth.
_SEEN = pa.schema([("doc", pa.int64()), ("at", pa.int64()), ("pivot", pa.int64()), ("marked", pa.bool_())])


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs: mark those equal to an earlier one, and pass on one of each digest where a pivot has several."""
    here = last = None  # the pivot and digest of the row before
    lead = waiting = None  # first run of the digest; first run of the pivot, until a second digest comes
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        pivot, digest, doc, at = (np.asarray(c) for c in batch.columns[:4])
        asks = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
        out = [(doc[~asks], at[~asks], pivot[~asks], np.ones(int((~asks).sum()), bool))]
        pivot, digest, doc, at = pivot[asks], digest[asks], doc[asks], at[asks]
        n = len(pivot)
        if n:
            new_pivot = np.concatenate(([pivot[0] != here], pivot[1:] != pivot[:-1]))
            new_digest = new_pivot | np.concatenate(([digest[0] != last], digest[1:] != digest[:-1]))
            lead_at = np.maximum.accumulate(np.where(new_digest, np.arange(n), -1))
            lead_doc = np.where(lead_at >= 0, doc[lead_at], lead[0] if lead else 0)
            lead_run = np.where(lead_at >= 0, at[lead_at], lead[1] if lead else 0)
            again = ~new_digest & ~((doc == lead_doc) & (at == lead_run))
            out.append((doc[again], at[again], pivot[again], np.ones(int(again.sum()), bool)))
            # one run of each digest, of pivots with a second digest
            reps = np.flatnonzero(new_digest)
            opens = new_pivot[reps]
            alone = opens & np.append(opens[1:], True)
            if len(reps):
                if waiting is not None and not opens[0]:
                    out.append(tuple(np.array([x]) for x in (*waiting, False)))
                    waiting = None
                elif opens[0]:
                    waiting = None
                passed = reps[~alone]
                if alone[-1]:
                    i = reps[-1]
                    waiting = (doc[i], at[i], pivot[i])
                elif len(reps):
                    waiting = None
                out.append((doc[passed], at[passed], pivot[passed], np.zeros(len(passed), bool)))
            here, last, lead = pivot[-1], digest[-1], (lead_doc[-1], lead_run[-1])
        columns = [np.concatenate([x[i] for x in out]) for i in range(4)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SEEN)


def _unpack(at: int) -> tuple[int, int]:
    return (at >> _LEN) & ((1 << _POS) - 1), at & ((1 << _LEN) - 1)


_BYTES = pa.schema([("pivot", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("content", pa.binary()), ("heavy", pa.bool_())])


def refined(content: bytes, n: int, pivot: int, threshold: int) -> list[tuple[int, int, int]]:
    """(first suffix, suffixes, key) of the two parts of a run of ``n`` suffixes of ``content``, by the bytes next to their pivot.

    Suffixes that have half of their other bytes before the pivot are the first
    part; equal suffixes have their pivot at equal offsets, so they are in parts
    of one kind and key.
    """
    side = (threshold - GRAM) // 2
    h = _gram_hashes(np.frombuffer(content, np.uint8), GRAM)
    # the pivot lies in the windows of all suffixes of the run, and has the least hash there
    q = n - 1 + int(np.argmin(h[n - 1 : threshold - GRAM + 1] & ~np.uint64((1 << 24) - 1)))
    cut = min(n, max(0, q - side + 1))
    out = []
    if cut:
        out.append((0, cut, b"<" + content[q - side : q]))
    if cut < n:
        out.append((cut, n - cut, b">" + content[q + GRAM : q + GRAM + side]))
    key = pivot.to_bytes(8, "little", signed=True)
    return [(p, m, int.from_bytes(xxhash.xxh3_64_digest(key + digit), "little", signed=True)) for p, m, digit in out]


def _fetch(threshold: int):
    """Documents with what is asked of them to runs with their bytes; runs of heavy pivots come in two parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = []
                for doc, packed, asked in zip(*[c.to_pylist() for c in batch.slice(lo, 500).columns], strict=True):
                    text = unzip.decompress(packed)
                    for x in asked:
                        start, n = _unpack(x["at"])
                        content = text[start : start + n - 1 + threshold]
                        if not x["heavy"]:
                            rows.append((x["pivot"], doc, x["at"], content, False))
                            continue
                        tag = x["at"] >> (_POS + _LEN)
                        for p, m, key in refined(content, n, x["pivot"], threshold):
                            rows.append((key, doc, (tag << (_POS + _LEN)) | ((start + p) << _LEN) | m, content[p : p + m - 1 + threshold], True))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BYTES, strict=True)], schema=_BYTES)

    return run


_MARKS = pa.schema([("doc", pa.int64()), ("at", pa.int64())])


def equal_groups(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, groups): the rows of a byte matrix that equal another row, by radix passes from the most significant digit.

    Groups are numbered in the order of their bytes. A pass orders the rows that
    are left by group and digit; rows alone in their new group leave.
    """
    n, depth = windows.shape
    padded = np.zeros((n, -(-depth // DIGIT) * DIGIT), np.uint8)
    padded[:, :depth] = windows
    digits = padded.view(">u8")
    rows, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(digits.shape[1]):
        digit = digits[rows, d].astype(np.uint64)
        order = np.lexsort((digit, group))
        rows, digit, group = rows[order], digit[order], group[order]
        opens = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))) if len(rows) else np.zeros(0, bool)
        group = np.cumsum(opens) - 1
        many = np.bincount(group)[group] > 1 if len(rows) else opens
        rows, group = rows[many], group[many]
    return rows, group


def _second_pass(threshold: int):
    """Runs (pivot, doc, at, content) sorted by pivot to the marks of repeated suffixes, as runs again."""

    def settle(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        contents = b"".join(c for _, _, c in rows)
        sizes = np.array([len(c) for _, _, c in rows])
        starts = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(rows)), sizes - threshold + 1)
        place = np.arange(len(own)) - np.repeat(np.cumsum(sizes - threshold + 1) - (sizes - threshold + 1), sizes - threshold + 1)
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(contents, np.uint8), threshold)[starts[own] + place]
        found, group = equal_groups(windows)
        if not len(found):
            return
        doc, at = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        # a suffix's place in its text, above it the text's tag
        where = ((at[own[found]] >> (_POS + _LEN)) << _POS) | (((at[own[found]] >> _LEN) & ((1 << _POS) - 1)) + place[found])
        order = np.lexsort((where, doc[own[found]], group))
        found, group, where = found[order], group[order], where[order]
        lead = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(len(group)), 0))
        # rows that repeat the first suffix itself are the same suffix
        later = (where != where[lead]) | (doc[own[found]] != doc[own[found[lead]]])
        marked = np.sort(found[later])
        for i in np.split(marked, np.flatnonzero(np.diff(marked) != 1) + 1):
            for r in np.unique(own[i]).tolist():
                yield from _marks(rows[r][0], rows[r][1], place[i[own[i] == r]].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, size = None, [], 0
        for batch in batches:
            out: list[tuple[int, int]] = []
            for pivot, doc, at, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if pivot != here and size > SORTED:
                    out += settle(rows)
                    rows, size = [], 0
                here = pivot
                rows.append((doc, at, content))
                size += len(content) - threshold + 1
            if out:
                yield pack(out)
        if rows and (out := list(settle(rows))):
            yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MARKS, strict=True)], schema=_MARKS)

    return run


def _marks(doc: int, at: int, places: list[int]) -> Iterator[tuple[int, int]]:
    """Repeated suffixes of a run as runs again (no more suffixes than the run has, so their number fits)."""
    start, _ = _unpack(at)
    tag = at >> (_POS + _LEN)
    i = 0
    while i < len(places):
        j = i
        while j + 1 < len(places) and places[j + 1] == places[j] + 1:
            j += 1
        yield doc, (tag << (_POS + _LEN)) | ((start + places[i]) << _LEN) | (j - i + 1)
        i = j + 1


_ONE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])


def _expand(threshold: int):
    """Rows of dense pivots to single suffixes with a 128-bit digest; of equal suffixes in a batch all but the first are marked at once (h1, h2 null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(lo, 2000) for batch in batches for lo in range(0, batch.num_rows, 2000)):
            seen: dict[bytes, tuple] = {}
            marked = []
            for doc, at, content in sorted(zip(*[c.to_pylist() for c in part.columns], strict=True)):
                start, n = _unpack(at)
                tag = at >> (_POS + _LEN)
                for p in range(n):
                    me = (doc, (tag << (_POS + _LEN)) | ((start + p) << _LEN) | 1)
                    if seen.setdefault(xxhash.xxh3_128_digest(content[p : p + threshold]), me) != me:
                        marked.append((None, None, *me))
            rows = [(int.from_bytes(k[:8], "big", signed=True), int.from_bytes(k[8:], "big", signed=True), *v) for k, v in seen.items()] + marked
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ONE, strict=True)], schema=_ONE)

    return run


@F.arrow_udf(T.BinaryType())
def _zip(texts: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=3)
    return pa.array([pack.compress((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in texts], pa.binary())


def repeated_runs(df: DataFrame, id_col: str, text_col: str, threshold: int = THRESHOLD) -> DataFrame:
    """(doc, at): runs of suffixes that occur earlier; ``at`` packs the text's tag, the first suffix and their number."""
    # a run has threshold - GRAM + 1 suffixes at most, and their number has _LEN bits
    if not GRAM < threshold < GRAM + (1 << _LEN) - 1:
        raise ValueError(f"the threshold must be between {GRAM + 1} and {GRAM + (1 << _LEN) - 2} bytes")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(_doc(id_col, text).alias("doc"), _tag(text).alias("tag"), text.alias("text"))
    runs = docs.mapInArrow(_find(threshold, GRAM), _RUN + ", first boolean").repartition("pivot").sortWithinPartitions("pivot", "digest", "doc", "at")
    seen = common.stage(runs.mapInArrow(_first_pass, "doc bigint, at bigint, pivot bigint, marked boolean"), "runs")
    left = seen.where("NOT marked")
    heavy = _heavy(left)
    left = left.join(common.small(heavy), "pivot", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    asked = left.groupBy("doc", F.shiftright("at", _POS + _LEN).alias("tag")).agg(F.collect_list(F.struct("at", "pivot", "heavy")).alias("asked"))
    wanted = _packed(df, id_col, text_col).join(asked, ["doc", "tag"]).select("doc", "packed", "asked")
    fetched = wanted.mapInArrow(_fetch(threshold), "pivot bigint, doc bigint, at bigint, content binary, heavy boolean")
    marked, single = seen.where("marked").select("doc", "at"), None
    if not heavy.isEmpty():
        # parts of heavy runs are counted by their new keys before they meet
        fetched = common.stage(fetched, "fetched")
        again = _heavy(fetched.where("heavy"))
        if not again.isEmpty():
            flagged = fetched.drop("heavy").join(common.small(again), "pivot", "left")
            single = flagged.where("heavy").select("doc", "at", "content")
            fetched = flagged.where("heavy IS NULL")
    met = fetched.select("pivot", "doc", "at", "content").repartition("pivot").sortWithinPartitions("pivot", "doc", "at")
    marked = marked.unionByName(met.mapInArrow(_second_pass(threshold), "doc bigint, at bigint"))
    if single is not None:
        single = common.stage(single.mapInArrow(_expand(threshold), "h1 bigint, h2 bigint, doc bigint, at bigint"), "suffixes")
        least = single.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("least"), F.count("*").alias("n")).where("n > 1")
        later = single.join(least, ["h1", "h2"]).where(F.struct("doc", "at") != F.col("least"))
        marked = marked.unionByName(later.select("doc", "at")).unionByName(single.where("h1 IS NULL").select("doc", "at"))
    return marked


def _heavy(runs: DataFrame) -> DataFrame:
    """(pivot, heavy): the pivots that more than DENSE rows of ``runs`` have."""
    return common.stage(runs.groupBy("pivot").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).select("pivot", F.lit(True).alias("heavy")), "heavy")


def _packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(_doc(id_col, text).alias("doc"), _tag(text).alias("tag"), F.col(f"`{id_col}`").isNull().alias("no_id"), _zip(F.col(f"`{text_col}`")).alias("packed"))


def spans(marks: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """The maximal byte runs [start, end) that the marked suffixes cover."""
    starts = (marks >> _LEN) & ((1 << _POS) - 1)
    ends = starts + (marks & ((1 << _LEN) - 1)) - 1 + threshold
    out: list[tuple[int, int]] = []
    for i in np.argsort(starts, kind="stable").tolist():
        a, z = int(starts[i]), int(ends[i])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


_CUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _cut(threshold: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = []
                for doc, no_id, packed, marks in zip(*batch.slice(lo, 500).columns, strict=True):
                    text = unzip.decompress(packed.as_py())
                    gone = spans(np.asarray(marks.values), threshold) if marks.is_valid else []
                    kept, at = [], 0
                    for a, z in gone:
                        kept.append(text[at:a])
                        at = z
                    kept = b"".join((*kept, text[at:])) if gone else text
                    rows.append((None if no_id.as_py() else doc.as_py(), len(text), [{"start": a, "end": z} for a, z in gone], hashlib.sha256(kept).hexdigest().encode() if digest else kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CUT, strict=True)], schema=_CUT)

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, digest: bool = False) -> DataFrame:
    """(id, n_bytes, removed spans, kept bytes) for each row: bytes in a ``threshold``-byte string that starts earlier are removed.

    Earlier is a smaller id, or an earlier start in one document. A null text
    is empty; null ids come before all others, in the order of 62 bits of their
    texts' hashes, and stay null; rows that repeat both id and text are one
    document, and of different texts with one id the order is by 24 bits of a
    hash (two such texts share them with a chance of 2^-24). Ids below
    LEAST_ID raise an error. Texts may have up to 2^32 bytes. Cuts may fall inside a
    character, so kept is binary; with ``digest`` it is its SHA-256 in hex.
    An empty table gives no rows; other columns are left out.
    """
    marks = repeated_runs(df, id_col, text_col, threshold)
    by_doc = marks.groupBy("doc", F.shiftright("at", _POS + _LEN).alias("tag")).agg(F.collect_list("at").alias("marks"))
    joined = _packed(df, id_col, text_col).join(by_doc, ["doc", "tag"], "left").select("doc", "no_id", "packed", "marks")
    return joined.mapInArrow(_cut(threshold, digest), "id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
