"""Byte-level BPE: distinct words are encoded once, ids come back to their positions; ids meet the token-byte table.

Texts are split into pre-tokens, whose positions stay in shares (``shares``).
The shares' distinct words are shuffled by word, so that each distinct word of
the whole table is encoded once; its ids go back to the shares that hold it, and
documents are put together by position. Decoding joins the table of token bytes:
its tokens meet a share's ids, and bytes are put together by position.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, shares

#: Tokens of a vocabulary whose table is broadcast.
TABLE = 1_000_000
#: Words that are put together at once, and entries that a task holds before it sends them back.
AT_ONCE, HELD = 500_000, 1 << 20


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    return public_tokenizers.path(name)


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file (base64, space, rank) and their ids."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(4)
def _merges(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(token, bytes) of a vocabulary; broadcast if it has at most TABLE tokens."""
    found = sorted((i, token) for token, i in ranks(path or vocabulary()).items())
    made = spark.createDataFrame(pa.table({"token": pa.array([i for i, _ in found], pa.int32()), "bytes": pa.array([t for _, t in found], pa.binary())}))
    return F.broadcast(made) if len(found) <= TABLE else made


def _coded(path: str, pattern: str):
    """Entries (share, code, entry) in the order of entries to rows (share, codes, sizes, tokens): each distinct entry is encoded once, and a share's go back together."""

    def sent(share: np.ndarray, code: np.ndarray, word: np.ndarray, ids: list[list[int]]) -> Iterator[pa.RecordBatch]:
        lists = pa.array(ids, pa.list_(pa.int32()))
        order = np.argsort(share, kind="stable")
        begins = np.flatnonzero(np.concatenate(([True], np.diff(share[order]) != 0)))
        for lo, hi in zip(begins, np.append(begins[1:], len(order)), strict=True):
            mine = order[lo:hi]
            tokens = lists.take(pa.array(word[mine]))
            packs = [code[mine], tokens.value_lengths().to_numpy(), tokens.flatten().to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array([share[mine[0]]]), *[pa.array([shares.packed(x)], pa.binary()) for x in packs]], ["share", "codes", "sizes", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _merges(path, pattern).encode_ordinary
        here, ids, parts, held = None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(2)
            opens = np.concatenate(([words[0].as_py() != here], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)))
            number = len(ids) - 1 + np.cumsum(opens)
            ids += [encode(w) for w in words.take(pa.array(np.flatnonzero(opens))).to_pylist()]
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), number))
            here, held = words[-1].as_py(), held + batch.num_rows
            if held >= HELD:
                yield from sent(*map(np.concatenate, zip(*parts, strict=True)), ids)
                ids, parts, held = ids[-1:], [], 0
        if parts:
            yield from sent(*map(np.concatenate, zip(*parts, strict=True)), ids)

    return run


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about AT_ONCE words, a row at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        yield lo, hi
        lo = hi


def _gathered(values: pa.Array, codes: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """For rows of codes that end at ``ends``, the lists of their codes' lists, joined."""
    offsets, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False)
    n = np.diff(offsets)[codes]
    after = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(after[-1]) + np.repeat(offsets[:-1][codes] - after[:-1], n)
    return pa.ListArray.from_arrays(pa.array(after[np.concatenate(([0], ends))], pa.int32()), pa.array(flat[at], pa.int32()))


def _joined(lists: pa.ListArray, table: dict[int, bytes]) -> pa.Array:
    """Each list's ids as their bytes, one after the other."""
    ids, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return pa.array([b"".join(map(table.__getitem__, ids[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids) of each row's whole text; ``decoded`` adds the bytes that the ids stand for.

    A null text is an empty text, which has no ids. Null ids and repeated rows
    stay, other columns are left out, an empty table gives no rows. A word may
    be as long as its text; a word that all documents hold has one row for each
    share in the shuffle of words, which is sorted and streamed.
    """
    path = path or vocabulary()
    id_type = df.schema[id_col].dataType.simpleString()

    def split(text: str | None) -> list[str]:
        return regex.findall(pattern, text) if text else []

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.lit(None).cast("string").alias("grp"), F.col(f"`{text_col}`").alias("value"))
    stored = shares.shares(rows, split, "string")
    found = shares.entries(stored).select(F.col("share").alias("share"), "code", "entry")
    coded = found.repartition("entry").sortWithinPartitions("entry").mapInArrow(_coded(path, pattern), "share bigint, codes binary, sizes binary, tokens binary")
    texts = stored.select("share", "ids", "sizes", "codes")
    if decoded:
        table = token_table(df.sparkSession, path).groupBy(F.lit(path).alias("vocabulary")).agg(F.collect_list(F.struct("token", "bytes")).alias("table"))
        texts = texts.withColumn("vocabulary", F.lit(path)).join(F.broadcast(table), "vocabulary")

    def run(mine: pa.Table, words: pa.Table) -> pa.Table:
        codes, sizes = shares.unpacked(mine.column("codes")[0].as_py()), np.array(mine.column("sizes")[0].as_py(), np.int64)
        ids = mine.column("ids")[0].values
        known, lengths, tokens = (np.concatenate([np.empty(0, "<u4"), *[shares.unpacked(x.as_py()) for x in words.column(c)]]) for c in ("codes", "sizes", "tokens"))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(tokens, pa.int32())).take(pa.array(np.argsort(known)))
        table = {x["token"]: x["bytes"] for x in mine.column("table")[0].as_py()} if decoded else {}
        ends = np.concatenate(([0], np.cumsum(sizes)))
        out = []
        for lo, hi in _runs(sizes):
            made = _gathered(lists, codes[ends[lo] : ends[hi]], ends[lo + 1 : hi + 1] - ends[lo])
            columns = [ids.slice(lo, hi - lo), made.value_lengths().cast(pa.int64()), made, *([_joined(made, table)] if decoded else [])]
            out.append(pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded"][: len(columns)]))
        return pa.Table.from_batches(out)

    met = texts.groupBy("share").cogroup(coded.groupBy("share"))
    return met.applyInArrow(run, f"id {id_type}, n_tokens bigint, ids array<int>" + (", decoded binary" if decoded else ""))


def decode(df: DataFrame, id_col: str, ids_col: str, path: str | None = None) -> DataFrame:
    """(id, bytes) of each row's ids; what isn't in the vocabulary raises a KeyError.

    Null ids of rows and repeated rows stay; a null list is an empty one, a null
    in a list is no token. Other columns are left out.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.lit(None).cast("string").alias("grp"), F.array_compact(F.col(f"`{ids_col}`").cast("array<int>")).alias("value"))
    stored = shares.shares(rows, lambda ids: ids or [], "int")
    looked = shares.entries(stored).join(token_table(df.sparkSession, path), F.col("entry") == F.col("token")).select(F.col("share").alias("share"), "token", "bytes")

    def run(mine: pa.Table, tokens: pa.Table) -> pa.Table:
        table = dict(zip(tokens.column("token").to_pylist(), tokens.column("bytes").to_pylist(), strict=True))
        out = []
        for row in range(mine.num_rows):
            flat = np.array(mine.column("entries")[row].as_py(), np.int32)[shares.unpacked(mine.column("codes")[row].as_py())]
            ends = pa.array(np.concatenate(([0], np.cumsum(mine.column("sizes")[row].as_py()))), pa.int32())
            out.append(pa.RecordBatch.from_arrays([mine.column("ids")[row].values, _joined(pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())), table)], ["id", "bytes"]))
        return pa.Table.from_batches(out)

    texts = stored.select("share", "ids", "sizes", "codes", "entries").groupBy("share")
    return texts.cogroup(looked.groupBy("share")).applyInArrow(run, f"id {id_type}, bytes binary")
