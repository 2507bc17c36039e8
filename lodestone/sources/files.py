"""File sources and sinks: whole files, archives, JSON lines of facts, guards on uploads, keyed upserts."""

from __future__ import annotations

import contextlib
import io
import json
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lodestone.operators.windows import first_per

#: First bytes of file kinds (fixed values).
MAGIC = {"pdf": "25504446", "zip": "504B0304", "png": "89504E47", "jpg": "FFD8FF", "ole": "D0CF11E0", "gz": "1F8B"}
#: Limits of flattened JSON: depth, items of a list, characters of a value.
DEPTH, ITEMS, VALUE = 10, 500, 500
#: Limits of archives: expanded bytes, ratio of expanded to packed bytes.
EXPANDED, RATIO = 1 << 30, 100


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content as bytes) of the files under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, content): one whole text file a row."""
    x = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return x.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text, fields may span lines."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def file_kind(content: Column) -> Column:
    """The kind by the first bytes; text if no byte of the first 4096 is zero, else unknown."""
    head = F.hex(F.substring(content, 1, 4))
    out = None
    for kind, magic in MAGIC.items():
        hit = F.startswith(head, F.lit(magic))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    zero = F.regexp_like(F.hex(F.substring(content, 1, 4096)), F.lit("^(?:..)*?00"))
    return out.when(~zero, "text").otherwise("unknown")


def guard_uploads(files: DataFrame, largest: int = 100 << 20) -> DataFrame:
    """``files`` (path, content) with kind and verdict: OK, EMPTY, TOO_LARGE, KIND_MISMATCH, MACRO or ZIP_BOMB."""
    kind = file_kind(F.col("content"))
    name = F.lower(F.element_at(F.split("path", r"\."), -1))
    wanted = F.when(name.isin("docx", "xlsx", "pptx", "zip"), "zip").when(name.isin("doc", "xls", "ppt"), "ole").when(name == "jpeg", "jpg").when(name.isin("pdf", "png", "jpg"), name).otherwise("text")
    size = F.octet_length("content")
    verdict = F.when(size == 0, "EMPTY").when(size > largest, "TOO_LARGE").when(F.col("kind") != wanted, "KIND_MISMATCH").when(F.contains(F.col("content"), F.lit(b"vbaProject.bin")), "MACRO").otherwise("OK")
    out = files.withColumn("kind", kind).withColumn("verdict", verdict)
    return out.withColumn("verdict", F.when((F.col("verdict") == "OK") & (F.col("kind") == "zip") & _bomb("content"), "ZIP_BOMB").otherwise(F.col("verdict")))


def _bomb(column: str) -> Column:
    @F.pandas_udf("boolean")
    def check(contents: pd.Series) -> pd.Series:
        def one(data: bytes) -> bool:
            if not data or data[:4] != b"PK\x03\x04":
                return False
            try:
                entries = zipfile.ZipFile(io.BytesIO(data)).infolist()
            except zipfile.BadZipFile:
                return True
            total = sum(e.file_size for e in entries)
            return total > EXPANDED or total > RATIO * max(1, sum(e.compress_size for e in entries))

        return contents.map(one)

    return check(F.col(column))


def read_table(spark: SparkSession, url: str, table: str, column: str, bounds: tuple[int, int], parts: int, **options: str) -> DataFrame:
    """A table of a relational database, read in ``parts`` ranges of a whole-number column; filters and columns are pushed down."""
    return spark.read.jdbc(url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=options)


#: Rows of a database file.
DATABASE_ROWS = 50_000


def database_files(df: DataFrame, table: str, key: str, rows: int = DATABASE_ROWS) -> DataFrame:
    """(low, high, n, content): ``df`` as SQLite database files of ``rows`` rows at most, each a range of a whole-number column with its least and greatest key.

    Columns are whole numbers, floating point numbers or text.
    """
    kinds = [{"double": "REAL", "float": "REAL", "string": "TEXT"}.get(f.dataType.simpleString(), "INTEGER") for f in df.schema]
    names, at = [_quoted(c) for c in df.columns], df.columns.index(key)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        with contextlib.closing(sqlite3.connect(":memory:")) as con:
            con.execute(f"CREATE TABLE {_quoted(table)} ({', '.join(f'{n} {k}' for n, k in zip(names, kinds, strict=True))})")
            con.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(names))})", held)
            con.execute(f"CREATE INDEX by_key ON {_quoted(table)} ({names[at]})")
            con.commit()
            keys = [r[at] for r in held if r[at] is not None]
            content = con.serialize()
        return pa.RecordBatch.from_arrays([pa.array([min(keys, default=None)], pa.int64()), pa.array([max(keys, default=None)], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([content], pa.binary())], ["low", "high", "n", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                if len(held) == rows:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return df.repartitionByRange(key).sortWithinPartitions(key).mapInArrow(run, "low bigint, high bigint, n bigint, content binary")


def scan_databases(files: DataFrame, sql: str, schema: str) -> DataFrame:
    """The rows of ``sql``, whose filters each database of ``files`` (content, as SQLite files have it) applies itself; columns are ``schema``'s."""
    types = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with contextlib.closing(sqlite3.connect(":memory:")) as con:
                    con.deserialize(content.as_py())
                    found = con.execute(sql)
                    while part := found.fetchmany(4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), types, strict=True)], schema=types)

    return files.select("content").where("content IS NOT NULL").mapInArrow(run, schema)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def create_tables(spark: SparkSession, tables: dict[str, str]) -> None:
    """Create the tables (name to columns in SQL) that aren't there yet."""
    for name, columns in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


#: Limits of generic XML: children of the root, of other elements, characters of a text.
ROOT_CHILDREN, CHILDREN, TEXT = 200, 50, 300


@F.arrow_udf(T.ArrayType(T.StringType()))
def xml_lines(contents: pa.Array) -> pa.Array:
    """The elements below the root as lines, two spaces a level: ``tag [attributes]: text``; null if it is no XML."""

    def lines(content: str) -> list[str] | None:
        try:
            root = ElementTree.fromstring(content)
        except ElementTree.ParseError:
            return None
        out = []
        # the elements still to come, last first
        todo = [(x, 0) for x in reversed(root[:ROOT_CHILDREN])]
        while todo:
            x, depth = todo.pop()
            todo += [(c, depth + 1) for c in reversed(x[:CHILDREN])]
            attributes = " ".join(f'{k}="{v}"' for k, v in x.attrib.items())
            name = x.tag.rsplit("}", 1)[-1] + (f" [{attributes}]" if attributes else "")
            text = (x.text or "").strip()[:TEXT]
            if text or attributes:
                out.append("  " * depth + name + (f": {text}" if text else ""))
        return out

    return pa.array([lines(x.as_py()) if x.is_valid else None for x in contents], pa.list_(pa.string()))


#: Elements whose contents are no text, and elements that begin and end a block (fixed values).
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<svg\b.*?</svg\s*>"
BLOCK = r"(?i)<(/?)(h[1-6]|p|div|tr|li|pre|code)\b[^>]*>"
SECTION = "HTML Content"


def html_paragraphs(df: DataFrame, id_col: str, html: str, words: int = 3) -> DataFrame:
    """(id, place, section, paragraph): the text blocks of pages under their last heading; headings and preformatted text of any length, others of ``words`` words."""
    marked = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BLOCK, "\x01$1$2\x02")
    pieces = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(marked, "\x01")).alias("place", "piece"))
    tag = F.lower(F.regexp_extract("piece", "^([^\x02]*)\x02", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("piece", "^[^\x02]*\x02", ""), "<[^>]*>", ""), r"\s+", " "))
    rows = pieces.select("id", "place", tag.alias("tag"), text.alias("paragraph")).where("paragraph <> ''")
    heading = F.regexp_like("tag", F.lit("^h[1-6]$"))
    rows = rows.where(heading | F.col("tag").isin("pre", "code") | (F.size(F.split("paragraph", " ")) >= words))
    last = F.last(F.when(heading, F.col("paragraph")), ignorenulls=True).over(Window.partitionBy("id").orderBy("place"))
    return rows.select("id", "place", F.coalesce(last, F.lit(SECTION)).alias("section"), "paragraph")


def expand_archives(files: DataFrame, suffixes: tuple[str, ...] = (".txt", ".csv", ".json", ".xml", ".html", ".log"), deepest: int = 3) -> DataFrame:
    """(path, member, content, reason) of the members with a supported suffix; nested archives expand too.

    An archive that is broken, or nested deeper than ``deepest``, gives one row
    without content that says so; members with other suffixes give none.
    """

    def members(data: bytes, prefix: str = "", depth: int = 0) -> Iterator[tuple[str, bytes | None, str | None]]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
            entries = archive.infolist()
        except zipfile.BadZipFile:
            yield prefix.rstrip("/"), None, "BAD_ARCHIVE"
            return
        for e in entries:
            name, nested = prefix + e.filename, e.filename.lower().endswith(".zip")
            if nested and depth >= deepest:
                yield name, None, "TOO_DEEP"
            elif nested or e.filename.lower().endswith(suffixes):
                try:
                    content = archive.read(e)
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                    yield name, None, "BAD_MEMBER"
                    continue
                if nested:
                    yield from members(content, f"{name}/", depth + 1)
                else:
                    yield name, content, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *m) for p, data in zip(pdf["path"], pdf["content"], strict=True) for m in members(data or b"")], columns=["path", "member", "content", "reason"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary, reason string")


def flatten_json(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, value): "a.b[0]" paths of a JSON text's values; texts that are no JSON give no rows."""
    kind = df.schema[id_col].dataType.simpleString()

    def walk(x: object, key: str, depth: int) -> Iterator[tuple[str, str]]:
        if depth > DEPTH:
            return
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, f"{key}.{k}" if key else k, depth + 1)
        elif isinstance(x, list):
            for i, v in enumerate(x[:ITEMS]):
                yield from walk(v, f"{key}[{i}]", depth + 1)
        elif x is not None and str(x).strip():
            yield key, str(x).strip()[:VALUE]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                try:
                    out += [(i, k, v) for k, v in walk(json.loads(text or ""), "", 0)]
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=["id", "key", "value"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, key string, value string")


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both frames' rows, the newest of each key by ``order``; fresh rows win ties."""
    both = existing.withColumn("__fresh", F.lit(0)).unionByName(fresh.withColumn("__fresh", F.lit(1)))
    return first_per(both, keys, [F.desc(order), F.desc("__fresh")]).drop("__fresh")


def import_feedback(fresh: DataFrame, existing: DataFrame, required: list[str], keys: list[str], most: int = 500, longest: int = 4000) -> DataFrame:
    """Valid feedback rows that aren't known yet: required fields filled, fields cut to ``longest``, at most ``most`` rows (a limit of the import format)."""
    from lodestone.operators.matching import absent

    ok = F.lit(True)
    for c in required:
        ok = ok & (F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    cut = fresh.where(ok).select(*[F.substring(F.col(c), 1, longest).alias(c) if t == "string" else F.col(c) for c, t in fresh.dtypes])
    return absent(cut.dropDuplicates(keys), existing, keys).orderBy(*keys).limit(most)


def replicate(tables: dict[str, DataFrame], dirty: set[str], roots: list[str]) -> list[str]:
    """Overwrite each dirty table in each replica folder; returns the paths written."""
    done = []
    for name in sorted(dirty & tables.keys()):
        for root in roots:
            path = f"{root.rstrip('/')}/{name}.parquet"
            tables[name].write.mode("overwrite").parquet(path)
            done.append(path)
    return done
