"""One scan for files of any known kind: the kind follows from the content, and a registry has a parser for each kind.

Files are read by Spark's binary file source, which deals them to tasks by size.
A parser is a generator, so a file's records leave in batches; ``register``
makes the same parsers a table function for SQL.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.files import BLOCK, HIDDEN, MAGIC, SECTION, read_files

#: A record: the section it stands in, its text, and its fields by name.
Record = tuple[str, str, dict[str, str]]
Parser = Callable[[str], Iterator[Record]]

RECORD = "section string, text string, fields map<string,string>"
#: Records in a batch.
BATCH = 4096

_PARSERS: dict[str, Parser] = {}


def parser(kind: str) -> Callable[[Parser], Parser]:
    """Register a parser of texts of ``kind``; a later one of the same kind takes its place."""

    def add(fn: Parser) -> Parser:
        _PARSERS[kind] = fn
        return fn

    return add


def kind_of(data: bytes) -> str:
    """The kind of a file by its content: a binary kind by its first bytes, else html, xml, json, csv or text."""
    head = data[:4].hex().upper()
    for kind, magic in MAGIC.items():
        if head.startswith(magic):
            return kind
    if b"\0" in data[:4096]:
        return "unknown"
    start = data[:4096].decode("utf-8", "replace").lstrip("﻿ \t\r\n").lower()
    if start.startswith(("<!doctype html", "<html")) or re.match(r"<(head|body|div|p|h[1-6])\b", start):
        return "html"
    if start.startswith("<?xml") or re.match(r"<[a-z_][\w.:-]*[\s>/]", start):
        return "xml"
    if start[:1] in ("{", "[") and re.match(r'[\[{]\s*(["{\[\]}]|-?\d|true|false|null)', start):
        return "json"
    lines = start.splitlines()[:5]
    commas = {x.count(",") for x in (lines[:-1] if len(lines) > 1 else lines)}
    return "csv" if len(lines) > 1 and len(commas) == 1 and commas != {0} and " " not in lines[0].replace(", ", ",").split(",")[0] else "text"


@parser("text")
def _text(content: str) -> Iterator[Record]:
    for line in content.split("\n"):
        if line.strip():
            yield "", line, {}


@parser("csv")
def _csv(content: str) -> Iterator[Record]:
    for row in csv.DictReader(io.StringIO(content)):
        fields = {k: v for k, v in row.items() if k is not None and isinstance(v, str)}
        yield "", " | ".join(f"{k}={v}" for k, v in fields.items()), fields


def _flat(value: object, key: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(v, f"{key}.{k}" if key else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _flat(v, f"{key}[{i}]")
    elif value is not None:
        yield key, str(value)


@parser("json")
def _json(content: str) -> Iterator[Record]:
    """A record for each line that is a JSON value, or for the items of one list, or for one value."""
    lines = [x for x in content.split("\n") if x.strip()]
    try:
        values = [json.loads(x) for x in lines]
    except ValueError:
        values = [json.loads(content)]
    if len(values) == 1 and isinstance(values[0], list):
        values = values[0]
    for value in values:
        fields = dict(_flat(value))
        yield "", " | ".join(f"{k}={v}" for k, v in fields.items()), fields


@parser("xml")
def _xml(content: str) -> Iterator[Record]:
    """A record for each element below the root; its leaves are the fields."""
    root = ElementTree.fromstring(content)
    name = root.tag.rsplit("}", 1)[-1]
    for element in root:
        fields = {f"@{k}": v for k, v in element.attrib.items()}
        fields |= {x.tag.rsplit("}", 1)[-1]: (x.text or "").strip() for x in element.iter() if not len(x) and x is not element}
        yield name, " | ".join(f"{k}={v}" for k, v in fields.items()) or (element.text or "").strip(), fields


@parser("html")
def _html(content: str) -> Iterator[Record]:
    """Text blocks under their last heading; headings and preformatted text of any length, others of three words."""
    section = SECTION
    parts = re.split("\x01", re.sub(BLOCK, "\x01\\1\\2\x02", re.sub(HIDDEN, " ", content)))
    for part in parts:
        tag, _, body = part.partition("\x02") if "\x02" in part else ("", "", part)
        text = re.sub(r"\s+", " ", re.sub("<[^>]*>", "", body)).strip()
        heading = re.fullmatch("h[1-6]", tag.lower()) is not None
        if text and (heading or tag.lower() in ("pre", "code") or len(text.split(" ")) >= 3):
            if heading:
                section = text
            yield section, text, {}


def parse(data: bytes | None) -> Iterator[tuple[str, str | None, Record | None]]:
    """(kind, error, record) of a file's content: its records, or one row without a record that says why there is none."""
    if not data:
        yield "empty", "EMPTY", None
        return
    kind = kind_of(data)
    if kind not in _PARSERS:
        yield kind, "NO_PARSER", None
        return
    try:
        for record in _PARSERS[kind](data.decode("utf-8-sig", "replace")):
            yield kind, None, record
    except (ValueError, ElementTree.ParseError, csv.Error) as error:
        yield kind, f"BROKEN: {type(error).__name__}", None


def records(files: DataFrame) -> DataFrame:
    """(path, kind, error, place, section, text, fields) of ``files`` (path, content): a row for each record, in the order of the file.

    Content that is empty or null, broken, or of a kind without a parser has a
    row that says so in ``error``; what a broken file gave before its fault
    stays. Spark's scan leaves out files of no bytes.
    """
    fields = pa.map_(pa.string(), pa.string())
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("error", pa.string()), ("place", pa.int32()), ("section", pa.string()), ("text", pa.string()), ("fields", fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for place, (kind, error, record) in enumerate(parse(content.as_py())):
                    section, text, named = record or (None, None, None)
                    held.append((path.as_py(), kind, error, place, section, text, None if named is None else list(named.items())))
                    if len(held) == BATCH:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return files.select("path", "content").mapInArrow(run, f"path string, kind string, error string, place int, {RECORD}")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """``records`` of all files below ``path``, whatever their kinds and names, in one scan."""
    return records(read_files(spark, path))


def register(spark: SparkSession, name: str = "file_records") -> None:
    """Make ``parse`` a table function: ``SELECT ... FROM files, LATERAL file_records(content)``."""

    @F.udtf(returnType=f"kind string, error string, place int, {RECORD}")
    class Records:
        def eval(self, content: bytes):
            for place, (kind, error, record) in enumerate(parse(bytes(content) if content is not None else None)):
                yield (kind, error, place, *(record or (None, None, None)))

    spark.udtf.register(name, Records)
