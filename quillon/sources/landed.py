"""Landed files as a Spark data source: ``spark.read.format("landed")``.

Kinds of files: ``mail`` (.eml, an item each), ``json`` (a list of items at ``items``; with ``lines`` a payload on each
line) and ``page`` (HTML cards found by ``card`` and ``selectors``). A row is (path, position, item, error): the item
as JSON, or why there is none. A bad item, line or file costs nobody else's rows.

Files are packed into partitions by size. Only what the schema asks for is done: with ``path`` alone no file is opened.
Conditions on ``path`` are pushed down and choose files by name. Stores are those that Arrow knows (file, hdfs, s3, gs);
for others see :func:`quillon.sources.listings.json_items` and ``mails``, which read through Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from quillon.sources.listings import Selector, card_items, parse_mail

SCHEMA = "path string, position int, item string, error string"
#: Bytes and files of one partition at most, one file aside that is larger.
PART_BYTES, PART_FILES = 64 << 20, 1_000
#: Rows of one Arrow batch.
BATCH = 500


@dataclass
class Files(InputPartition):
    paths: list[str]
    problem: str | None = None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def items_of(written: bytes, items: str) -> list[tuple[object, str | None]]:
    """(item, error) of each entry of the list at a dotted path; entries that are no objects are errors of their own."""
    payload = json.loads(written)
    for part in filter(None, items.split(".")):
        payload = payload.get(part) if isinstance(payload, dict) else None
    if not isinstance(payload, list):
        raise ValueError("no list of items")
    return [(x, None) if isinstance(x, dict) else (None, f"item is no object: {json.dumps(x, ensure_ascii=False)}") for x in payload]


class LandedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options, self.columns, self.names = dict(options), columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on path decide by name; others stay with Spark."""
        tests = {EqualTo: lambda p, v: p == v, In: lambda p, v: p in v, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda p, v: v in p}
        for f in filters:
            if type(f) in tests and f.attribute == ("path",):
                self.names.append((type(f).__name__, f.value))
            else:
                yield f

    def _chosen(self, path: str) -> bool:
        tests = {"EqualTo": lambda v: path == v, "In": lambda v: path in v, "StringStartsWith": path.startswith, "StringEndsWith": path.endswith, "StringContains": lambda v: v in path}
        return all(tests[kind](value) for kind, value in self.names)

    def partitions(self) -> list[Files]:
        """Names alone are looked at: of ``newest`` files (if given) those that sort last, without names that begin
        with . or _."""
        store, root = opened(self.options["path"])
        found = store.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            return [Files([], f"no such path: {self.options['path']}")]
        infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        wanted = {"mail": (".eml",)}.get(self.options.get("kind", "json"), "")
        infos = sorted((i for i in infos if i.type == fs.FileType.File and i.base_name[0] not in "._" and i.path.endswith(wanted)), key=lambda i: i.path)
        if (newest := self.options.get("newest")) is not None:
            infos = infos[max(0, len(infos) - int(newest)) :]
        parts, size = [], 0
        for i in (i for i in infos if self._chosen(i.path)):
            if not parts or size + i.size > PART_BYTES or len(parts[-1].paths) >= PART_FILES:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(i.path)
            size += i.size
        return parts or [Files([])]

    def _rows(self, store: fs.FileSystem, path: str) -> Iterator[tuple]:
        kind, lines = self.options.get("kind", "json"), self.options.get("lines", "false") == "true"
        if self.columns == ["path"] and kind == "mail":
            yield path, 0, None, None
            return
        try:
            with store.open_input_file(path) as f:
                content = f.read()
            if kind == "mail":
                sender, subject, body, links = parse_mail(content)
                yield path, 0, json.dumps({"sender": sender, "subject": subject, "body": body, "links": links}, ensure_ascii=False), None
            elif kind == "page":
                card = Selector.parse(self.options["card"])
                named = {k: Selector.parse(v) for k, v in json.loads(self.options.get("selectors", "{}")).items()}
                cards = list(card_items(content.decode("utf-8", "replace"), card, named))
                for i, c in enumerate(cards):
                    yield path, i, json.dumps(c, ensure_ascii=False), None
                if not cards:
                    yield path, None, None, "no card found"
            else:
                at = 0
                for payload in content.splitlines() if lines else [content]:
                    if lines and not payload.strip():
                        continue
                    try:
                        entries = items_of(payload, self.options.get("items", ""))
                    except ValueError as e:
                        if not lines:
                            raise
                        entries = [(None, f"{type(e).__name__}: {e}")]
                    for item, error in entries:
                        yield path, at, None if item is None else json.dumps(item, ensure_ascii=False), error
                        at += 1
        except Exception as e:  # costs this file's rows alone
            yield path, None, None, f"{type(e).__name__}: {e}"

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = {"path": pa.string(), "position": pa.int32(), "item": pa.string(), "error": pa.string()}
        order = list(kinds)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[order.index(c)] for r in rows], kinds[c]) for c in self.columns], names=self.columns)

        held = [(None, None, None, partition.problem)] if partition.problem else []
        store, _ = opened(self.options["path"])
        for path in partition.paths:
            for row in self._rows(store, path):
                held.append(row)
                if len(held) >= BATCH:
                    yield batch(held)
                    held = []
        yield batch(held)


@dataclass
class Written(WriterCommitMessage):
    files: int


class LandedWriter(DataSourceWriter):
    """A file for each row (name, content) below the path, content as text in UTF-8 or as bytes. A task that runs again
    writes the same files again."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, rows) -> Written:
        store, root = opened(self.path)
        n = 0
        store.create_dir(root, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{root}/{row.name}") as f:
                f.write(row.content.encode() if isinstance(row.content, str) else bytes(row.content))
            n += 1
        return Written(n)


class Landed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> LandedWriter:
        return LandedWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``format("landed")`` known to the session, with its conditions on names pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Landed)


