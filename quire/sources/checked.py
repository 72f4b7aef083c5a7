"""Page files that may be damaged, as a Python data source: what can't be read becomes a row with a reason, never an exception."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quire.sources.stages import small_batches

SCHEMA = "path string, file string, doc_id string, offset bigint, page int, reason string, detail string, line string"
#: Bytes that one task reads; larger files are divided.
TASK_BYTES = 64 << 20

# Pages that are looked at; words under which a page counts as empty; share of empty pages that makes a scan.
SAMPLE, FEW_WORDS, SCANNED = 12, 5, 0.6
# End of the fixed values.


@dataclass
class Stretch:
    """Bytes ``begin`` to ``end`` of a file of ``size`` bytes; a line belongs to the stretch in which it begins."""

    path: str
    begin: int
    end: int
    size: int


@dataclass
class Task(InputPartition):
    stretches: list[Stretch]


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _doc_id(path: str) -> str:
    return _name(path).rsplit(".", 1)[0] or _name(path)


def _judged(raw: bytes) -> tuple[int | None, str | None, str | None, str | None]:
    """page, reason, detail, line of one line of a file."""
    try:
        line = raw.decode("utf-8")
        found = json.loads(line)
    except (ValueError, RecursionError) as e:
        return None, "corrupt", f"{type(e).__name__}: {e}"[:200], None
    if isinstance(found, dict) and found.get("encrypted") is True:
        return None, "protected", "the file says that it is encrypted", None
    page = found.get("page") if isinstance(found, dict) else None
    if type(page) is not int or not 0 <= page < 1 << 31:
        return None, "corrupt", "no page number", None
    return page, None, None, line


def _is_head(raw: bytes) -> bool:
    """Whether a file's first line describes the file, and is no page."""
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and "page" not in found


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path") or ""
        self.bytes = int(options.get("bytes_per_task", TASK_BYTES))
        self.wanted: dict[str, set[str]] = {}
        if not self.path or self.bytes < 1:
            raise ValueError("checked_pages needs a path, and a positive bytes_per_task")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and IN on file and doc_id choose files before any is opened; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in ("file", "doc_id"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                column = f.attribute[0]
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def _asked_for(self, path: str) -> bool:
        own = {"file": _name(path), "doc_id": _doc_id(path)}
        return all(own[c] in values for c, values in self.wanted.items())

    def partitions(self) -> list[InputPartition]:
        system, root = files.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type != files.FileType.Directory else system.get_file_info(files.FileSelector(root, recursive=True))
        tasks: list[InputPartition] = []
        now: list[Stretch] = []
        free = self.bytes
        for one in sorted(found, key=lambda i: i.path):
            inside = one.path[len(root) :] if one is not info else ""
            if one.type == files.FileType.Directory or any(p[:1] in ("_", ".") for p in inside.split("/")) or not self._asked_for(one.path):
                continue
            size = one.size if one.type == files.FileType.File else -1
            for begin in range(0, max(size, 1), self.bytes):
                end = min(begin + self.bytes, max(size, 0))
                now.append(Stretch(one.path, begin, end, size))
                free -= max(end - begin, 1 << 16)  # opening a file costs as much as reading some bytes
                if free <= 0:
                    tasks.append(Task(now))
                    now, free = [], self.bytes
        return [*tasks, Task(now)] if now else tasks or [Task([])]

    def read(self, task: Task) -> Iterator[tuple]:
        system, _ = files.FileSystem.from_uri(self.path)
        for s in task.stretches:
            name, doc_id = _name(s.path), _doc_id(s.path)
            try:
                for offset, page, reason, detail, line in _rows(system, s):
                    yield s.path, name, doc_id, offset, page, reason, detail, line
            except Exception as e:  # whatever a file system raises is a fact about this file
                yield s.path, name, doc_id, s.begin, None, "unreadable", f"{type(e).__name__}: {e}"[:200], None


def _rows(system: files.FileSystem, s: Stretch) -> Iterator[tuple]:
    if s.size < 0:
        yield 0, None, "missing", "no such file", None
        return
    if s.size == 0:
        yield 0, None, "empty", "no bytes", None
        return
    with system.open_input_file(s.path) as raw, io.BufferedReader(raw, 1 << 20) as stream:
        head = stream.readline()
        start = head.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
        if start not in (b"", b"{"):
            if s.begin == 0:
                yield 0, None, "unsupported", "the file doesn't hold JSON lines", None
            return
        described = bool(start) and _is_head(head.lstrip(b"\xef\xbb\xbf"))
        if described and _judged(head.lstrip(b"\xef\xbb\xbf"))[1] == "protected":
            if s.begin == 0:
                yield 0, None, "protected", "the file says that it is encrypted", None
            return
        at = len(head)
        if s.begin == 0 and start and not described:
            yield (0, *_judged(head.lstrip(b"\xef\xbb\xbf")))
        if s.begin > at:
            stream.seek(s.begin - 1)
            at = s.begin - 1 + len(stream.readline())
        any_line = s.begin > 0 or (bool(start) and not described)
        while at < s.end or not any_line:  # the first stretch looks on until it knows that there are pages
            line = stream.readline()
            if not line:
                break
            if line.strip():
                any_line = True
                if at < s.end:
                    yield (at, *_judged(line))
            at += len(line)
        if not any_line:
            yield 0, None, "no pages", "no line holds a page", None


class CheckedPages(DataSource):
    """``spark.read.format("checked_pages").load(path)``: a row a page, and a row with a reason for whatever isn't one.

    ``path`` is a file or a folder (with its folders; names with ``_`` or ``.`` in front are left out) of JSON lines, on any file
    system that pyarrow opens. Columns: path, file, doc_id (the name without its ending), offset (of the line), page, reason, detail,
    line (the page as JSON). reason is null for pages, else: missing, empty, unsupported (no JSON lines), protected, no pages,
    unreadable (the file system failed), corrupt (this line only). A first line without a page number describes its file.
    Option ``bytes_per_task``: larger files are divided at line ends.
    """

    @classmethod
    def name(cls) -> str:
        return "checked_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PageReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark hand filters to it. A worker then holds few lines at a time: pages may be long."""
    small_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CheckedPages)


def inspected(pages: DataFrame, keys: list[str], page: str, words: str, images: str) -> DataFrame:
    """keys, n_pages, estimated_words, likely_scanned: a verdict on each file from twelve of its pages at even distances.

    ``words`` is a page's number of words, ``images`` whether it holds any. A page of fewer than five words with an image is
    empty; a file with six in ten of the sampled pages empty (one at least) is a scan. Nulls count as 0 and false.
    """
    own = pages.select(*keys, F.col(page).alias("_page"), F.coalesce(F.col(words), F.lit(0)).alias("_w"), F.coalesce(F.col(images), F.lit(False)).alias("_i"))
    ranked = own.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_page", "_w", "_i")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    # Page k is sampled if it is floor(i * (n - 1) / 11) for some i: the least i that reaches k must not pass it.
    i = F.ceil(F.col("_k") * (SAMPLE - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = (F.floor(i * (F.col("_n") - 1) / (SAMPLE - 1)) == F.col("_k")) & (i < F.least(F.col("_n"), F.lit(SAMPLE)))
    empty = F.sum(((F.col("_w") < FEW_WORDS) & F.col("_i")).cast("int"))
    found = ranked.where(hit).groupBy(*keys).agg(F.first("_n").alias("n_pages"), F.sum("_w").alias("_sum"), F.count(F.lit(1)).alias("_m"), empty.alias("_empty"))
    return found.select(*keys, "n_pages", F.floor(F.col("_sum") / F.col("_m") * F.col("n_pages")).alias("estimated_words"), (F.col("_empty") >= F.greatest(F.lit(1), F.floor(F.col("_m") * SCANNED))).alias("likely_scanned"))
