"""Pages of a catalog's package search as a Spark data source.

A crawl lands each answer ``{"result": {"count": ..., "results": [...]}}`` under the offset that it was asked with, in
``start=<offset>`` folders, or many in one file of the folder ``answers``: there a line is an offset, a tab and the answer.
The source splits the pages into ranges, one partition each; a partition is nothing but a list of files or a range of
bytes, so reading it again after a failure gives the same rows. A crawl asks for the offset behind what it has, until it
has ``count`` packages or a page is empty: the same pages count here, whatever else lies in the folder.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.tables import materialise, on_workers

#: Pages in folders of their own, or bytes of a file of answers, that one partition reads.
PAGES, BYTES = 20, 8_000_000
#: Packages of pages in one file that travel as one batch, at least.
BATCH = 4000
SCHEMA = "start long, place int, total long, package string"

_START = re.compile(r"(?:^|/)start=([0-9]+)/([^_.][^/]*)$")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[int, list[str]]]:
    """Offsets of the landed pages in order, with their files."""
    files, root = _open(path)
    pages: dict[int, list[str]] = {}
    for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
        if info.type == fs.FileType.File and (m := _START.search(info.path)):
            pages.setdefault(int(m[1]), []).append(info.path)
    return sorted((start, sorted(names)) for start, names in pages.items())


def ranged(path: str, most: int = BYTES) -> list[tuple[str, int, int]]:
    """Files of answers in order, each cut into ranges of ``most`` bytes."""
    files, root = _open(path)
    found = files.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/answers", allow_not_found=True))
    sized = sorted((info.path, info.size) for info in found if info.type == fs.FileType.File and info.base_name[0] not in "_.")
    return [(name, lo, min(lo + most, size)) for name, size in sized for lo in range(0, size, most)]


def lines(files: fs.FileSystem, name: str, lo: int, hi: int) -> Iterator[bytes]:
    """Lines of a file that begin at ``lo`` or behind and before ``hi``."""
    with io.BufferedReader(files.open_input_file(name), 1 << 20) as f:
        at = 0
        if lo:
            f.seek(lo - 1)
            at = lo - 1 + len(f.readline())
        while at < hi and (line := f.readline()):
            at += len(line)
            if line := line.rstrip(b"\r\n"):
                yield line


def page(files: fs.FileSystem, names: list[str], start: int) -> tuple[int, list]:
    """Total and packages of a page; an answer without a list of results is an error that names its offset."""
    return answer(b"".join(files.open_input_stream(n).read() for n in names), start)


def answer(text: bytes, start: int) -> tuple[int, list]:
    try:
        result = json.loads(text)["result"]
        packages = result["results"]
        if not isinstance(packages, list):
            raise TypeError("not a list")
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"unexpected answer at start={start}: no list in result.results") from e
    total = result.get("count")
    return total if isinstance(total, int) else 0, packages


class Range(InputPartition):
    def __init__(self, path: str, pages: list[tuple[int, list[str]]]):
        super().__init__(pages[0][0])
        self.path, self.pages = path, pages


class Lines(InputPartition):
    def __init__(self, path: str, name: str, lo: int, hi: int):
        super().__init__((name, lo))
        self.path, self.name, self.lo, self.hi = path, name, lo, hi


def rows(pages: list[tuple[int, int, list]]) -> pa.RecordBatch:
    """Packages of pages ``(start, total, packages)``; an empty page has one row without a package, which tells where a crawl ends."""
    starts, places, totals, texts = [], [], [], []
    for start, total, packages in pages:
        text = [json.dumps(p, ensure_ascii=False) for p in packages] or [None]
        starts += [start] * len(text)
        places += range(len(text))
        totals += [total] * len(text)
        texts += text
    return pa.RecordBatch.from_arrays(
        [pa.array(starts, pa.int64()), pa.array(places, pa.int32()), pa.array(totals, pa.int64()), pa.array(texts, pa.string())],
        ["start", "place", "total", "package"],
    )


class PagesReader(DataSourceReader):
    def __init__(self, path: str, pages: int):
        self.path, self.pages = path, pages

    def partitions(self) -> list[InputPartition]:
        every = listed(self.path)
        folders = [Range(self.path, every[k : k + self.pages]) for k in range(0, len(every), self.pages)]
        return [*folders, *(Lines(self.path, *r) for r in ranged(self.path))]

    def read(self, partition: Range | Lines) -> Iterator[pa.RecordBatch]:
        files, _ = _open(partition.path)
        if isinstance(partition, Range):
            for start, names in partition.pages:
                yield rows([(start, *page(files, names, start))])
            return
        held, n = [], 0
        for line in lines(files, partition.name, partition.lo, partition.hi):
            start, tab, text = line.partition(b"\t")
            if not tab or not start.isdigit():
                raise ValueError(f"a line without an offset in {partition.name}")
            held.append((int(start), *answer(text, int(start))))
            n += len(held[-1][2])
            if n >= BATCH:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)


class PagedPackages(DataSource):
    """``spark.read.format("paged_packages").option("pages", 20).load(folder)``; the folder is one that pyarrow opens on every executor."""

    @classmethod
    def name(cls) -> str:
        return "paged_packages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        path, pages = self.options.get("path"), int(self.options.get("pages", PAGES))
        if not path or pages < 1:
            raise ValueError("a folder and at least one page a partition are needed")
        return PagesReader(path, pages)


def scan(spark: SparkSession, path: str, pages: int = PAGES) -> DataFrame:
    """All landed pages: (start, place, total, package), an empty page with a null package."""
    on_workers(spark)
    spark.dataSource.register(PagedPackages)
    return spark.read.format(PagedPackages.name()).option("pages", pages).load(path)


def crawled(landed: DataFrame) -> DataFrame:
    """Packages ``(start, place, package)`` of the pages that a crawl reads from offset 0 on.

    The first page's ``total`` says when it ends. Each page leads to the one at its offset plus its packages; it ends at an
    empty page or a missing one too. Only a row for each page, without packages, is compared. An offset landed twice is an error.
    """
    heads = materialise(landed.groupBy("start").agg(F.count("package").alias("n"), F.max("total").alias("total"), F.max("place").alias("last")))
    twice = heads.where("n > last + 1").agg(F.min("start").alias("start")).first()["start"]
    if twice is not None:
        raise ValueError(f"more than one answer at start={twice}")
    packages = landed.where("package is not null")
    total = heads.where("start = 0").agg(F.max("total").alias("wanted"))  # one row
    jump = heads.where("n > 0").select("start", (F.col("start") + F.col("n")).alias("next"))
    steps = materialise(jump.join(heads.select(F.col("start").alias("next")), "next", "left_semi"))
    if heads.count() == steps.select("next").distinct().count() + 1 and not heads.where("start = 0").isEmpty():
        read = packages  # each page but the first has one that leads to it
    else:
        on_the_way, jump = heads.where("start = 0").select("start"), steps
        while True:
            new = materialise(on_the_way.join(jump, "start").select(F.col("next").alias("start")).join(on_the_way, "start", "left_anti").distinct())
            if new.isEmpty():
                break
            on_the_way = materialise(on_the_way.unionByName(new))
            far = jump.select(F.col("start").alias("next"), F.col("next").alias("far"))
            jump = materialise(jump.join(far, "next").select("start", F.col("far").alias("next")))
        read = packages.join(on_the_way, "start", "left_semi")
    return read.join(F.broadcast(total)).where(F.col("start") < F.col("wanted")).select("start", "place", "package")
