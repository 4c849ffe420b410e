"""The paged source against a crawl, and its rereading after a lost partition."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import textwrap

import pytest

from mapquarry.sources import paged


def land(folder, pages, total):
    for start, ids in pages.items():
        at = folder / f"start={start}"
        at.mkdir(parents=True)
        text = ids if isinstance(ids, str) else json.dumps({"result": {"count": total, "results": [{"id": i, "title": f"ü {i}"} for i in ids]}})
        (at / "part-0.txt").write_text(text[: len(text) // 2])  # an answer may lie in several files
        (at / "part-1.txt").write_text(text[len(text) // 2 :])
    return str(folder)


def crawl(pages, total):
    start, out = 0, []
    while start < total and start in pages:
        out += pages[start]
        if not pages[start]:
            break
        start += len(pages[start])
    return out


@pytest.mark.parametrize(
    ("pages", "total"),
    [
        ({0: [0, 1, 2], 3: [3, 4, 5], 6: [6]}, 7), ({0: [0, 1], 2: [2], 3: [3, 4]}, 4), ({0: [0, 1], 2: [], 3: [3]}, 9), ({0: [0, 1], 4: [4]}, 9),
        ({0: [0, 1, 2], 1: [9, 9], 3: [3], 4: [4, 5, 6], 7: [7]}, 6), ({0: []}, 0), ({0: [0, 1], 2: [2]}, 1), ({5: [5]}, 9),
    ],
)
@pytest.mark.parametrize("size", [1, 20])
def test_equals_a_crawl(spark, tmp_path, pages, total, size):
    landed = paged.scan(spark, land(tmp_path / "pages", pages, total), size)
    assert landed.rdd.getNumPartitions() == -(-len(pages) // size)
    got = paged.crawled(landed).orderBy("start", "place").collect()
    assert [json.loads(r["package"])["id"] for r in got] == crawl(pages, total)


def test_other_files_are_not_pages_and_bad_answers_are_named(spark, tmp_path):
    path = land(tmp_path / "pages", {0: [1]}, 1)
    (tmp_path / "pages" / "_SUCCESS").write_text("")
    (tmp_path / "pages" / "start=7").mkdir()
    assert paged.listed(path)[0][0] == 0 and len(paged.listed(path)) == 1
    for text in ("{", "[]", json.dumps({"result": {"count": 3, "results": {"a": 1}}})):
        bad = land(tmp_path / f"bad{len(text)}", {0: [1], 40: text}, 41)
        with pytest.raises(Exception, match="start=40"):
            paged.scan(spark, bad).collect()
    with pytest.raises(ValueError):
        paged.PagedPackages({}).reader(None)


def test_a_lost_partition_is_read_again(tmp_path):
    """The first attempt at the second partition fails behind its first page; Spark reads it again and no row is lost or doubled."""
    path = land(tmp_path / "pages", {k: [k, k + 1] for k in range(0, 12, 2)}, 12)
    (tmp_path / "broken_source.py").write_text(textwrap.dedent("""
        import os
        from mapquarry.sources import paged

        class Reader(paged.PagesReader):
            def read(self, partition):
                for k, batch in enumerate(super().read(partition)):
                    mark = os.path.join(self.path, "..", "failed")
                    if partition.pages[0][0] == 4 and k == 1 and not os.path.exists(mark):
                        open(mark, "w").close()
                        raise OSError("lost")
                    yield batch

        class Source(paged.PagedPackages):
            @classmethod
            def name(cls):
                return "broken"

            def reader(self, schema):
                return Reader(self.options["path"], 2)
    """))
    script = textwrap.dedent(f"""
        from pyspark.sql import SparkSession
        import broken_source
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        spark.dataSource.register(broken_source.Source)
        rows = spark.read.format("broken").load({path!r}).collect()
        print("ROWS", sorted((r["start"], r["place"]) for r in rows) == [(k, i) for k in range(0, 12, 2) for i in (0, 1)])
    """)
    env = os.environ | {"PYTHONPATH": f"{tmp_path}:{os.environ['PYTHONPATH']}"}
    out = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS True" in out.stdout and (tmp_path / "failed").exists(), out.stderr[-2000:]


def test_answers_in_one_file_equal_a_crawl(spark, tmp_path, monkeypatch):
    """Lines cut by ranges of any size are read once each; an offset landed twice and a line without one are errors."""
    pages = {0: [0, 1, 2], 1: [9], 3: [3, 4, 5], 6: [6], 7: []}
    text = lambda ids: json.dumps({"result": {"count": 7, "results": [{"id": i, "title": f"ü\u2028\x85 {i}"} for i in ids]}}, ensure_ascii=False)
    folder = tmp_path / "pages" / "answers"
    folder.mkdir(parents=True)
    (folder / "_SUCCESS").write_text("")
    (folder / "part-0").write_text("".join(f"{k}\t{text(pages[k])}\n" for k in (6, 0, 7)))
    (folder / "part-1").write_text(f"3\t{text(pages[3])}\r\n\n1\t{text(pages[1])}")
    for most in (1, 50, 97, paged.BYTES):
        monkeypatch.setattr(paged.ranged, "__defaults__", (most,))
        got = paged.crawled(paged.scan(spark, str(tmp_path / "pages"))).orderBy("start", "place").collect() if most > 1 else None
        reader = paged.PagesReader(str(tmp_path / "pages"), 20)
        seen = sorted((r["start"], r["place"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist())
        assert seen == [(0, 0), (0, 1), (0, 2), (1, 0), (3, 0), (3, 1), (3, 2), (6, 0), (7, 0)]
        assert got is None or [json.loads(r["package"])["title"] for r in got] == [f"ü\u2028\x85 {i}" for i in crawl(pages, 7)]
    (folder / "part-2").write_text(f"3\t{text([3])}\n")
    with pytest.raises(ValueError, match="start=3"):
        paged.crawled(paged.scan(spark, str(tmp_path / "pages")))
    (folder / "part-2").write_text("{}\n")
    with pytest.raises(Exception, match="without an offset"):
        paged.scan(spark, str(tmp_path / "pages")).collect()


def test_ckan_pages_lands_fewer_files_than_pages(spark, sf, monkeypatch):
    from mapquarry.plans import landed as L
    from mapquarry.plans.queries import QUERIES

    paths, scan = [], paged.scan
    monkeypatch.setattr(L.paged, "scan", lambda spark, path: paths.append(path) or scan(spark, path))
    n = QUERIES["ckan_pages"](spark, sf).select("start").distinct().count()
    files = [f for _, _, names in os.walk(paths[0]) for f in names if not f.startswith(("_", "."))]
    assert n > 30 and len(files) <= 10
