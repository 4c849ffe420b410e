from __future__ import annotations

import json

from pyspark.sql import functions as F

from mapquarry.sources import ckan, fgdc, sinks, stac


def test_ckan(spark, tmp_path):
    box = [("bbox-west-long", "10"), ("bbox-east-long", "-10"), ("bbox-south-lat", "1"), ("bbox-north-lat", "2"), ("temporal-extent-begin", "2020"), ("temporal-extent-end", "2019")]
    rows = [
        {"id": "a", "title": "T", "license_title": "MIT", "extras": [{"key": k, "value": v} for k, v in box], "tags": [{"name": "Road Map"}], "resources": [{"id": "r", "format": " CSV ", "url": "u"}]},
        {"title": "no id"},
    ]
    (tmp_path / "in.json").write_text(json.dumps(rows))
    env = ckan.envelope(ckan.read(spark, str(tmp_path / "in.json")))
    got = {r["title"]: r for r in env.collect()}
    a = got["T"]
    assert (a["space"]["west"], a["space"]["east"]) == (-10.0, 10.0) and a["time"]["end"] == a["time"]["begin"] == "20200101 00:00:00"
    assert a["keywords"][0]["canonical"] == "road map" and got["no id"]["space"] is None and len(got["no id"]["id"]) == 40
    t = ckan.tables(env)
    assert t["has_format"].first()["entity_id"] == "format:csv" and t["license"].count() == 1 and t["dataset"].count() == 2
    t["dataset"].select("id", "title").write.parquet(str(tmp_path / "old"))
    new = spark.createDataFrame([("a", None), ("z", "Z")], "id string, title string")
    sinks.merge_table(new, str(tmp_path / "old"), ["id"], str(tmp_path / "out"), keep=("title",))
    assert {(r.id, r.title) for r in spark.read.parquet(str(tmp_path / "out")).where("id in ('a', 'z')").collect()} == {("a", "T"), ("z", "Z")}


def test_stac(spark, tmp_path):
    doc = {
        "type": "Collection", "id": "c", "title": "A collection of tiles", "keywords": ["Sea", "sea", "Land"], "numberMatched": 7,
        "extent": {"spatial": {"bbox": [[0, 1, 5, 2, 3, 9]]}, "temporal": {"interval": [["2020-01-01T00:00:00Z", None]]}},
        "links": [{"rel": "items", "href": "http://a/b.tif", "type": "image/tiff; application=geotiff"}, {"rel": "x", "href": "y"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc))
    docs = stac.collections(stac.read(spark, str(tmp_path)))
    e = stac.extent(docs).first()
    assert (e.west, e.south, e.east, e.north, e.begin, e.end) == (0, 1, 2, 3, "20200101 00:00:00", "99991231 00:00:00")
    assert stac.extent(docs, parity=True).first().east == 5
    assert {r.name for r in stac.keywords(docs).collect()} == {"Sea", "Land"} and stac.item_count(docs).first().item_count == 7
    assert [r.format for r in stac.resources(docs).collect()] == ["GeoTIFF"] and stac.topic_text(docs).first().topic_text.startswith("A coll")
    links = spark.createDataFrame([("r/", "a"), ("a", "b/"), ("b", "r"), ("b", "c"), ("z", "q")], "src string, dst string")
    seen = stac.crawl(links, spark.createDataFrame([("r",)], "url string"))
    assert {(r.url, r.depth) for r in seen.collect()} == {("r", 0), ("a", 1), ("b", 2), ("c", 3)}


def test_fgdc(spark):
    html = (
        "<script>x</script><p>Title: Roads</p><p>Originator: Dept. of Maps</p><p>Originator: dept of maps</p><p>Abstract: All roads</p><p>Purpose: p</p><p>Calendar_Date: 2001</p><p>Calendar_Date: 20020304</p>"
        "<p>West_Bounding_Coordinate: -80</p><p>East_Bounding_Coordinate: -70</p><p>South_Bounding_Coordinate: 40</p><p>North_Bounding_Coordinate: 42</p><p>Theme_Keyword: Roads</p><p>Access_Constraints: none</p>"
    )
    r = fgdc.metadata(spark.createDataFrame([("u", html)], "url string, html string")).first()
    assert (r.title, r.originators, r.notes, r.begin, r.end, r.keywords) == ("Roads", ["dept of maps"], "All roads", "20010101 00:00:00", "20020304 23:59:59", ["roads"])
    assert r.space.west == -80 and r.license_id.startswith("lic:")
    page = '<a href="x.zip">1</a><a href="/y/search?q">2</a><a href="FullMetadataDisplay.aspx?file=z">3</a>'
    got = fgdc.links(spark.createDataFrame([("http://h/a/b", page)], "url string, html string")).orderBy("link").collect()
    assert [(g.link, g.format, g.type) for g in got] == [("http://h/a/FullMetadataDisplay.aspx?file=z", "HTML", "metadata"), ("http://h/a/x.zip", "ZIP", "link")]
    lists = spark.createDataFrame([("p", 2, "DataSummary.aspx?dataset=1"), ("q", 1, "DataSummary.aspx?dataset=1 DataSummary.aspx?dataset=2")], "provider string, ordinal int, html string")
    assert {(r.dataset, r.provider) for r in fgdc.listing(lists).collect()} == {("1", "q"), ("2", "q")}


def test_merge_log(spark, tmp_path):
    df = spark.createDataFrame([('a "x", y', 1)], "why string, n int")
    sinks.write_merge_log(df, str(tmp_path / "log"))
    back = spark.read.csv(str(tmp_path / "log"), header=True, quote='"', escape='"')
    assert back.first()["why"] == 'a "x", y'
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).select(F.col("n")).first()[0] == 1


def test_long_listings_are_whole(spark):
    one = F.struct(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.array(F.struct(F.lit("self").alias("rel"), F.concat(F.lit("./"), "id").alias("href"))).alias("links"))
    docs = spark.range(6000).groupBy(F.lit("http://h/").alias("url")).agg(F.collect_list(one).alias("collections"))
    fetched = spark.createDataFrame([("http://h/5999", "5999", "new")], "url string, id string, title string")
    got = stac.listing(docs, fetched)
    assert got.select("id").distinct().count() == got.count() == 6000
    assert [r["id"] for r in got.where("title = 'new'").collect()] == ["5999"]


def test_pages_are_searched_once_for_each_label(spark):
    """Values of a page are bound before dates and boxes use them; of several dates the first and the last count, unreadable ones too."""
    pages = spark.createDataFrame(
        [("a", "<p>Calendar_Date: 2020</p><p>Calendar_Date: bad</p><p>Ending_Date: 2021</p>"), ("b", "<p>Calendar_Date: 2019</p><p>Calendar_Date: bad</p>"), ("c", None), ("d", "")], "url string, html string"
    )
    made = fgdc.metadata(pages)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("West_Bounding_Coordinate:\\E(?<=") <= 2 and plan.count("Calendar_Date:\\E(?<=") == 1 and plan.count("(script|style)") == 1
    got = {r["url"]: (r["begin"], r["end"]) for r in made.collect()}
    assert got == {"a": ("20200101 00:00:00", "20211231 23:59:59"), "b": ("20190101 00:00:00", "20191231 23:59:59"), "c": (None, None), "d": (None, None)}


def test_text_equals_a_plain_reader(spark):
    import random
    import re

    from mapquarry.functions import text as X

    def plain(html):
        out, (*pieces, last) = "", re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", html).split(">")
        for p in pieces:
            at = p.find("<")
            if not 0 <= at < len(p) - 1:
                out += p + ">"
                continue
            tag = p[at + 1 :].lower()
            out += p[:at] + "\n" * (tag in X.ENDS_LINE or tag.startswith("pre") or bool(re.search(r"^[bh]r[ \t\n\r\x0b\f]*/?(\r\n|[\n\r\x85\u2028\u2029])?\Z", tag)))
        out += last
        for k, v in X.REFERENCES.items():
            out = out.replace(k, v)
        return re.sub("[\t\x0b\f\r\n]+", "\n", out).strip(" \n")

    rnd = random.Random(3)
    bits = ["<", ">", "<>", "/p", "</p>", "<BR/>", "<br / >", "<hr/\n>", "<br/\x85>", "<Pre x>", "a", "é😀", " ", "\n", "&amp;lt;", "<script>", "</script>", "</H3>", "<foo <br>", "$1", "\\"]
    pages = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(13))) for _ in range(3000)] + ["<" * 200_000]
    got = spark.createDataFrame(enumerate(pages), "k int, html string").select("k", X.html_to_text(F.col("html")).alias("t")).collect()
    assert [r["t"] for r in sorted(got)] == [plain(p) for p in pages]
