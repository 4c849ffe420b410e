from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mapquarry.functions import geo, similarity, text, times, urls


def one(spark, **exprs):
    return spark.range(1).select(*[e.alias(k) for k, e in exprs.items()]).first().asDict(recursive=True)


def test_text(spark):
    L = F.lit
    r = one(
        spark, topic=text.canonical_topic(L(" Land--Cover_(2020)/x ")), kw=text.canonical_keyword(L("A-b_c/d  e!")), org=text.canonical_org(L("U.S. & Co-op"), True),
        org0=text.canonical_org(L("!!"), True), fmt=text.canonical_format(L("  ")), lic=text.license_id(L(" "), L("MIT License")), cut=text.shorten(L("abcdef"), 3),
        split=text.split_values(L("roads, rivers and lakes; & sand")), sig=text.token_signature(L("land surface temperature")), sig1=text.token_signature(L("land")),
        js=text.json_slice(L('x {"a": {"b": 1}} y')), ip=text.first_ip(L("1.2.3.4, 5.6.7.8")), cyr=text.has_cyrillic(L("карта")), slug=text.landing_slug(L("Roads & Rivers!")),
        sel=text.selections(L("Topic:1,3;Format:continue")), label=text.display_label(L(None).cast("string"), L(" "), L("n")), clean=text.clean(L("a ​ b")),
    )
    assert r["topic"] == "land cover 2020 x" and r["kw"] == "a-b_c/d e" and r["org"] == "u s & co-op" and r["org0"] == "unknown" and r["fmt"] == "unknown"
    assert r["lic"].startswith("lic:") and r["cut"] == "abc..." and r["split"] == ["roads", "rivers", "lakes", "sand"]
    assert r["sig"] == "land_surface_temperature" and r["sig1"] == "" and r["js"] == '{"a": {"b": 1}}' and r["ip"] == "1.2.3.4" and r["cyr"]
    assert r["slug"] == "roads-rivers" and r["label"] == "n" and r["clean"] == "a b"
    assert r["sel"] == [{"dim": "Topic", "indices": [1, 3]}, {"dim": "Format", "indices": []}]


@pytest.mark.parametrize(
    ("raw", "begin", "end"),
    [
        (None, times.OPEN_BEGIN, times.OPEN_END), (" ", times.OPEN_BEGIN, times.OPEN_END), ("-5", times.OPEN_BEGIN, times.OPEN_END),
        ("9999-12", times.OPEN_END, times.OPEN_END), ("2020", "20200101 00:00:00", "20201231 00:00:00"), ("2020-02", "20200201 00:00:00", "20200229 00:00:00"),
        ("2020/03/05", "20200305 00:00:00", "20200305 00:00:00"), ("2020-01-01T12:30:00Z", "20200101 12:30:00", "20200101 12:30:00"),
        ("2020-01-01T12:30:00+02:00", "20200101 10:30:00", "20200101 10:30:00"), ("soon", times.OPEN_BEGIN, times.OPEN_END),
    ],
)
def test_ckan_times(spark, raw, begin, end):
    c = F.lit(raw).cast("string")
    assert one(spark, b=times.ckan(c, True), e=times.ckan(c, False)) == {"b": begin, "e": end}


def test_stac_and_fgdc_times(spark):
    L = F.lit
    r = one(
        spark, a=times.stac(L("202013"), False), b=times.stac(L("20200102"), True), c=times.stac(L("2020-01"), True), d=times.fgdc(L("20200102 rest"), False),
        e=times.fgdc(L("2020"), False), f=times.fgdc(L("nope"), True), g=times.fgdc(L("2020/01/02"), True),
    )
    assert r == {"a": "20201231 00:00:00", "b": "20200102 00:00:00", "c": times.OPEN_BEGIN, "d": "20200102 23:59:59", "e": "20201231 23:59:59", "f": None, "g": "20200102 00:00:00"}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2020-2018", ("20180101 00:00:00", "20201231 23:59:59")), ("2018-01-01 to 2020-12-31", ("20180101 00:00:00", "20201231 23:59:59")),
        ("20180101", ("20180101 00:00:00", "20180101 23:59:59")), ("time=2019", ("20190101 00:00:00", "20191231 23:59:59")), ("x", None),
    ],
)
def test_closed_range(spark, raw, want):
    r = one(spark, r=times.closed_range(F.lit(raw)))["r"]
    assert (r and (r["start"], r["end"])) == want


def test_scores(spark):
    L = F.lit
    box = lambda *b: geo.box_f1(*[L(float(x)) for x in b], (0.0, 0.0, 10.0, 10.0))
    r = one(
        spark, same=box(0, 0, 10, 10), touch=box(10, 0, 20, 10), point=box(1, 1, 1, 1), half=box(0, 0, 5, 10), none=similarity.contains_score(L("abc"), "x"),
        eq=similarity.contains_score(L("Abc"), "aBC"), lex=similarity.lexical_score(L("red"), L("red widget")), cos=similarity.cosine(F.array(L(1.0), L(0.0)), F.array(L(1.0), L(1.0))),
        zero=similarity.cosine(F.array(L(0.0)), F.array(L(1.0))), t=times.time_f1(L("20200101 00:00:00"), L("20200103 00:00:00"), "20200102 00:00:00", "20200103 00:00:00"),
        box=geo.parse_box(L("bbox=-75,39,-74,40")), bad=geo.parse_box(L("1,2,3")),
    )
    assert (r["same"], r["touch"], r["point"], r["none"], r["eq"], r["zero"], r["bad"]) == (1.0, 0.0, 0.0, None, 1.0, None, None)
    assert r["half"] == pytest.approx(2 / 3) and r["lex"] == pytest.approx(0.7) and r["cos"] == pytest.approx(0.5**0.5) and r["t"] == pytest.approx(2 / 3)
    assert r["box"] == {"west": -75.0, "south": 39.0, "east": -74.0, "north": 40.0}


def test_jaro_winkler():
    assert similarity.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.jaro_winkler_of("axyz", "abcd") == pytest.approx(0.55) and similarity.jaro_winkler_of(None, "a") == 0


def test_urls(spark):
    L = F.lit
    r = one(
        spark, a=urls.format_from_mime(L("image/tiff; application=geotiff; profile=cloud-optimized")), b=urls.format_from_mime(L("text/html; x")), c=urls.resource_name(L("http://a.b/c/d%20e")),
        d=urls.resource_name(L("http://x/rest/services/MapServer")), e=urls.hrefs(L('<a href="a?x=1&amp;y">1</a><a href=\'#t\'><a HREF="javascript:z">')),
        f=urls.resolve(L("http://h/a/b?c"), L("d.html")), g=urls.resolve(L("http://h"), L("/d")), h=urls.resolve(L("https://h/a/"), L("//k/d")), i=urls.format_from_url(L("http://a/b.shp")),
    )
    assert r == {"a": "GeoTIFF", "b": "HTML", "c": "d%20e", "d": "ArcGIS REST", "e": ["a?x=1&y"], "f": "http://h/a/d.html", "g": "http://h/d", "h": "https://k/d", "i": "SHP"}


def test_labels(spark):
    body = F.lit("Title: My map\nAbstract: Long\ntext here\nPurpose: none\nTheme_Keyword: a\nTheme_Keyword: b\nWest_Bounding_Coordinate: -1,000.5")
    r = one(
        spark, t=text.label_value(body, "Title:"), all=text.label_value(body, "Theme_Keyword:", True), w=text.label_double(body, "West_Bounding_Coordinate:"),
        b=text.label_block(body, "abstract:", ["Purpose:"]), n=text.label_value(body, "Nothing:"),
    )
    assert r == {"t": "My map", "all": ["a", "b"], "w": -1000.5, "b": "Long text here", "n": None}


def test_html_to_text_grows_with_the_page_and_knows_its_tags(spark):
    import time

    def took(n):
        page = spark.createDataFrame([("<p>ab</p>" * n,)], "html string").repartition(1).cache()
        page.count()
        began = time.time()
        assert page.select(text.html_to_text(F.col("html")).alias("t")).first()["t"] == "\n".join(["ab"] * n)
        return time.time() - began

    took(10)
    assert took(8_000) < 2 and took(64_000) < 8
    pages = [("a</p >b", "ab"), ("a<br />b<HR>c<br\t/>d", "a\nb\nc\nd"), ("a<pre x>b</pre>c", "a\nb\nc"), ("1 > 0<b>x</b>", "1 > 0x"), ("<>a", "<>a"), ("", ""), (None, None), ("a<script>x</script >b</script>c", "a c")]
    got = spark.createDataFrame([(h,) for h, _ in pages], "html string").select("html", text.html_to_text(F.col("html")).alias("t")).collect()
    assert [r["t"] for r in got] == [t for _, t in pages]
