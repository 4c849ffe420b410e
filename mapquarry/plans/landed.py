"""Registered queries over landed catalog files and over the scalar functions, with their SQL.

The files are written from the star-schema tables, read back by the catalog readers and compared with
what the tables say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import times, urls, variants
from ..operators import answers, calls, evaluate, evidence, providers, sessions, tables
from ..operators import merges as MG
from ..operators import retrieve as R
from ..sources import ckan, fgdc, paged, sinks, stac
from .catalog import Catalog
from .discover import FLAGSHIP, discover
from .queries import decisions, found, query, six, topic_links
from .sql import F1, LINKS, SQL, TURNS, graph
from .sql import found as found_sql


def land(c: Catalog, rows: DataFrame, how: str) -> str:
    path = f"{tables.shared_root(c.spark)}/landed-{uuid.uuid4().hex}"
    getattr(rows.write, how)(path)
    return path


def of(values, key: Column) -> Column:
    """The value at ``key`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def of_sql(values, key: str) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"[{', '.join(quoted)}][({key} % {len(values)} + 1)::INT]"


# ---- CKAN ------------------------------------------------------------------------------------


def packages(c: Catalog) -> DataFrame:
    """One package an order, landed as JSON and read back."""
    o = c.table("orders")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    west, south = (F.col("o_custkey") * 37) % 340 - 170, (F.col("o_custkey") * 53) % 160 - 80
    # corners come swapped, as harvested boxes do
    extras = F.array(
        pair("bbox-east-long", west), pair("bbox-west-long", west + 5), pair("bbox-south-lat", south), pair("bbox-north-lat", F.when(F.col("o_orderkey") % 10 != 0, south + 3)),
        pair("temporal-extent-begin", F.date_format("o_orderdate", "yyyy-MM")), pair("temporal-extent-end", F.date_format("o_orderdate", "yyyy")),
    )
    li = c.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.concat(F.lit(" "), "l_returnflag", F.lit("  "), "l_linestatus").alias("format"), F.lit("http://x/").alias("url"),
    )).alias("resources"))
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("ds-"), "o_orderkey").alias("id"), F.concat_ws(" ", F.lit("order"), "o_orderkey").alias("title"), F.col("o_orderstatus").alias("notes"), F.col("o_orderpriority").alias("license_title"),
        F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.upper("o_orderstatus").alias("name"))).alias("tags"), extras.alias("extras"), "resources",
    )
    return ckan.read(c.spark, land(c, rows, "json"), lines=True)


@query
def ckan_pages(c: Catalog) -> DataFrame:
    """Datasets of a paged search of 40 a page, landed as a crawl leaves them, many answers a file, with an empty page behind the end."""
    o = c.table("orders")
    n = o.agg(F.count("*").alias("count"))
    start = F.expr("o_orderkey div 40 * 40").alias("start")
    package = F.struct(F.concat(F.lit("ds-"), "o_orderkey").alias("id"), F.concat_ws(" ", F.lit("order"), "o_orderkey").alias("title"))
    found = o.groupBy(start).agg(F.sort_array(F.collect_list(package)).alias("results"))
    answer = lambda start, rows: F.concat_ws("\t", start, F.to_json(F.struct(F.struct("count", rows.alias("results")).alias("result")))).alias("value")
    pages = found.join(F.broadcast(n)).select(answer(F.col("start"), F.col("results")))
    nothing = F.slice(F.array(package), 1, 0)
    behind = n.withColumn("o_orderkey", F.lit(0).cast("long")).select(answer(F.col("count"), nothing))
    path = f"{tables.shared_root(c.spark)}/pages-{uuid.uuid4().hex}"
    pages.unionByName(behind).write.text(f"{path}/answers")
    read = paged.crawled(paged.scan(c.spark, path))
    found_ = F.from_json("package", "id string, title string")
    return read.select("start", "place", found_["id"].alias("id"), found_["title"].alias("title"))


SQL["ckan_pages"] = """SELECT o_orderkey // 40 * 40 AS start, row_number() OVER (PARTITION BY o_orderkey // 40 ORDER BY 'ds-' || o_orderkey) - 1 AS place,
  'ds-' || o_orderkey AS id, 'order ' || o_orderkey AS title FROM orders"""


@query
def ckan_space_time(c: Catalog) -> DataFrame:
    env = ckan.envelope(packages(c))
    return env.select("id", "space.west", "space.south", "space.east", "space.north", F.col("time.begin").alias("begin"), F.col("time.end").alias("end"), "license.license_id")


SQL["ckan_space_time"] = """SELECT 'ds-' || o_orderkey AS id, CASE WHEN ok THEN w END AS west, CASE WHEN ok THEN s END AS south, CASE WHEN ok THEN w + 5 END AS east, CASE WHEN ok THEN s + 3 END AS north,
  strftime(o_orderdate, '%Y%m') || '01 00:00:00' AS "begin", strftime(o_orderdate, '%Y') || '1231 00:00:00' AS "end", 'lic:' || sha1(lower(o_orderpriority)) AS license_id
  FROM (SELECT *, ((o_custkey * 37) % 340 - 170)::DOUBLE AS w, ((o_custkey * 53) % 160 - 80)::DOUBLE AS s, o_orderkey % 10 <> 0 AS ok FROM orders)"""


@query
def ckan_has_keyword(c: Catalog) -> DataFrame:
    return ckan.tables(ckan.envelope(packages(c)))["has_keyword"]


SQL["ckan_has_keyword"] = "SELECT DISTINCT 'ds-' || o_orderkey AS dataset_id, 'kw:' || sha1(lower(k)) AS entity_id FROM (SELECT o_orderkey, unnest([o_orderpriority, o_orderstatus]) AS k FROM orders)"


@query
def ckan_has_format(c: Catalog) -> DataFrame:
    return ckan.tables(ckan.envelope(packages(c)))["has_format"]


SQL["ckan_has_format"] = "SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS resource_id, 'format:' || lower(l_returnflag || ' ' || l_linestatus) AS entity_id FROM lineitem"


@query
def ckan_topic_text(c: Catalog) -> DataFrame:
    return ckan.envelope(packages(c)).select("id", "topic_text", F.sha1("topic_text").alias("sha1"))


SQL["ckan_topic_text"] = """SELECT id, t AS topic_text, sha1(t) AS sha1 FROM (SELECT 'ds-' || o_orderkey AS id,
  'TITLE: order ' || o_orderkey || chr(10) || 'NOTES: ' || o_orderstatus || chr(10) || 'TAGS: ' || o_orderpriority || ', ' || upper(o_orderstatus) AS t FROM orders)"""


# ---- STAC ------------------------------------------------------------------------------------


def documents(c: Catalog) -> DataFrame:
    """One document a part: every third without a type but with an extent, every seventh an item."""
    k, lit = F.col("p_partkey"), F.lit
    d = lambda x: x.cast("double")
    box4 = F.array(d(k % 100), d(k % 50), d(k % 100 + 10), d(k % 50 + 5))
    box6 = F.array(d(k % 90), d(k % 60), lit(0.0), d(k % 90 + 15), d(k % 60 + 2), lit(9.0))
    link = lambda rel, href, kind: F.struct(lit(rel).alias("rel"), href.alias("href"), lit(kind).alias("type"))
    rows = c.table("part").select(
        F.when(k % 7 == 0, "Feature").when(k % 3 != 0, "Collection").alias("type"), F.concat(lit("p-"), k).alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"),
        F.array("p_brand", F.upper("p_brand"), "p_name").alias("keywords"), F.array(F.struct(F.col("p_type").alias("name"))).alias("providers"),
        F.struct(F.struct(F.array(box4, box6).alias("bbox")).alias("spatial"), F.struct(F.array(F.array(lit("2001-05-06T07:08:09Z"), F.when(k % 2 == 0, "2010"))).alias("interval")).alias("temporal")).alias("extent"),
        F.array(link("items", F.concat(lit("http://h/"), k, lit(".tif")), None), link("self", F.concat(lit("http://h/"), k), "application/geo+json"), link("next", lit("http://h/n"), None)).alias("links"),
        F.when(k % 4 == 0, k).alias("numberMatched"),
    )
    return stac.read(c.spark, land(c, rows, "json"), lines=True)


_COLLECTION = "(SELECT *, p_partkey AS k, 'p-' || p_partkey AS id FROM part WHERE p_partkey % 7 <> 0)"


@query
def stac_extent(c: Catalog) -> DataFrame:
    return stac.extent(stac.collections(documents(c)))


SQL["stac_extent"] = f"""SELECT id, w AS west, s AS south, e AS east, n AS north, 'POLYGON((' || w || ' ' || s || ',' || e || ' ' || s || ',' || e || ' ' || n || ',' || w || ' ' || n || ',' || w || ' ' || s || '))' AS wkt,
  '20010506 07:08:09' AS "begin", CASE WHEN k % 2 = 0 THEN '20101231 00:00:00' ELSE '99991231 00:00:00' END AS "end"
  FROM (SELECT id, k, least(k % 100, k % 90)::DOUBLE AS w, least(k % 50, k % 60)::DOUBLE AS s, greatest(k % 100 + 10, k % 90 + 15)::DOUBLE AS e, greatest(k % 50 + 5, k % 60 + 2)::DOUBLE AS n FROM {_COLLECTION})"""


@query
def stac_keywords(c: Catalog) -> DataFrame:
    return stac.keywords(stac.collections(documents(c)))


SQL["stac_keywords"] = f"""SELECT DISTINCT id AS dataset_id, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS canonical, x AS name FROM (SELECT id, unnest([p_brand, p_name]) AS x FROM {_COLLECTION})"""


@query
def stac_resources(c: Catalog) -> DataFrame:
    return stac.resources(stac.collections(documents(c)))


SQL["stac_resources"] = f"""SELECT id AS dataset_id, sha1(id || '|' || rel || '|' || href) AS resource_id, href AS url, CASE rel WHEN 'items' THEN 'GeoTIFF' ELSE 'GeoJSON' END AS format
  FROM (SELECT id, 'items' AS rel, 'http://h/' || k || '.tif' AS href FROM {_COLLECTION} UNION ALL SELECT id, 'self', 'http://h/' || k FROM {_COLLECTION})"""


@query
def stac_items_and_topics(c: Catalog) -> DataFrame:
    docs = stac.collections(documents(c))
    return stac.item_count(docs).join(stac.topic_text(docs), "id")


SQL["stac_items_and_topics"] = f"""SELECT id, CASE WHEN k % 4 = 0 THEN k END AS item_count, CASE WHEN length(t) >= 20 THEN substr(t, 1, 2200) END AS topic_text
  FROM (SELECT id, k, p_name || chr(10) || p_type || chr(10) || p_brand || ', ' || upper(p_brand) || ', ' || p_name || chr(10) || p_type AS t FROM {_COLLECTION})"""


@query
def stac_dispatch(c: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    rel, href = of(("data", "Collections", "http://www.opengis.net/def/rel/ogc/1.0/data", "next"), k), of(("collections", "/v1/collections?a=1", "http://x/collections/", "collections"), k)
    roots = c.table("part").select(
        F.concat(F.lit("http://h/r"), k, F.lit("/")).alias("url"), F.when(k % 5 == 0, "collection").otherwise("Catalog").alias("type"), F.array(F.struct(rel.alias("rel"), href.alias("href"))).alias("links"),
        F.when(k % 3 == 0, F.array(F.lit("core"))).alias("conformsTo"),
    )
    return stac.dispatch(roots)


SQL["stac_dispatch"] = """SELECT url, CASE WHEN one THEN 'collection' WHEN target IS NOT NULL THEN 'listing' ELSE 'crawl' END AS way, CASE WHEN NOT one THEN target END AS target FROM
  (SELECT url, k % 5 = 0 AS one, CASE k % 4 WHEN 0 THEN url || 'collections' WHEN 1 THEN 'http://h/v1/collections?a=1' WHEN 2 THEN 'http://x/collections/' ELSE CASE WHEN k % 3 = 0 THEN url || 'collections' END END AS target
  FROM (SELECT p_partkey AS k, 'http://h/r' || p_partkey || '/' AS url FROM part))"""


@query
def stac_listing(c: Catalog) -> DataFrame:
    """A listing a brand; every second collection could be fetched at its self link."""
    p = c.table("part").select("p_brand", F.concat(F.lit("p-"), "p_partkey").alias("id"), "p_name", "p_partkey")
    self_link = F.array(F.struct(F.lit("self").alias("rel"), F.concat(F.lit("./c/"), "p_partkey").alias("href")))
    docs = p.groupBy(F.concat(F.lit("http://h/"), F.translate("p_brand", "#", "-"), F.lit("/")).alias("url")).agg(F.collect_list(F.struct("id", F.col("p_name").alias("title"), self_link.alias("links"))).alias("collections"))
    fetched = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("http://h/"), F.translate("p_brand", "#", "-"), F.lit("/c/"), "p_partkey").alias("url"), "id", F.upper("p_name").alias("title"))
    return stac.listing(docs, fetched).select("base", "id", "title")


SQL["stac_listing"] = "SELECT 'http://h/' || replace(p_brand, '#', '-') || '/' AS base, 'p-' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS title FROM part"


@query
def stac_crawl(c: Catalog) -> DataFrame:
    """A tree of catalogs over the suppliers: each one links its double and the next, within six hops of the first."""
    k = F.col("s_suppkey")
    links = c.table("supplier").select(k.alias("k"), F.explode(F.array(2 * k, 2 * k + 1)).alias("to")).select(F.concat(F.lit("http://h/"), "k", F.lit("/")).alias("src"), F.concat(F.lit("http://h/"), "to").alias("dst"))
    return stac.crawl(links, c.spark.createDataFrame([("http://h/1",)], "url string"))


SQL["stac_crawl"] = """WITH RECURSIVE walk AS (SELECT 1::BIGINT AS k, 0 AS depth UNION ALL SELECT 2 * k + unnest([0, 1]), depth + 1 FROM walk WHERE depth < 6 AND k IN (SELECT s_suppkey FROM supplier))
  SELECT 'http://h/' || k AS url, depth FROM walk"""


# ---- FGDC ------------------------------------------------------------------------------------


def metadata_pages(c: Catalog) -> DataFrame:
    k = F.col("o_orderkey")
    line = lambda name, v: F.concat(F.lit(f"<dt><em>{name}:</em> "), v, F.lit("</dt>\n"))
    west, south = (F.col("o_custkey") * 37) % 340 - 170, (F.col("o_custkey") * 53) % 160 - 80
    html = F.concat(
        F.lit("<html><script>if (a > b) c();</script><dl>"), line("Title", F.concat(F.lit("Order&nbsp;"), k)), line("Originator", F.concat(F.lit("Clerk &amp; Sons, no. "), k % 10)), line("Abstract", F.col("o_orderpriority")), line("Purpose", F.lit("none")),
        line("Calendar_Date", F.date_format("o_orderdate", "yyyyMMdd")), F.when(k % 2 == 0, line("Calendar_Date", F.date_format("o_orderdate", "yyyy"))).otherwise(""),
        line("West_Bounding_Coordinate", west), line("East_Bounding_Coordinate", west + 4), line("South_Bounding_Coordinate", south), line("North_Bounding_Coordinate", F.when(k % 9 == 0, south - 1).otherwise(south + 2)),
        line("Theme_Keyword", F.col("o_orderstatus")), line("Place_Keyword", F.lit("Somewhere-Else")), line("Use_Constraints", F.col("o_orderpriority")), F.lit("</dl></html>"),
    )
    return c.table("orders").select(F.concat(F.lit("http://h/m?file="), k).alias("url"), html.alias("html"))


@query
def fgdc_metadata(c: Catalog) -> DataFrame:
    m = fgdc.metadata(metadata_pages(c))
    return m.select(
        "url", "title", F.array_join("originators", ",").alias("originators"), "notes", "space.west", "space.south", "space.east", "space.north", "begin", "end", F.array_join("keywords", ",").alias("keywords"), "license_id",
    )


SQL["fgdc_metadata"] = """SELECT 'http://h/m?file=' || k AS url, 'Order ' || k AS title, 'clerk & sons no ' || (k % 10) AS originators, o_orderpriority AS notes,
  CASE WHEN ok THEN w END AS west, CASE WHEN ok THEN s END AS south, CASE WHEN ok THEN w + 4 END AS east, CASE WHEN ok THEN s + 2 END AS north, strftime(o_orderdate, '%Y%m%d') || ' 00:00:00' AS "begin",
  CASE WHEN k % 2 = 0 THEN strftime(o_orderdate, '%Y') || '1231' ELSE strftime(o_orderdate, '%Y%m%d') END || ' 23:59:59' AS "end", lower(o_orderstatus) || ',somewhere-else' AS keywords, 'lic:' || sha1('|' || o_orderpriority) AS license_id
  FROM (SELECT *, o_orderkey AS k, ((o_custkey * 37) % 340 - 170)::DOUBLE AS w, ((o_custkey * 53) % 160 - 80)::DOUBLE AS s, o_orderkey % 9 <> 0 AS ok FROM orders)"""


@query
def fgdc_topic_text(c: Catalog) -> DataFrame:
    return fgdc.topic_text(fgdc.metadata(metadata_pages(c)))


SQL["fgdc_topic_text"] = "SELECT 'http://h/m?file=' || o_orderkey AS url, 'Order ' || o_orderkey || chr(10) || o_orderpriority || chr(10) || 'Keywords: ' || lower(o_orderstatus) || '; somewhere-else;' AS topic_text FROM orders"


@query
def fgdc_links(c: Catalog) -> DataFrame:
    k = F.col("o_orderkey")
    tails = of(("d/x.zip", "/get/download?id=1", "y/MapServer/", "search?q=1", "#top", "javascript:void(0)"), k)
    pages = c.table("orders").select(F.concat(F.lit("http://h/s/"), k).alias("url"), F.concat(F.lit('<a class=x href="'), tails, F.lit('">1</a><a HREF=\'FullMetadataDisplay.aspx?file=z&amp;n=1\'>2</a>')).alias("html"))
    return fgdc.links(pages)


SQL["fgdc_links"] = """SELECT 'http://h/s/' || o_orderkey AS url, 'http://h/s/FullMetadataDisplay.aspx?file=z&n=1' AS link, 'Metadata' AS name, 'metadata' AS type, 'HTML' AS format FROM orders
  UNION ALL SELECT 'http://h/s/' || o_orderkey, ['http://h/s/d/x.zip', 'http://h/get/download?id=1', 'http://h/s/y/MapServer'][o_orderkey % 6 + 1], ['x.zip', 'Download', 'MapServer'][o_orderkey % 6 + 1], ['link', 'download', 'service'][o_orderkey % 6 + 1],
  ['ZIP', 'UNKNOWN', 'MapServer'][o_orderkey % 6 + 1] FROM orders WHERE o_orderkey % 6 < 3"""


@query
def fgdc_listing(c: Catalog) -> DataFrame:
    """Providers list the datasets of their nation's customers; of two that list one the first keeps it."""
    cust = c.table("customer").select(F.col("c_nationkey"), F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1)).alias("d"))
    pages = cust.groupBy("c_nationkey").agg(F.array_join(F.transform(F.collect_list("d"), lambda d: F.concat(F.lit("<a href='DataSummary.aspx?dataset="), d, F.lit("'>"))), " ").alias("html"))
    return fgdc.listing(pages.select(F.concat(F.lit("n-"), "c_nationkey").alias("provider"), F.col("c_nationkey").alias("ordinal"), "html"))


SQL["fgdc_listing"] = "SELECT d::VARCHAR AS dataset, 'n-' || min(c_nationkey) AS provider FROM (SELECT c_nationkey, unnest([c_custkey, c_custkey + 1]) AS d FROM customer) GROUP BY d"


# ---- scalars ---------------------------------------------------------------------------------

MIMES = ("image/tiff; application=geotiff; profile=cloud-optimized", "application/x-hdf5", "application/geo+json", "text/html", "Image/JPEG", "application/x-netcdf", None)


@query
def format_from_mime(c: Catalog) -> DataFrame:
    return c.table("pages").select("page_id", urls.format_from_mime(of(MIMES, F.col("page_id"))).alias("format"))


SQL["format_from_mime"] = f"SELECT page_id, {of_sql(('GeoTIFF', 'HDF', 'GeoJSON', 'HTML', 'JPEG', 'NetCDF', None), 'page_id')} AS format FROM pages"

TAILS = ("/a/FullMetadataDisplay.aspx?x", "/Download/1", "/x.csv", "/MapServer/rest/1", "/layer-7", "/q/wms?y", "")


@query
def resource_name(c: Catalog) -> DataFrame:
    url = F.concat(F.lit("http://host.org"), of(TAILS, F.col("page_id")))
    return c.table("pages").select("page_id", urls.resource_name(url).alias("name"), urls.resource_type(url).alias("type"))


SQL["resource_name"] = f"SELECT page_id, {of_sql(('Metadata', 'Download', 'Spreadsheet', 'ArcGIS REST', 'layer-7', 'WMS', 'Resource'), 'page_id')} AS name, {of_sql(('metadata', 'download', 'link', 'service', 'link', 'link', 'link'), 'page_id')} AS type FROM pages"


@query
def temporal_stac(c: Catalog) -> DataFrame:
    d = F.col("o_orderdate")
    forms = (F.date_format(d, "yyyy"), F.date_format(d, "yyyyMM"), F.date_format(d, "yyyyMMdd"), F.date_format(d, "yyyy-MM"), F.concat(F.date_format(d, "yyyy"), F.lit("77")), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T01:02:03Z")))
    raw = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return c.table("orders").select(F.col("o_orderkey").alias("id"), times.stac(raw, True).alias("begin"), times.stac(raw, False).alias("end"))


SQL["temporal_stac"] = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN y || '0101 00:00:00' WHEN 1 THEN y || m || '01 00:00:00' WHEN 2 THEN y || m || dd || ' 00:00:00' WHEN 3 THEN '00010101 00:00:00' WHEN 4 THEN y || '1201 00:00:00' ELSE y || m || dd || ' 01:02:03' END AS "begin",
  CASE o_orderkey % 6 WHEN 0 THEN y || '1231 00:00:00' WHEN 1 THEN strftime(last_day(o_orderdate::DATE), '%Y%m%d') || ' 00:00:00' WHEN 2 THEN y || m || dd || ' 00:00:00' WHEN 3 THEN '99991231 00:00:00' WHEN 4 THEN y || '1231 00:00:00' ELSE y || m || dd || ' 01:02:03' END AS "end"
  FROM (SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%d') AS dd FROM orders)"""


@query
def temporal_fgdc(c: Catalog) -> DataFrame:
    d = F.col("o_orderdate")
    forms = (F.date_format(d, "yyyy"), F.concat(F.date_format(d, "yyyyMMdd"), F.lit(" (approx)")), F.date_format(d, "yyyy/MM/dd"), F.lit("unknown"))
    raw = F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))
    calendar = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("20000101 00:00:00"), F.lit("20010101 23:59:59"))).otherwise(F.array().cast("array<string>"))
    begin, end = times.fgdc_range(calendar, times.fgdc(raw, True), times.fgdc(raw, False), F.lit("19990101 00:00:00"))
    return c.table("orders").select(F.col("o_orderkey").alias("id"), begin.alias("begin"), F.greatest(begin, end).alias("end"))


SQL["temporal_fgdc"] = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '20000101 00:00:00' ELSE coalesce(b, '19990101 00:00:00') END AS "begin", CASE WHEN o_orderkey % 3 = 0 THEN '20010101 23:59:59' ELSE coalesce(e, b, '19990101 00:00:00') END AS "end" FROM
  (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN y || '0101 00:00:00' WHEN 3 THEN NULL ELSE y || md || ' 00:00:00' END AS b, CASE o_orderkey % 4 WHEN 0 THEN y || '1231 23:59:59' WHEN 3 THEN NULL ELSE y || md || ' 23:59:59' END AS e
  FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m%d') AS md FROM orders))"""


@query
def closed_range(c: Catalog) -> DataFrame:
    d = F.col("o_orderdate")
    y, day = F.date_format(d, "yyyy"), F.date_format(d, "yyyy-MM-dd")
    forms = (F.concat(F.lit("time="), y), F.concat(y, F.lit("-1990")), F.concat(day, F.lit(" to 1990/02/03")), F.date_format(d, "yyyyMMdd"), F.lit("some day"))
    r = times.closed_range(F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int")))
    return c.table("orders").select(F.col("o_orderkey").alias("id"), r["start"].alias("start"), r["end"].alias("end"))


SQL["closed_range"] = """SELECT id, a || ' 00:00:00' AS start, b || ' 23:59:59' AS "end" FROM (SELECT o_orderkey AS id,
  CASE o_orderkey % 5 WHEN 0 THEN y || '0101' WHEN 1 THEN least(y, '1990') || '0101' WHEN 2 THEN least(d, '19900203') WHEN 3 THEN d END AS a, CASE o_orderkey % 5 WHEN 0 THEN y || '1231' WHEN 1 THEN greatest(y, '1990') || '1231' WHEN 2 THEN greatest(d, '19900203') WHEN 3 THEN d END AS b
  FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y%m%d') AS d FROM orders))"""


@query
def canonical_org(c: Catalog) -> DataFrame:
    raw = F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" Dept._of/"), "s_name", F.lit(" & Co-op!")))
    return c.table("supplier").select("s_suppkey", X.canonical_org(raw).alias("loose"), X.canonical_org(raw, True).alias("strict"))


SQL["canonical_org"] = """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'dept _of/' || n || ' & co-op' END AS loose, CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE 'dept of ' || regexp_replace(n, '[^a-z0-9& -]+', ' ', 'g') || ' & co-op' END AS strict
  FROM (SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9&_/ -]+', ' ', 'g') AS n FROM supplier)"""


@query
def answer_grammar(c: Catalog) -> DataFrame:
    """Values of a list, picks of a selection, the JSON object of a reply, and the first address of a header."""
    k = F.col("page_id").cast("string")
    values = X.split_values(F.concat(k, F.lit(", a1; b2 & c3 and "), k))
    picks = X.selections(F.concat(F.lit("Topic:"), F.col("page_id") % 100, F.lit(",3,x;Format:continue")))
    reply = X.json_slice(F.concat(F.lit('Sure: {"id": {"n": '), k, F.lit("}} as asked")))
    return c.table("pages").select(
        "page_id", F.array_join(values, "|").alias("vals"), F.array_join(picks[0]["indices"], "|").alias("picks"), F.size(picks[1]["indices"]).alias("others"), reply.alias("reply"),
        X.first_ip(F.concat(F.lit(" 10.0.0.1 , "), k)).alias("ip"), X.landing_slug(F.concat(F.lit("--A b/"), k, F.lit("!"))).alias("slug"), X.has_cyrillic(of(("дом", "house"), F.col("page_id"))).alias("cyrillic"),
        X.display_label(of((" ", "name"), F.col("page_id")), F.lit(None).cast("string"), k).alias("label"), X.clean(F.concat(F.lit("  x​ \t"), k)).alias("clean"),
    )


SQL["answer_grammar"] = """SELECT page_id, k || '|a1|b2|c3|' || k AS vals, (page_id % 100) || '|3' AS picks, 0 AS others, '{"id": {"n": ' || k || '}}' AS reply, '10.0.0.1' AS ip, 'a-b-' || k AS slug,
  page_id % 2 = 0 AS cyrillic, CASE WHEN page_id % 2 = 0 THEN k ELSE 'name' END AS label, 'x ' || k AS clean FROM (SELECT page_id, page_id::VARCHAR AS k FROM pages)"""


@query
def conversation_titles(c: Catalog) -> DataFrame:
    none = F.lit(None).cast("string")
    intent = lambda text: F.struct(text.alias("topic"), of(("csv", " "), F.col("conv_id")).alias("format"), none.alias("license"), none.alias("organization"), F.lit("pasda").alias("source"), none.alias("space"), F.lit("2020").alias("time"))
    first = c.table("conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", sessions.title(intent(F.col("text"))).alias("title"))


SQL["conversation_titles"] = """SELECT conv_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS title FROM
  (SELECT conv_id, CASE WHEN trim(x) <> '' THEN trim(x) || ' | ' ELSE '' END || CASE WHEN conv_id % 2 = 0 THEN 'csv | ' ELSE '' END || 'pasda | 2020' AS t FROM (SELECT conv_id, arg_min(text, turn) AS x FROM conversations WHERE role = 'user' GROUP BY 1))"""


# ---- filters, keyed writes, lookups --------------------------------------------------------------


@query
def confidence_gate(c: Catalog) -> DataFrame:
    scored = c.topic.join(found(c.topic, "red"), "id", "left")
    return scored.select("id", R.confident(F.col("score"), 0.5).alias("next"))


SQL["confidence_gate"] = graph(f"SELECT id, CASE WHEN score >= 0.5 THEN 'proceed' ELSE 'ask' END AS next FROM topic LEFT JOIN {found_sql('topic', 'red')} f USING (id)")


@query
def display_cut(c: Catalog) -> DataFrame:
    """Scores too small to show are left out."""
    from ..functions import geo

    from .queries import BOX

    f1 = geo.box_f1(*(F.col(x) for x in ("west", "south", "east", "north")), BOX)
    return c.space.select("dataset_id", six(f1).alias("score")).where("score > 0.0001")


SQL["display_cut"] = graph(f"SELECT dataset_id, round({F1}, 6) AS score FROM space WHERE round({F1}, 6) > 0.0001")


@query
def active_rows(c: Catalog) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") != "F", "DEPRECATED")
    rows = c.table("orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    return tables.active(rows, "1995-06-01").select("id", "created_at")


SQL["active_rows"] = "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderdate >= TIMESTAMP '1995-06-01'"


def conversations(c: Catalog) -> DataFrame:
    k = F.col("conv_id")
    return c.table("conversations").groupBy("conv_id").agg(F.count("*").alias("turns")).select(
        "conv_id", (k % 7 == 0).alias("deleted"), (k % 3 == 0).alias("shareable"), F.concat(F.lit("u"), k % 5).alias("api_key"), (k * 37 % 11).alias("created_at")
    )


@query
def visible_conversations(c: Catalog) -> DataFrame:
    return sessions.visible(conversations(c), "u1").select("conv_id")


SQL["visible_conversations"] = "SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 7 <> 0 AND (conv_id % 3 = 0 OR conv_id % 5 = 1)"


@query
def listed_conversations(c: Catalog) -> DataFrame:
    return sessions.listed(conversations(c)).select("conv_id", "created_at")


SQL["listed_conversations"] = "SELECT DISTINCT conv_id, conv_id * 37 % 11 AS created_at FROM conversations ORDER BY created_at DESC, conv_id"


@query
def insert_missing(c: Catalog) -> DataFrame:
    """Turns of a conversation are inserted once: an index that is there stays."""
    t = c.table("conversations").select("conv_id", "turn", "role")
    return tables.insert_missing(t.where("turn % 2 = 0"), t.withColumn("role", F.upper("role")), ["conv_id", "turn"])


SQL["insert_missing"] = "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE upper(role) END AS role FROM conversations"


@query
def guarded_update(c: Catalog) -> DataFrame:
    """Feedback changes the status of the orders it names, finished ones excepted."""
    rows = c.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return tables.changed(rows, rows.where("id % 4 = 0").select("id", F.lit("X").alias("status")), "id", "status", F.col("status") != "F")


SQL["guarded_update"] = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'F' THEN 'X' ELSE o_orderstatus END AS status FROM orders"


@query
def label_lookup(c: Catalog) -> DataFrame:
    """First label of every id, in the order of the kinds; a number may name an organization or a dataset."""
    nodes = None
    for at, (label, df) in enumerate({"Dataset": c.dataset, "Topic": c.topic, "Keyword": c.keyword, "Format": c.format, "License": c.license, "Organization": c.organization}.items()):
        rows = df.select(F.col("id").cast("string").alias("id"), F.lit(label).alias("label"), F.lit(at).alias("at"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
    return nodes.groupBy("id").agg(F.min_by("label", "at").alias("label"))


SQL["label_lookup"] = graph("""SELECT id, arg_min(label, at_) AS label FROM (SELECT id::VARCHAR AS id, 'Dataset' AS label, 0 AS at_ FROM dataset UNION ALL SELECT id, 'Topic', 1 FROM topic UNION ALL SELECT id, 'Keyword', 2 FROM keyword
  UNION ALL SELECT id, 'Format', 3 FROM format_ UNION ALL SELECT id, 'License', 4 FROM license UNION ALL SELECT id, 'Organization', 5 FROM organization) GROUP BY 1""")


@query
def search_by_label(c: Catalog) -> DataFrame:
    """Each kind of node is searched in its own property; datasets in the title, else the notes."""
    out = None
    for label, df, q in (("Topic", c.topic, "red"), ("Keyword", c.keyword, "#1"), ("Format", c.format, "r-"), ("License", c.license.withColumnRenamed("name", "title"), "low"), ("Organization", c.organization, "0001"), ("Dataset", c.dataset.withColumn("title", F.when(F.col("id") % 2 == 0, F.col("title"))), "urgent")):
        rows = df.where(F.lower(R.searched(df, label)).contains(q)).select(F.lit(label).alias("label"), F.col("id").cast("string").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


SQL["search_by_label"] = graph("""SELECT 'Topic' AS label, id FROM topic WHERE contains(lower(name), 'red') UNION ALL SELECT 'Keyword', id FROM keyword WHERE contains(lower(name), '#1') UNION ALL SELECT 'Format', id FROM format_ WHERE contains(name, 'r-')
  UNION ALL SELECT 'License', id FROM license WHERE contains(lower(name), 'low') UNION ALL SELECT 'Organization', id FROM organization WHERE contains(lower(name), '0001') UNION ALL SELECT 'Dataset', id::VARCHAR FROM dataset WHERE id % 2 = 0 AND contains(lower(title), 'urgent')""")


@query
def vector_candidates(c: Catalog) -> DataFrame:
    """Index scores (1 + cosine) / 2 over a threshold, 25 at most."""
    nodes = c.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = nodes.where("id = 0").select("embedding").limit(1).collect()
    return R.vector_candidates(nodes, asked[0][0], 25, 0.55) if asked else nodes.select("id", F.lit(0.0).alias("score")).limit(0)


SQL["vector_candidates"] = """SELECT id, score FROM (SELECT vec_id AS id, round((1 + list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))) / 2, 6) AS score FROM embeddings)
  WHERE score > 0.55 ORDER BY score DESC, id LIMIT 25"""


@query
def raw_dimension_scores(c: Catalog) -> DataFrame:
    """Contributions over their weight, 1 at most."""
    return R.raw_scores(R.contribution(topic_links(c), "Topic", 0.3), {"Topic": 0.3}).select("dataset_id", six("raw").alias("raw"))


SQL["raw_dimension_scores"] = graph(f"SELECT dataset_id, round(least(1.0::DOUBLE, max(score)), 6) AS raw FROM {LINKS} GROUP BY 1")


# ---- calls, answers, evidence ----------------------------------------------------------------


def _embed(texts: list[str]) -> list[list[float]]:
    """Numbers of a text's letters; refuses batches with a text of low priority."""
    if any("LOW" in t for t in texts):
        raise ValueError("refused")
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query
def embedding_states(c: Catalog) -> DataFrame:
    """One round over the datasets: every seventh has a blank text, every eleventh was left in progress, every fifth is done."""
    k = F.col("id")
    text = F.when(k % 7 == 0, " ").otherwise(F.col("title"))
    known = F.when(k % 5 == 0, F.array(F.lit(1.0)))
    status = F.when(k % 5 == 0, "DONE").when(k % 11 == 0, "IN_PROGRESS")
    none = F.lit(None).cast("string")
    nodes = c.dataset.select("id", text.alias("text"), known.alias("embedding"), status.alias("embedding_status"), none.alias("embedding_at"), none.alias("embedding_error"))
    got = calls.embedded(nodes, _embed, F.lit("now"), attempts=2, pause=lambda s: None)
    return got.select("id", "embedding_status", "embedding_at", F.col("embedding")[0].alias("first"), F.col("embedding_error").isNotNull().alias("failed"))


SQL["embedding_states"] = graph("""SELECT id, s AS embedding_status, CASE WHEN id % 5 <> 0 THEN 'now' END AS embedding_at, CASE WHEN id % 5 = 0 THEN 1.0 WHEN s = 'DONE' THEN length(title) END::DOUBLE AS first, s = 'FAILED' AS failed
  FROM (SELECT *, CASE WHEN id % 5 = 0 THEN 'DONE' WHEN id % 7 = 0 THEN 'SKIPPED' WHEN contains(title, 'LOW') THEN 'FAILED' ELSE 'DONE' END AS s FROM dataset)""")

_ANSWERS = ("continue", "2, 1 and 2", "Hitl selection no. 3", "COLD BOLT", "the cold gear please", "Format = GeoJSON ", "nothing of these", "7 or 12")


@query
def hitl_answers(c: Catalog) -> DataFrame:
    """The first five topics of a colour offered to each turn, and what its answer makes of them."""
    offered = c.topic.where(F.col("name").startswith("cold")).orderBy("id").limit(5).agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("candidates"))
    asked = c.table("conversations").select("conv_id", "turn", of(_ANSWERS, F.col("turn") + F.col("conv_id")).alias("answer"), (F.col("turn") / 10.0).alias("confidence"))
    got = answers.resolved(asked.join(F.broadcast(offered)))  # one row
    return got.select("conv_id", "turn", F.array_join("ids", ",").alias("ids"), "value", "needs_clarification", six("new_confidence").alias("new_confidence"))


SQL["hitl_answers"] = graph(f"""SELECT conv_id, turn, CASE k WHEN 0 THEN array_to_string(ids, ',') WHEN 1 THEN ids[2] || ',' || ids[1] WHEN 2 THEN ids[3] WHEN 3 THEN list_filter(ids, lambda x: x = 'cold bolt')[1] WHEN 4 THEN list_filter(ids, lambda x: contains('the cold gear please', x))[1] END AS ids,
  CASE k WHEN 0 THEN ids[1] WHEN 1 THEN ids[2] WHEN 2 THEN ids[3] WHEN 3 THEN coalesce(list_filter(ids, lambda x: x = 'cold bolt')[1], 'COLD BOLT') WHEN 4 THEN coalesce(list_filter(ids, lambda x: contains('the cold gear please', x))[1], 'the cold gear please') WHEN 5 THEN 'GeoJSON' ELSE a END AS value,
  k >= 6 OR k = 3 AND NOT list_contains(ids, 'cold bolt') OR k = 4 AND NOT list_contains(ids, 'cold gear') AS needs_clarification,
  round(CASE WHEN k = 0 THEN 0.8 WHEN k IN (1, 2) OR k = 3 AND list_contains(ids, 'cold bolt') OR k = 4 AND list_contains(ids, 'cold gear') THEN 1.0 WHEN k = 5 THEN greatest(turn / 10.0, 0.95) ELSE turn / 10.0 END::DOUBLE, 6) AS new_confidence
  FROM (SELECT conv_id, turn, (turn + conv_id) % 8 AS k, {of_sql(_ANSWERS, "(turn + conv_id)")} AS a FROM conversations), (SELECT list_sort(list(id)) AS ids FROM (SELECT id FROM topic WHERE starts_with(name, 'cold') ORDER BY id LIMIT 5))""")


@query
def exact_intent_match_by_level(c: Catalog) -> DataFrame:
    """Orders as queries with three parsed fields, some read wrongly: the share of each priority with all of them right."""
    o = c.table("orders")
    read = lambda name, got, want: F.struct(F.lit(name).alias("dim"), got.cast("string").alias("got"), want.cast("string").alias("want"))
    dims = F.explode(F.array(
        read("status", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")), F.col("o_orderstatus")),
        read("priority", F.substring("o_orderpriority", 1, 1), F.when(F.col("o_custkey") % 4 == 0, "1").otherwise(F.substring("o_orderpriority", 1, 1))),
        read("unknown", F.lit(None), F.lit(None)),
    )).alias("d")
    results = o.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("level"), dims).select("query_id", "level", "d.*")
    return evaluate.exact_intent_match(results, "level").select("level", six("eimr").alias("eimr"))


SQL["exact_intent_match_by_level"] = """SELECT o_orderpriority AS level, round(avg((o_orderkey % 9 <> 0 AND (o_custkey % 4 <> 0 OR substr(o_orderpriority, 1, 1) = '1'))::INT::DOUBLE), 6) AS eimr FROM orders GROUP BY 1"""


@query
def evidence_context(c: Catalog) -> DataFrame:
    """Context lines of the flagship request's datasets, by score and id."""
    ranked = discover(c, FLAGSHIP).join(c.dataset.withColumnRenamed("id", "dataset_id"), "dataset_id")
    numbered = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "dataset_id")))  # the request's best rows
    return evidence.context(numbered)


SQL["evidence_context"] = SQL["discover_flagship"].replace("SELECT dataset_id, score, rank FROM (", """SELECT string_agg(r || '. ' || title || ' | ' || notes, chr(10) ORDER BY r) AS context FROM (SELECT title, notes, row_number() OVER (ORDER BY score DESC, dataset_id) AS r FROM (SELECT dataset_id, score, rank FROM (""", 1) + ") JOIN dataset ON id = dataset_id) WHERE r <= 20"


@query
def embedding_texts(c: Catalog) -> DataFrame:
    """Texts that datasets are embedded by: title, notes and keywords, blank ones left out, 6000 characters at most; vectors never leave."""
    kw = c.has_keyword.groupBy(F.col("dataset_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("entity_id")), " ").alias("keywords"))
    d = c.dataset.withColumns({"embedding": F.array(F.lit(0.5)), "notes": F.when(F.col("id") % 3 == 0, "  ").otherwise(F.col("notes"))}).join(kw, "id", "left")
    text = X.embedding_text(F.col("title"), F.col("notes"), F.repeat("keywords", 200))
    return evidence.without_vectors(d.withColumn("text", text)).select("id", F.length("text").alias("n"), F.sha1("text").alias("sha1"))


SQL["embedding_texts"] = graph("""SELECT id, length(t) AS n, sha1(t) AS sha1 FROM (SELECT id, substr(concat_ws(chr(10), title, CASE WHEN id % 3 <> 0 THEN notes END, repeat(keywords, 200)), 1, 6000) AS t
  FROM dataset LEFT JOIN (SELECT dataset_id AS id, array_to_string(list_sort(list(DISTINCT entity_id)), ' ') AS keywords FROM has_keyword GROUP BY 1) USING (id))""")


@query
def bundle_choice(c: Catalog) -> DataFrame:
    """A model's choice of datasets by price, with wrong ids and ranks in it: ten known ones by its rank, with three reasons at most."""
    o = c.table("orders")
    ranked = o.select(F.col("o_orderkey").alias("dataset_id"))
    made = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")) - 3)
    wrong = F.when(F.col("rank") % 5 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))
    choices = made.select(wrong.alias("dataset_id"), "rank", F.split(F.lit("a,b,c,d"), ",").alias("reasons"))
    return providers.select_top(ranked, choices, 10).select("dataset_id", F.col("rank").cast("long").alias("rank"), F.array_join("reasons", ",").alias("reasons"))


SQL["bundle_choice"] = """SELECT o_orderkey AS dataset_id, rank, 'a,b,c' AS reasons FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 3 AS rank FROM orders QUALIFY rank <= 37) WHERE rank > 0 AND rank % 5 <> 0 ORDER BY rank LIMIT 10"""


@query
def keyword_lists(c: Catalog) -> DataFrame:
    """Keyword names of each dataset as a list, and whether any holds the text."""
    got = c.has_keyword.groupBy("dataset_id").agg(F.sort_array(F.collect_set("entity_id")).alias("names"))
    return got.select("dataset_id", F.array_join("names", ",").alias("names"), F.exists("names", lambda n: F.lower(n).contains("#11")).alias("any"))


SQL["keyword_lists"] = graph("""SELECT dataset_id, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS names, bool_or(contains(lower(entity_id), '#11')) AS "any" FROM has_keyword GROUP BY 1""")


@query
def merge_log(c: Catalog) -> DataFrame:
    """The log of the ordered merges as a CSV with a header, with quotes and commas in its reasons, read back."""
    told = MG.ordered(decisions(c))[0].where("outcome = 'merged'")
    path = f"{tables.shared_root(c.spark)}/log-{uuid.uuid4().hex}"
    sinks.write_merge_log(told.select("seq", "source", "target", F.concat(F.lit('the "same", '), "source").alias("reason")), path)
    return c.spark.read.csv(path, header=True, quote='"', escape='"', schema="seq long, source string, target string, reason string")


SQL["merge_log"] = graph("""SELECT seq, source, target, 'the "same", ' || source AS reason FROM taken WHERE k > 0 AND source <> target""", TURNS, recursive=True)

SQL["topic_decision_provider"] = graph("SELECT canonical, freq, 'create' AS decision, NULL::VARCHAR AS decision_error FROM (SELECT canonical, count(DISTINCT dataset_id) AS freq FROM pending GROUP BY 1) WHERE freq >= 5")


# ---- two pages, objects of any shape ---------------------------------------------------------


def _summaries(c: Catalog) -> DataFrame:
    """A summary page an order: some blank, some without a link, some whose metadata page is missing or empty."""
    k = F.col("o_orderkey")
    html = F.when(k % 13 == 0, " ").when(k % 17 == 0, "<p>no such link</p>").otherwise(F.concat(F.lit('<a href="FullMetadataDisplay.aspx?file='), F.when(k % 19 == 0, -k).otherwise(k).cast("string"), F.lit('&x=1">m</a>')))
    return c.table("orders").select(k.alias("dataset"), F.concat(F.lit("Provider "), k % 3).alias("provider"), F.concat(F.lit("http://h/uci/DataSummary.aspx?dataset="), k).alias("url"), html.alias("html"))


def _metadata_pages(c: Catalog) -> DataFrame:
    k = F.col("o_orderkey")
    title = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("<h2 class=t> Order\n"), k.cast("string"), F.lit(" </h2>")))
    by = F.when(k % 4 != 0, F.concat(F.lit("<dt>Originator: Clerk "), (k % 10).cast("string"), F.lit("</dt>"))).otherwise("")
    html = F.when(k % 23 == 0, "").otherwise(F.concat(title, by, F.lit("<dt>Theme_Keyword: "), "o_orderstatus", F.lit("</dt>")))
    return c.table("orders").select(F.concat(F.lit("http://h/uci/FullMetadataDisplay.aspx?file="), k.cast("string")).alias("url"), html.alias("html"))


@query
def fgdc_mapped(c: Catalog) -> DataFrame:
    """Datasets of summary pages that lead to their metadata."""
    got, _ = fgdc.mapped(_summaries(c), _metadata_pages(c))
    return got.select("dataset", "title", F.array_join("originators", ",").alias("originators"), F.array_join("keywords", ",").alias("keywords"), "metadata_url")


_FAULT = "CASE WHEN k % 13 = 0 THEN 'summary is empty' WHEN k % 17 = 0 THEN 'no link to metadata' WHEN k % 19 = 0 THEN 'metadata page is missing' WHEN k % 23 = 0 THEN 'metadata page is empty' END"
SQL["fgdc_mapped"] = f"""SELECT k AS dataset, CASE WHEN k % 5 = 0 THEN 'dataset ' || k ELSE 'Order ' || k END AS title, CASE WHEN k % 4 = 0 THEN 'provider ' || (k % 3) ELSE 'clerk ' || (k % 10) END AS originators,
  lower(o_orderstatus) AS keywords, 'http://h/uci/FullMetadataDisplay.aspx?file=' || k AS metadata_url FROM (SELECT *, o_orderkey AS k FROM orders) WHERE {_FAULT} IS NULL"""


@query
def fgdc_rejects(c: Catalog) -> DataFrame:
    """Summary pages that give no dataset, with the cause."""
    return fgdc.mapped(_summaries(c), _metadata_pages(c))[1].select("dataset", "cause", F.col("metadata_url").isNotNull().alias("linked"))


SQL["fgdc_rejects"] = f"SELECT k AS dataset, cause, k % 13 <> 0 AND k % 17 <> 0 AS linked FROM (SELECT k, {_FAULT} AS cause FROM (SELECT o_orderkey AS k FROM orders)) WHERE cause IS NOT NULL"


@query
def replies_parsed(c: Catalog) -> DataFrame:
    """Replies with prose around them, numbers as texts, objects within objects, a reason alone or none, cut ones and none at all."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit('Sure: {"id": '), n, F.lit(', "rank": 2, "reasons": ["a", 1, null, {"b": true}]} as asked')))
        .when(k % 6 == 1, F.concat(F.lit('{"choice": {"id": "'), n, F.lit('"}, "rank": "7", "reasons": "only this"}'))).when(k % 6 == 2, F.concat(F.lit('{"id": '), n, F.lit(', "rank"')))
        .when(k % 6 == 3, F.concat(F.lit('{"id": '), n, F.lit(', "rank": "high", "reasons": []}'))).when(k % 6 == 4, "nothing suits")
    )
    v = F.col("v")
    rows = c.table("orders").select(k.alias("order"), variants.reply(raw).alias("v"))
    return rows.select("order", variants.first(v, ["$.id", "$.choice.id"], "bigint").alias("id"), variants.field(v, "$.rank", "bigint").alias("rank"), F.array_join(variants.listed(v, "$.reasons"), "|").alias("reasons"))


SQL["replies_parsed"] = """SELECT o_orderkey AS "order", CASE WHEN k IN (0, 1, 3) THEN o_orderkey END AS id, CASE k WHEN 0 THEN 2 WHEN 1 THEN 7 END::BIGINT AS rank,
  CASE k WHEN 0 THEN 'a|1|{"b":true}' WHEN 1 THEN 'only this' ELSE '' END AS reasons FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)"""


@query
def extras_any_shape(c: Catalog) -> DataFrame:
    """Extras as a list with a repeated key, as an object, with nested values, as a text and missing, all read as one map."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit('[{"key": "a", "value": "old"}, {"key": "b", "value": {"n": [1, 2]}}, {"key": "a", "value": '), n, F.lit('}, {"key": "c"}, {"value": 1}]')))
        .when(k % 5 == 1, F.concat(F.lit('{"a": "'), n, F.lit('", "b": null, "c": [true]}'))).when(k % 5 == 2, '"text"').when(k % 5 == 3, '[{"key": "a"')
    )
    m = variants.entries(F.try_parse_json(raw))
    return c.table("orders").select(k.alias("order"), m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"), F.size(m).alias("n"))


SQL["extras_any_shape"] = """SELECT o_orderkey AS "order", CASE WHEN k < 2 THEN o_orderkey::VARCHAR END AS a, CASE k WHEN 0 THEN '{"n":[1,2]}' END AS b, CASE k WHEN 1 THEN '[true]' END AS c, CASE WHEN k < 2 THEN 2 ELSE 0 END AS n FROM (SELECT o_orderkey, o_orderkey % 5 AS k FROM orders)"""
