"""FGDC metadata pages (HTML) -> envelope rows, by column expressions over whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as X
from ..functions import times
from ..functions import urls
from ..operators.tables import free


def read(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of landed pages, keyed by the hash of their URL."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html")).withColumn("key", F.sha1("url"))


def listing(pages: DataFrame) -> DataFrame:
    """Datasets named by listing pages ``(provider, ordinal, html)``; the first provider that lists one keeps it."""
    ids = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("DataSummary\\.aspx\\?dataset=([0-9]+)"), F.lit(1)))).alias("dataset")
    return pages.select("provider", "ordinal", ids).groupBy("dataset").agg(F.min_by("provider", "ordinal").alias("provider"))


def metadata(pages: DataFrame, *keep: str) -> DataFrame:
    """Title, originators, abstract, box, closed time, keywords and license of ``pages(url, html)``; columns of ``keep`` stay beside them."""
    # values that are used more than once are columns of a step before, so that a page is searched once for each label
    name = lambda n: free(f"_{n}", pages)
    body = name("body")
    one = lambda label: X.label_value(F.col(body), f"{label}:")
    many = lambda label: X.label_value(F.col(body), f"{label}:", True)
    raw = {
        "title": one("Title"), "by": many("Originator"), "notes": X.label_block(F.col(body), "Abstract:", ["Purpose:", "Supplemental_Information:", "Time_Period_of_Content:"]),
        **{side[0].lower(): X.label_double(F.col(body), f"{side}_Bounding_Coordinate:") for side in ("West", "South", "East", "North")},
        "days": many("Calendar_Date"), "from": one("Beginning_Date"), "to": one("Ending_Date"), "out": one("Publication_Date"),
        "words": F.concat(*[many(f"{k}_Keyword") for k in ("Theme", "Place", "Stratum", "Temporal")]), "access": one("Access_Constraints"), "use": one("Use_Constraints"),
    }
    found = pages.select(*keep, "url", X.html_to_text(F.col("html")).alias(body)).select(*keep, "url", *[v.alias(name(k)) for k, v in raw.items()])
    r = {k: F.col(name(k)) for k in raw}

    day = lambda at, begin: times.fgdc(F.try_element_at(r["days"], F.lit(at)), begin)
    # of the calendar dates a range looks at the first and the last
    first, _ = times.fgdc_range(F.array(day(1, True)), times.fgdc(r["from"], True), F.lit(None), times.fgdc(r["out"], True))
    _, last = times.fgdc_range(F.array(day(1, False), day(-1, False)), times.fgdc(r["from"], False), times.fgdc(r["to"], False), times.fgdc(r["out"], False))
    begin, end = name("begin"), name("end")
    found = found.withColumns({begin: first, end: last})
    sides = [r[x] for x in "wsen"]
    return found.select(
        *keep, "url", r["title"].alias("title"), F.array_distinct(F.transform(r["by"], lambda o: X.canonical_org(o, True))).alias("originators"), r["notes"].alias("notes"),
        F.when(geo.valid(*sides, ordered=True), F.struct(*[x.alias(n) for x, n in zip(sides, ("west", "south", "east", "north"), strict=True)])).alias("space"),
        F.col(begin).alias("begin"), F.greatest(begin, end).alias("end"), F.array_distinct(F.transform(r["words"], X.canonical_keyword)).alias("keywords"),
        F.when(r["access"].isNotNull() | r["use"].isNotNull(), X.stable_id("lic:", F.coalesce(r["access"], F.lit("")), F.coalesce(r["use"], F.lit("")))).alias("license_id"),
    )


#: Fixed value: links to a dataset's metadata page.
METADATA = "(?i)FullMetadataDisplay\\.aspx\\?file=[^\"'&#\\s>]+"
#: Why a summary page gives no dataset.
NO_SUMMARY, NO_LINK, NO_PAGE, EMPTY = "summary is empty", "no link to metadata", "metadata page is missing", "metadata page is empty"


def metadata_link(base: Column, html: Column) -> Column:
    """The first link to a metadata page, absolute; null without one."""
    found = F.regexp_extract(html, METADATA, 0)
    return F.when(found != "", urls.resolve(base, found))


def mapped(summaries: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``summaries(dataset, provider, url, html)`` and metadata ``pages(url, html)`` -> datasets, and rejects with their cause.

    A summary leads to its dataset's metadata by link. A summary that doesn't is rejected with its cause and stays out of the
    datasets; the others aren't held up by it. A dataset without a title is named by its number, one without an
    originator by its provider. Of several pages under one address the first by content counts, so that reruns agree.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    led = summaries.select("dataset", "provider", F.col("url").alias("summary_url"), blank("html").alias("_blank"), metadata_link(F.col("url"), F.col("html")).alias("url"))
    known = pages.groupBy("url").agg(F.min("html").alias("html"), F.lit(True).alias("_there"))
    both = led.join(known, "url", "left")
    cause = F.when(F.col("_blank"), NO_SUMMARY).when(F.col("url").isNull(), NO_LINK).when(F.col("_there").isNull(), NO_PAGE).when(blank("html"), EMPTY)
    judged = both.withColumn("cause", cause)
    rejects = judged.where("cause is not null").select("dataset", "summary_url", F.col("url").alias("metadata_url"), "cause")
    head = F.regexp_extract("html", "(?is)<h2[^>]*>\\s*(.*?)\\s*</h2>", 1)
    good = judged.where("cause is null").select("dataset", "provider", "summary_url", "url", "html", X.clean(head).alias("_head"))
    read = metadata(good, "dataset", "provider", "summary_url", "_head")
    title = F.coalesce(F.when(F.col("_head") != "", F.col("_head")), F.when(F.col("title") != "", F.col("title")), F.concat(F.lit("dataset "), F.col("dataset").cast("string")))
    by = F.when((F.size("originators") == 0) & ~blank("provider"), F.array(X.canonical_org(F.col("provider"), True))).otherwise(F.col("originators"))
    return read.withColumns({"title": title, "originators": by}).withColumnRenamed("url", "metadata_url").drop("_head"), rejects


def topic_text(meta: DataFrame) -> DataFrame:
    """Text for topic extraction: title, notes and 18 keywords at most, 2500 characters."""
    words = F.filter("keywords", lambda k: k.isNotNull())
    line = F.when(F.size(words) > 0, F.concat(F.lit("Keywords: "), F.array_join(F.transform(F.slice(words, 1, 18), lambda k: F.concat(k, F.lit("; "))), "")))
    return meta.select("url", F.substring(F.trim(F.concat_ws("\n", "title", "notes", line)), 1, 2500).alias("topic_text"))


def links(pages: DataFrame) -> DataFrame:
    """Resources linked from summary pages, absolute, each once, with name, type and format by their URL."""
    link = F.explode(F.array_distinct(F.transform(urls.hrefs(F.col("html")), lambda h: urls.strip_slash(urls.resolve(F.col("url"), h))))).alias("link")
    rows = pages.select("url", link).where(~F.lower("link").contains("search"))
    c = F.col("link")
    return rows.select("url", "link", urls.resource_name(c).alias("name"), urls.resource_type(c).alias("type"), urls.format_from_url(c).alias("format"))
