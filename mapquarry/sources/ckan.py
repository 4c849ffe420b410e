"""CKAN dumps (a JSON array of packages) -> typed node and relationship tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as X
from ..functions import times
from ..operators.tables import last_wins

S = "string"
_NAMED = "struct<id:string,name:string,title:string,type:string,description:string,image_url:string>"
_RES = (
    "struct<id:string,created:string,description:string,last_modified:string,name:string,package_id:string,resource_type:string,"
    "url:string,url_type:string,format:string,size:bigint>"
)
SCHEMA = (
    "id string, name string, title string, notes string, type string, version string, url string, num_resources int, num_tags int,"
    f" license_id string, license_title string, license_url string, organization {_NAMED},"
    f" tags array<struct<id:string,name:string,display_name:string>>, extras array<struct<key:string,value:string>>, resources array<{_RES}>"
)


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Packages of a dump, an array or one a line (which splits); one without an id gets a hash of its content, so reruns agree."""
    raw = spark.read.schema(SCHEMA).option("multiLine", not lines).json(path)
    return raw.withColumn("id", F.coalesce("id", F.sha1(F.to_json(F.struct("name", "title", "notes", "url")))))


def envelope(packages: DataFrame) -> DataFrame:
    """One row a package with its space, time, license, organization, keywords and resources."""
    kv = X.key_values(F.col("extras"))
    at = lambda k: F.try_element_at(kv, F.lit(k))
    num = lambda k: at(k).try_cast("double")
    w, e = geo.ordered(num("bbox-west-long"), num("bbox-east-long"))
    s, n = geo.ordered(num("bbox-south-lat"), num("bbox-north-lat"))
    box = F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"), geo.centroid(w, s, e, n).alias("centroid"), geo.wkt(w, s, e, n).alias("wkt"))
    complete = num("bbox-west-long").isNotNull() & num("bbox-east-long").isNotNull() & num("bbox-south-lat").isNotNull() & num("bbox-north-lat").isNotNull()
    begin, end = times.ckan(at("temporal-extent-begin"), True), times.ckan(at("temporal-extent-end"), False)
    lic = F.struct(X.license_id(F.col("license_id"), F.col("license_title")).alias("license_id"), "license_title", "license_url")
    word = lambda t: F.struct(F.coalesce(t["id"], F.concat(F.lit("kw:"), F.sha1(F.lower(t["name"])))).alias("id"), t["name"].alias("name"), X.canonical_keyword(t["name"]).alias("canonical"))
    res = lambda r: F.struct(
        F.coalesce(r["id"], F.sha1(F.concat_ws("|", "id", r["url"], r["name"]))).alias("id"), r["name"].alias("name"), r["url"].alias("url"),
        X.canonical_format(r["format"]).alias("format"), r["size"].alias("size"),
    )
    return packages.select(
        "id", "name", "title", "notes", "url", F.when(complete & geo.valid(w, s, e, n), box).alias("space"),
        F.struct(begin.alias("begin"), F.greatest(begin, end).alias("end")).alias("time"), lic.alias("license"), "organization",
        F.transform("tags", word).alias("keywords"), F.transform("resources", res).alias("resources"),
        X.extraction_text(F.col("title"), F.col("notes"), F.transform("tags", lambda t: t["name"])).alias("topic_text"),
    )


def last(rows: DataFrame, key: str) -> DataFrame:
    """One row a key. A dump has no order of its own, so of rows that differ the greatest counts, and reruns agree."""
    return last_wins(rows, [key], F.struct(*[c for c in rows.columns if c != key]))


def tables(env: DataFrame) -> dict[str, DataFrame]:
    """Node and relationship tables of the envelope; keyed sets, ready to upsert."""
    kw = env.select(F.col("id").alias("dataset_id"), F.explode("keywords").alias("k"))
    rs = env.select(F.col("id").alias("dataset_id"), F.explode("resources").alias("r"))
    org = env.where("organization is not null")
    lic = env.where("license.license_id is not null")
    return {
        "dataset": last(env.select("id", "name", "title", "notes", "url"), "id"),
        "space": env.where("space is not null").select(F.col("id").alias("dataset_id"), "space.*"),
        "time": env.select(F.col("id").alias("dataset_id"), "time.*"),
        "license": last(lic.select("license.*"), "license_id"),
        "has_license": lic.select(F.col("id").alias("dataset_id"), F.col("license.license_id").alias("entity_id")).distinct(),
        "organization": last(org.select("organization.*"), "id"),
        "published_by": org.select(F.col("id").alias("dataset_id"), F.col("organization.id").alias("entity_id")).distinct(),
        "keyword": last(kw.select("k.*"), "id"),
        "has_keyword": kw.select("dataset_id", F.col("k.id").alias("entity_id")).distinct(),
        "resource": last(rs.select("r.id", "r.name", "r.url", "r.size"), "id"),
        "has_resource": rs.select("dataset_id", F.col("r.id").alias("resource_id")).distinct(),
        "has_format": rs.select(F.col("r.id").alias("resource_id"), F.concat(F.lit("format:"), "r.format").alias("entity_id")).distinct(),
    }
