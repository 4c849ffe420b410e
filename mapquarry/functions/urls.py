"""URL rules: formats, resource names and types, links and resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# First rule that fits names the format. "*x" ends with x, otherwise contains.
URL_FORMATS = (
    ("geojson", "GeoJSON"), ("kmz", "KMZ"), ("wms", "WMS"), ("/rest/services", "ArcGIS REST"), ("mapserver", "MapServer"),
    ("featureserver", "FeatureServer"), ("imageserver", "ImageServer"), ("fullmetadatadisplay.aspx", "HTML"), ("*.zip", "ZIP"),
    ("*.csv", "CSV"), ("*.xlsx", "XLSX"), ("*.xls", "XLSX"), ("*.json", "JSON"), ("*.xml", "XML"), ("*.tif", "GeoTIFF"),
    ("*.tiff", "GeoTIFF"), ("*.shp", "SHP"), ("*.gpkg", "GPKG"),
)
MIME_FORMATS = (
    ("cog", "COG"), ("geotiff", "GeoTIFF"), ("image/tiff", "GeoTIFF"), ("netcdf", "NetCDF"), ("hdf", "HDF"), ("geo+json", "GeoJSON"),
    ("geojson", "GeoJSON"), ("json", "JSON"), ("jpeg", "JPEG"), ("png", "PNG"), ("csv", "CSV"),
)
NAMES = (
    ("fullmetadatadisplay.aspx", "Metadata"), ("download", "Download"), ("geojson", "GeoJSON"), ("kmz", "KMZ"),
    ("spreadsheet", "Spreadsheet"), ("*.xlsx", "Spreadsheet"), ("*.csv", "Spreadsheet"), ("preview", "Preview"),
    ("mapserver&/rest/", "ArcGIS REST"), ("wms", "WMS"), ("featureserver", "Feature Service"), ("imageserver", "Image Service"),
)
TYPES = (
    ("fullmetadatadisplay.aspx", "metadata"), ("download", "download"), ("preview", "preview"), ("mapserver", "service"),
    ("featureserver", "service"), ("imageserver", "service"),
)
USEFUL_RELS = ("self", "root", "parent", "items", "license", "documentation", "describedby")


def _fits(u: Column, rule: str) -> Column:
    if rule.startswith("*"):
        return u.endswith(rule[1:])
    return reduce(lambda a, b: a & b, [u.contains(x) for x in rule.split("&")])


def _first(u: Column, rules, other: Column) -> Column:
    return reduce(lambda acc, r: F.when(_fits(u, r[0]), F.lit(r[1])).otherwise(acc), reversed(rules), other)


def format_from_url(url: Column) -> Column:
    return F.when(url.isNotNull(), _first(F.lower(url), URL_FORMATS, F.lit("UNKNOWN")))


def format_from_mime(mime: Column) -> Column:
    """Known media types by name, else the subtype's letters and digits in capitals."""
    m = F.lower(F.trim(mime))
    sub = F.regexp_replace(F.regexp_extract(F.trim(F.split(m, ";")[0]), "^[^/]*/(.+)$", 1), "[^a-z0-9]+", "")
    return _first(m, MIME_FORMATS, F.when(sub != "", F.upper(sub)))


def resource_name(url: Column) -> Column:
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.regexp_extract(path, "([^/]+)/*$", 1)
    return _first(F.lower(url), NAMES, F.when(last != "", last).otherwise(F.lit("Resource")))


def resource_type(url: Column) -> Column:
    return _first(F.lower(url), TYPES, F.lit("link"))


def strip_slash(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "/+$", "")


def hrefs(html: Column) -> Column:
    """Targets of links in page order, references decoded; empty, script and fragment links go."""
    found = F.regexp_extract_all(html, F.lit("(?i)href\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1))
    trimmed = F.transform(found, lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&")))
    return F.filter(trimmed, lambda x: (x != "") & ~x.startswith("#") & ~F.lower(x).startswith("javascript:"))


def resolve(base: Column, link: Column) -> Column:
    """Absolute links stay; ``//host``, ``/path`` and relative links are set on the base."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(F.regexp_replace(folder, "([^/])$", "$1/"), F.regexp_replace(link, "^\\./", "")))
    )
