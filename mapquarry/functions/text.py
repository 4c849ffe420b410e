"""Canonical names, stable ids, labels and small text grammars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest text sent to an embedding model.
EMBED_CHARS = 6000


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\x0B\\f\\r]+", " "))


def canonical_topic(c: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def canonical_keyword(c: Column) -> Column:
    """As topics, but ``-``, ``_`` and ``/`` stay."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9_/-]+", " "))


def canonical_org(c: Column, strict: bool = False) -> Column:
    """``&``, ``-``, ``_``, ``/`` stay; strict keeps only ``&`` and ``-`` and names blanks ``unknown``."""
    out = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9& -]+" if strict else "[^a-z0-9&_/ -]+", " "))
    out = F.regexp_replace(out, " +", " ")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit("unknown")).otherwise(out) if strict else out


def canonical_format(c: Column) -> Column:
    out = squeeze(F.lower(c))
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit("unknown")).otherwise(out)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha1(F.concat_ws("|", *parts)))


def license_id(given: Column, title: Column) -> Column:
    given = F.when(F.trim(given) != "", F.trim(given))
    return F.coalesce(given, F.when(F.trim(title) != "", stable_id("lic:", F.lower(F.trim(title)))))


def key_values(entries: Column) -> Column:
    """Array of (key, value) -> map; the last value of a repeated key wins."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(
        keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
    )


def shorten(c: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(tail))).otherwise(F.coalesce(c, F.lit("")))


def display_label(*candidates: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in candidates], F.lit("Unknown"))


def embedding_text(*fields: Column) -> Column:
    """Non-blank fields on lines of their own, cut at the model's limit."""
    return F.substring(F.concat_ws("\n", *[F.when(F.trim(c) != "", F.trim(c)) for c in fields]), 1, EMBED_CHARS)


def extraction_text(title: Column, notes: Column, tags: Column) -> Column:
    return F.concat(F.lit("TITLE: "), F.coalesce(title, F.lit("")), F.lit("\nNOTES: "), F.coalesce(notes, F.lit("")), F.lit("\nTAGS: "), F.array_join(tags, ", "))


def clean(c: Column) -> Column:
    """No-break and zero-width spaces count as white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "\u200b", ""), "[ \\t\\n\\x0B\\f\\r\u00a0]+", " "))


def split_values(c: Column) -> Column:
    """``a, b; c & d and e`` -> its values."""
    parts = F.split(c, "(?i)\\s*(?:[,;&]|\\band\\b)\\s*")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda x: x != "")


def token_signature(canonical: Column) -> Column:
    """Sorted tokens of a name of two to eight tokens, else empty."""
    tokens = F.split(canonical, " ")
    return F.when(F.size(tokens).between(2, 8), F.array_join(F.array_sort(tokens), "_")).otherwise(F.lit(""))


def json_slice(c: Column) -> Column:
    """From the first ``{`` to the last ``}``."""
    found = F.regexp_extract(c, "(?s)(\\{.*\\})", 1)
    return F.when(found != "", found)


def has_cyrillic(c: Column) -> Column:
    return F.coalesce(c.rlike("[\u0400-\u04ff]"), F.lit(False))


def first_ip(c: Column) -> Column:
    return F.trim(F.split(c, ",")[0])


def landing_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def selections(c: Column) -> Column:
    """``Topic:1,3;Format:continue`` -> array of (dim, indices); ``continue`` has no indices."""
    parts = F.filter(F.split(c, ";"), lambda p: p.contains(":"))

    def one(p: Column) -> Column:
        picks = F.filter(F.split(F.substring_index(p, ":", -1), ","), lambda x: F.trim(x).rlike("^[0-9]{1,3}$"))
        return F.struct(
            F.trim(F.substring_index(p, ":", 1)).alias("dim"), F.transform(picks, lambda x: F.trim(x).cast("int")).alias("indices")
        )

    return F.transform(parts, one)


# ---- pages ------------------------------------------------------------------------------------


#: Elements whose content isn't shown, tags that end a line, references in the order they are decoded.
HIDDEN = ("script", "style")
ENDS_LINE = "/p /div /dt /dd /li /h1 /h2 /h3 /h4 /h5 /h6 /pre".split()
#: Tags that end a line, whatever stands behind ``pre``; a line end may close a rule.
BREAKS = f"(?:/(?:{'|'.join(t[1:] for t in ENDS_LINE)})|pre[^>]*|[bh]r\\s*/?(?:\\r\\n|[\\n\\r\\u0085\\u2028\\u2029])?)"
REFERENCES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}


def html_to_text(c: Column) -> Column:
    """Visible text with block ends as line ends and the six common references decoded.

    A tag runs from the first ``<`` behind the last ``>`` to the next ``>`` and isn't empty. In a page without its hidden
    elements each ``>`` gets a line end behind it, which only stays with tags that end a line. Each character is read once
    by a match that takes text and the tag behind it, so the work grows with the page's length.
    """
    shown = F.regexp_replace(c, f"(?is)<({'|'.join(HIDDEN)})[^>]*>.*?</\\1>", " ")
    piece = f"(?i)([^<>]*+)(?:<(?:{BREAKS}>(\\n)|[^>]++>\\n)|(<?>)\\n|(<[^>]*+\\z)|\\z)"
    lined = F.regexp_replace(F.replace(shown, F.lit(">"), F.lit(">\n")), piece, "$1$2$3$4")
    text = reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), REFERENCES.items(), lined)
    return F.trim(F.regexp_replace(text, "[\\t\\x0B\\f\\r\\n]+", "\n"), F.lit(" \n"))


def label_value(c: Column, label: str, all_values: bool = False) -> Column:
    """Rest of the line behind a label: the first one, or all that aren't blank. The label comes first in the pattern, as literals are found fast."""
    pattern = f"\\Q{label}\\E(?<=\\b\\Q{label}\\E)\\s*([^\\n\\r]+)"
    if all_values:
        return F.filter(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), clean), lambda x: x != "")
    found = F.regexp_extract(c, pattern, 1)
    return F.when(found != "", clean(found))


def label_double(c: Column, label: str) -> Column:
    return F.replace(label_value(c, label), F.lit(","), F.lit("")).try_cast("double")


def label_block(c: Column, start: str, ends: list[str]) -> Column:
    """Text behind ``start`` up to the nearest of ``ends`` (case-insensitive), else to the end."""
    at = F.instr(F.lower(c), start.lower())
    rest = F.substr(c, at + len(start), F.length(c))

    def first(x: Column) -> Column:
        stops = F.filter(F.array(*[F.instr(x["low"], e.lower()) for e in ends], F.lit(0)), lambda i: i > 0)
        return F.substr(x["rest"], F.lit(1), F.coalesce(F.array_min(stops) - 1, F.length(x["rest"])))

    # bound once
    return F.when(at > 0, clean(F.transform(F.array(F.struct(rest.alias("rest"), F.lower(rest).alias("low"))), first)[0]))
