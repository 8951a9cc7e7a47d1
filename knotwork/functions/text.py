"""Text functions as columns. Patterns are Unicode-aware throughout, as (?U) and (?iuU) make them in Java."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotwork.plans.schema import JOINER

#: Mention markup: what writes it, and an older dialect. These patterns are the files' formats, so they read as the formats are.
ENTITY, LINK = "PossibleEntity", "URL"


def markup(name: str, url: str) -> str:
    """A mention in the markup; as a pattern, if its parts are patterns."""
    return f"<{ENTITY}>{name}</{ENTITY}> <{LINK}>:{url}</{LINK}>"


MENTION = markup("(.*?)", "(.*?)")
LEGACY = r"___E:(.*?) U:\((https?://[^\)]+)\)___"
TITLE_SUFFIX, NO_TITLE = " - Vikipedi", "Başlık Bulunamadı"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normalise_entity(c: Column) -> Column:
    """Stripped, lower case, single spaces; null is empty."""
    return F.coalesce(squeeze(F.lower(strip(c))), F.lit(""))


def strip_citations(c: Column) -> Column:
    """Single spaces, then without [12] marks."""
    return F.regexp_replace(squeeze(c), r"\[\d+\]", "")


def clean_entity(c: Column) -> Column:
    """An entity's text without markup in it, stray signs at its ends, and all but one side of an equals sign."""
    plain = squeeze(F.regexp_replace(strip(c), MENTION, ""))
    bare = F.regexp_replace(plain, r"(?U)^[=\-\s]+|[=\-\s]+$", "")
    left, right = (strip(F.get(F.split(bare, "="), F.lit(k))) for k in (0, 1))
    return F.when(bare.contains("="), F.when(left != "", left).otherwise(F.coalesce(right, F.lit("")))).otherwise(bare)


def markup_to_entity(c: Column) -> Column:
    """Sentences with each mention as its entity alone."""
    return squeeze(F.regexp_replace(c, markup(r"\s*(.*?)\s*", "(.*?)"), "$1"))


def without_markup(c: Column) -> Column:
    """Sentences without mentions."""
    return strip(squeeze(F.regexp_replace(c, MENTION, "")))


def bare_url(c: Column) -> Column:
    """A url without the one pair of parentheses that the markup puts around it."""
    return F.regexp_replace(strip(c), r"^\((.*)\)$", "$1")


def page_title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    there = html.rlike(r"(?is)<title[^>]*>.*?</title>")
    return F.when(there, strip(F.replace(found, F.lit(TITLE_SUFFIX), F.lit("")))).otherwise(NO_TITLE)


def _without_dots(path: Column) -> Column:
    """A path that begins with / without its . and .. segments."""
    folded = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))),
        lambda a: F.array_join(a, "/"),
    )
    whole = F.when(path.rlike(r"/\.\.?$") | (folded == ""), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(path)


def absolute_url(href: Column, origin: str, base_dir: str = "/", page: str | None = None) -> Column:
    """href as seen from a page of the directory base_dir under origin (the page itself, unless its path is given): absolute, //host, /path, ?query, #part or a relative path, without . and .. segments."""
    origin = origin.rstrip("/")
    path = F.regexp_extract(href, "^[^?#]*", 0)
    rest = F.substr(href, F.length(path) + 1)
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base_dir), path))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(origin.split("//")[0]), href))
        .when(path == "", F.concat(F.lit(origin + (page or base_dir)), href))
        .otherwise(F.concat(F.lit(origin), _without_dots(full), rest))
    )


def split_values(c: Column) -> Column:
    """A joined multi-value as an array of its stripped parts that aren't empty. A part that holds the joiner itself falls in two."""
    return F.filter(F.transform(F.split(c, JOINER), strip), lambda x: x != "")


def join_values(c: Column) -> Column:
    """An array as a joined string; null if it has no element."""
    return F.when(F.size(c) > 0, F.array_join(c, JOINER))


def preview(c: Column, most: int = 20) -> Column:
    """The first elements of a sorted array as a string, with dots if there are more."""
    return F.concat(F.array_join(F.slice(c, 1, most), JOINER), F.when(F.size(c) > most, "...").otherwise(""))


def hover(c: Column, most: int = 5) -> Column:
    """The first elements, one a line, and how many more there are."""
    more = F.size(c) - most
    return F.concat(F.array_join(F.slice(c, 1, most), "\n"), F.when(more > 0, F.format_string("\n... %d more", more)).otherwise(""))


def text_parts(c: Column) -> Column:
    """Parts between ' | ' that aren't blank."""
    return F.filter(F.transform(F.split(c, r" \| "), strip), lambda x: x != "")


def is_q_number(c: Column) -> Column:
    return F.upper(strip(c)).rlike(r"^Q[0-9]+$")


def q_number(c: Column) -> Column:
    """Upper-cased Q-id; null for what is none."""
    return F.when(is_q_number(c), F.upper(strip(c)))


def is_entity_uri(c: Column) -> Column:
    return c.contains("http://www.wikidata.org/entity/Q")


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def label_or(default: Column, *labels: Column) -> Column:
    """The first label that is neither null nor empty, else the default."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in labels), default)


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive regular expression anywhere in c; null doesn't match."""
    return F.coalesce(c.rlike("(?iuU)" + pattern), F.lit(False))


def unfenced(response: Column) -> Column:
    """A model's answer without the ``` or ```json fence around it."""
    fenced = F.regexp_extract(response, r"(?s)```json(.*?)(?:```|$)", 1)
    plain = F.regexp_extract(response, r"(?s)```(.*?)(?:```|$)", 1)
    return strip(F.when(response.contains("```json"), fenced).when(response.contains("```"), plain).otherwise(response))
