"""Link columns: JSON and HTML link forms and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleaner.functions.columns import strip
from gleaner.functions.markup import SCHEMES


def is_absolute(link: Column) -> Column:
    """Whether a link names its own http or https host."""
    return link.startswith("http://") | link.startswith("https://")


def site_root(page_url: Column) -> Column:
    """Scheme and host of a page."""
    return F.substring_index(page_url, "/", 3)


def folder_url(page_url: Column) -> Column:
    """A page's URL up to its last slash."""
    return F.regexp_extract(page_url, r"^(.*)/[^/]*$", 1)


def resolve_json_link(link: Column, root: Column, folder: Column) -> Column:
    """A link found in JSON, made absolute by its page's ``site_root`` and ``folder_url``."""
    return (
        F.when(is_absolute(link), link)
        .when(link.startswith("/"), strip(F.concat(root, link)))
        .otherwise(strip(F.concat(folder, F.lit("/"), link)))
    )


def fill_template(template: Column, ident: Column) -> Column:
    """An article URL from its id."""
    return F.replace(template, F.lit("<id>"), ident)


def _without_dots(path: Column) -> Column:
    """A path without its dot segments; a leading ``..`` that leads nowhere stays."""
    parts = F.split(path, "/")
    steps = F.transform(parts, lambda part, place: F.struct(part.alias("part"), (place == F.size(parts) - 1).alias("last")))

    def take(kept: Column, step: Column) -> Column:
        up = (step["part"] == "..") & (F.size(kept) > 1) & (F.element_at(kept, -1) != "..")
        shorter = F.when(up, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        ended = F.when(step["last"], F.array_append(shorter, F.lit(""))).otherwise(shorter)
        return F.when(up | (step["part"] == "."), ended).otherwise(F.array_append(kept, step["part"]))

    flat = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), take), "/")
    return F.when(F.contains(path, F.lit("/.")), flat).otherwise(path)


_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _absolute(url: Column) -> Column:
    """A reference with a scheme: nothing for one that no page has, dot segments taken out."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    origin = F.concat(F.regexp_extract(url, _PARTS, 1), F.lit("://"), F.regexp_extract(url, _PARTS, 2))
    whole = F.concat(origin, _without_dots(F.regexp_extract(url, _PARTS, 3)), F.regexp_extract(url, _PARTS, 4), F.regexp_extract(url, _PARTS, 5))
    return F.when(~scheme.isin(sorted(SCHEMES)), "").when(F.contains(url, F.lit("/.")) & url.rlike(_PARTS), whole).otherwise(url)


def resolve_html_link(page_url: Column, ref: Column) -> Column:
    """A reference found in HTML, made absolute by its page's URL; a missing one stays empty."""
    link = strip(ref)
    scheme = F.regexp_extract(page_url, _PARTS, 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(page_url, _PARTS, 2))
    path, query = F.regexp_extract(page_url, _PARTS, 3), F.regexp_extract(page_url, _PARTS, 4)
    first, rest = F.regexp_extract(link, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(link, r"(?s)^([^?#]*)(.*)$", 2)
    folder = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    target = F.when(link.startswith("/"), first).otherwise(F.concat(folder, F.lit("/"), first))
    return (
        F.when(ref.isNull(), "")
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), _absolute(link))
        .when(~page_url.rlike(_PARTS), "")
        .when((link == "") | link.startswith("#"), F.concat(origin, path, query, link))
        .when(link.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), link))
        .when(link.startswith("//"), _absolute(F.concat(scheme, F.lit(":"), link)))
        .otherwise(F.concat(origin, _without_dots(target), rest))
    )
