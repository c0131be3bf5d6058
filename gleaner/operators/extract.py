"""Links and article fields from stored pages, by the rules of their sites.

A page comes with its rule on the same row. The tree walk runs as a scalar
Pandas UDF, so only the body and the rule travel to Python; checks, prefixes
and JSON links stay native columns. A rule that is not valid counts as a
connect error of the page, as does a failed fetch; such pages are never parsed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleaner.functions import rules
from gleaner.functions.columns import BLANKS, json_text, strip
from gleaner.functions.markup import base_url, inner_html, parse, resolve, select, text_of
from gleaner.functions.readers import page_reader
from gleaner.functions.rules import FIELDS
from gleaner.functions.urls import fill_template, folder_url, resolve_json_link, site_root
from gleaner.schemas import texts

FIELDS_TYPE = T.StructType(texts(*FIELDS, "error"))
LINKS_TYPE = T.StructType([T.StructField("links", T.ArrayType(T.StringType())), *texts("error")])


def _reason(failure: Exception) -> str:
    return f"{type(failure).__name__}: {failure}"


@page_reader(LINKS_TYPE)
def _html_links(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Absolute links of each page: every link element within every list element."""

    def one(page_url, body, block, link, attribute):
        if body is None:
            return [], ""
        try:
            tree = parse(body)
            base = base_url(tree, page_url)
            found = [
                resolve(base, node.get(attribute or "href")) for part in select(tree, block) for node in select(part, link)
            ]
            return found, ""
        except Exception as failure:
            return [], _reason(failure)

    for batch in parts:
        yield pd.DataFrame([one(*row) for row in zip(*batch)], columns=["links", "error"])


def json_steps(document: object, path: str) -> list:
    """The JSON values a path leads to: ``| k`` a direct member, ``|| k`` every member named k below."""
    steps, found = path.split(" "), [document]
    for operator, name in zip(steps[0::2], steps[1::2]):
        if operator == "||":
            found = [value for start in found for value in _members_named(start, name)]
        else:
            found = [_member(value, name) for value in found]
    return found


def _member(value: object, name: str) -> object:
    if not isinstance(value, dict):
        raise KeyError(name)
    return value[name]


def _members_named(start: object, name: str) -> Iterator[object]:
    """Members of a name at any depth, a member before those inside it."""
    todo: list[tuple[bool, object]] = [(False, start)]
    while todo:
        hit, value = todo.pop()
        if hit:
            yield value
        if isinstance(value, dict):
            todo.extend((key == name, inner) for key, inner in reversed(value.items()))
        elif isinstance(value, list):
            todo.extend((False, inner) for inner in reversed(value))


def _not_json(text: str) -> None:
    raise ValueError(f"{text} is not JSON")


def read_json(body: str) -> object:
    """A JSON document with its numbers as written."""
    return json.loads(body, parse_float=Decimal, parse_constant=_not_json)


# Digits that a number may take in plain notation; beyond, its exponent stays.
_PLAIN_DIGITS = 400


def _compact(value: object) -> str:
    if isinstance(value, Decimal):
        return format(value, "f") if abs(value.adjusted()) < _PLAIN_DIGITS else str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_compact(key)}:{_compact(inner)}" for key, inner in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_compact, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def json_words(value: object) -> str:
    """A JSON value as trimmed text: strings as they are, the rest as compact JSON."""
    return (value if isinstance(value, str) else _compact(value)).strip(BLANKS)


@page_reader(LINKS_TYPE)
def _json_values(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """The values of each JSON page at a path, as text."""

    def one(body, path):
        if body is None:
            return [], ""
        try:
            return [json_words(value) for value in json_steps(read_json(body), path)], ""
        except Exception as failure:
            return [], _reason(failure)

    for batch in parts:
        yield pd.DataFrame([one(*row) for row in zip(*batch)], columns=["links", "error"])


def _quiet(read, otherwise: str | None = "") -> str | None:
    """One field; whatever goes wrong with it leaves it empty."""
    try:
        return read()
    except Exception:
        return otherwise


@page_reader(FIELDS_TYPE)
def _html_fields(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """The six fields of each HTML article page."""

    def one(page_url, body, *paths):
        if body is None:
            return ("",) * len(FIELDS) + ("",)
        try:
            tree = parse(body)
        except Exception as failure:
            return ("",) * len(FIELDS) + (_reason(failure),)
        readers = {
            "content": lambda found: inner_html(found[0]).strip(BLANKS),
            "tag": lambda found: ",".join(text_of(node) for node in found).strip(BLANKS),
            "titleimage": lambda found: resolve(base_url(tree, page_url), found[0].get("src")).strip(BLANKS),
        }
        fields = (
            path and _quiet(lambda: readers.get(name, lambda found: text_of(found[0]))(select(tree, path)))
            for name, path in zip(FIELDS, paths)
        )
        return (*fields, "")

    for batch in parts:
        yield pd.DataFrame([one(*row) for row in zip(*batch)], columns=[*FIELDS, "error"])


@page_reader(FIELDS_TYPE)
def _json_fields(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """The six fields of each JSON article page; the title image is not yet absolute, a missing one NULL."""

    def one(body, *paths):
        if body is None:
            return ("",) * (len(FIELDS) - 1) + (None, "")
        try:
            document = read_json(body)
        except Exception as failure:
            return ("",) * (len(FIELDS) - 1) + (None, _reason(failure))

        def read(name, path):
            if not path:
                raise KeyError(name)
            words = [json_words(value) for value in json_steps(document, path)]
            return ",".join(words).strip(BLANKS) if name == "tag" else words[0]

        fields = (
            _quiet(lambda: read(name, path), None if name == "titleimage" else "") for name, path in zip(FIELDS, paths)
        )
        return (*fields, "")

    for batch in parts:
        yield pd.DataFrame([one(*row) for row in zip(*batch)], columns=[*FIELDS, "error"])


def _gated(pages: DataFrame, part: str, chosen: Column, rule_error: Column) -> DataFrame:
    """Pages with the error of a chosen rule and, where nothing is wrong, the body to parse."""
    checked = pages.withColumn(f"{part}_rule", F.when(chosen, rule_error).otherwise(F.lit("")))
    good = chosen & (F.col(f"{part}_rule") == "") & (F.col("connecterror") == "")
    return checked.withColumn(f"{part}_body", F.when(good, F.col("body")))


def _add_html_links(pages: DataFrame, chosen: Column) -> DataFrame:
    rule = F.col("listhtml")
    gated = _gated(pages, "_html", chosen, rules.listhtml_error())
    found = _html_links(
        "url", "_html_body", json_text(rule, "list"), json_text(rule, "contenturl"), json_text(rule, "attr")
    )
    prefix = json_text(rule, "urlprefix")
    return (
        gated.withColumn("_html_prefix", prefix)
        .withColumn("_html", found)
        .withColumn("_html_links", F.filter("_html.links", lambda link: link.startswith(F.col("_html_prefix"))))
    )


def _add_json_links(pages: DataFrame, chosen: Column) -> DataFrame:
    rule = F.col("listjson")
    added = _gated(pages, "_json", chosen, rules.listjson_error()).withColumns(
        {
            "_json_prefix": json_text(rule, "urlprefix"),
            "_json_template": json_text(rule, "extraprefix"),
            "_json_root": site_root(F.col("url")),
            "_json_folder": folder_url(F.col("url")),
        }
    )
    read = added.withColumn("_json", _json_values("_json_body", json_text(rule, "contenturl")))
    templated = (F.col("_json_template") != "") & (F.col("_json_prefix") == "")
    links = F.transform(
        F.filter("_json.links", lambda link: link.startswith(F.col("_json_prefix"))),
        lambda link: F.when(templated, fill_template(F.col("_json_template"), link)).otherwise(
            resolve_json_link(link, F.col("_json_root"), F.col("_json_folder"))
        ),
    )
    return read.withColumn("_json_links", links)


def _linked(pages: DataFrame, added: DataFrame, *parts: str, **more: Column) -> DataFrame:
    """One row per page with the links and errors of the parts; only one part has read a page."""
    rule = F.concat(*[F.col(f"{part}_rule") for part in parts])
    return added.select(
        *[name for name in pages.columns if name not in ("body", "connecterror", "parseerror")],
        *[column.alias(name) for name, column in more.items()],
        F.when(rule != "", rule).otherwise(F.col("connecterror")).alias("connecterror"),
        F.concat(*[F.col(f"{part}_links") for part in parts]).alias("links"),
        F.concat(*[F.col(f"{part}.error") for part in parts]).alias("parseerror"),
    )


def html_links(pages: DataFrame) -> DataFrame:
    """Links of HTML list pages, one row per page.

    In: ``url, body, connecterror, listhtml`` and whatever else. Out: the same
    without the body, with ``links`` (page order, duplicates kept) and
    ``parseerror``.
    """
    return _linked(pages, _add_html_links(pages, F.lit(True)), "_html")


def json_links(pages: DataFrame) -> DataFrame:
    """Links of JSON list pages, one row per page; shape as ``html_links`` with a ``listjson`` rule.

    A prefix is compared with the link as written; an id template applies only
    without a prefix; other links are made absolute by the page's URL.
    """
    return _linked(pages, _add_json_links(pages, F.lit(True)), "_json")


def list_results(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Results of fetched list pages (with ``sid``) by whichever rule their site has, in one scan."""
    ruled = with_site_rules(pages, sites, "listhtml", "listjson")
    by_html = strip(F.col("listhtml")) != ""
    by_json = ~by_html & (strip(F.col("listjson")) != "")
    added = _add_json_links(_add_html_links(ruled, by_html), by_json)
    return _linked(
        ruled,
        added,
        "_html",
        "_json",
        joberror=F.when(by_html | by_json, F.lit("")).otherwise(F.lit("the site has no list rule")),
        source=_source("_html", "_json"),
    ).drop("listhtml", "listjson")


def _source(*parts: str) -> Column:
    """The page as kept with its result: nothing when it could not be read."""
    failed = F.concat(*[F.col(f"{part}.error") for part in parts]) != ""
    return F.when(failed, F.lit("")).otherwise(
        F.coalesce(*[F.col(f"{part}_body") for part in parts], F.lit(""))
    )


def explode_links(linked: DataFrame, *keep: str) -> DataFrame:
    """One row per link with its place on the page."""
    return linked.select(*keep, F.posexplode("links").alias("pos", "link"))


def _add_html_fields(pages: DataFrame, chosen: Column) -> DataFrame:
    rule = F.col("contenthtml")
    gated = _gated(pages, "_html", chosen, rules.contenthtml_error())
    return gated.withColumn("_html", _html_fields("url", "_html_body", *[json_text(rule, name) for name in FIELDS]))


def _add_json_fields(pages: DataFrame, chosen: Column) -> DataFrame:
    rule = F.col("contentjson")
    gated = _gated(pages, "_json", chosen, rules.contentjson_error())
    read = gated.withColumn("_json", _json_fields("_json_body", *[json_text(rule, name) for name in FIELDS]))
    image = F.col("_json.titleimage")
    absolute = resolve_json_link(image, site_root(F.col("url")), folder_url(F.col("url")))
    # An empty text that was found still resolves to its folder; only a missing one stays empty.
    return read.withColumn(
        "_json", F.col("_json").withField("titleimage", F.when(image.isNull(), F.lit("")).otherwise(absolute))
    )


def _with_fields(pages: DataFrame, added: DataFrame, *parts: str, **more: Column) -> DataFrame:
    rule = F.concat(*[F.col(f"{part}_rule") for part in parts])
    return added.select(
        *[name for name in pages.columns if name not in ("body", "connecterror", "parseerror", *FIELDS)],
        *[column.alias(name) for name, column in more.items()],
        F.when(rule != "", rule).otherwise(F.col("connecterror")).alias("connecterror"),
        *[F.concat(*[F.col(f"{part}.{name}") for part in parts]).alias(name) for name in FIELDS],
        F.concat(*[F.col(f"{part}.error") for part in parts]).alias("parseerror"),
    )


def html_fields(pages: DataFrame) -> DataFrame:
    """The six fields of HTML article pages with a ``contenthtml`` rule."""
    return _with_fields(pages, _add_html_fields(pages, F.lit(True)), "_html")


def json_fields(pages: DataFrame) -> DataFrame:
    """The six fields of JSON article pages with a ``contentjson`` rule."""
    return _with_fields(pages, _add_json_fields(pages, F.lit(True)), "_json")


def article_results(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Results of fetched article pages (with ``sid``) by whichever rule their site has, in one scan."""
    ruled = with_site_rules(pages, sites, "contenthtml", "contentjson")
    by_html = strip(F.col("contenthtml")) != ""
    by_json = ~by_html & (strip(F.col("contentjson")) != "")
    added = _add_json_fields(_add_html_fields(ruled, by_html), by_json)
    return _with_fields(
        ruled,
        added,
        "_html",
        "_json",
        joberror=F.when(by_html | by_json, F.lit("")).otherwise(F.lit("the site has no article rule")),
        source=_source("_html", "_json"),
    ).drop("contenthtml", "contentjson")


def with_site_rules(pages: DataFrame, sites: DataFrame, *rule_columns: str) -> DataFrame:
    """Pages with the rules of their site.

    A plain join: Catalyst sends the rules to the pages as long as their size allows. Pages
    kept in buckets of their site (``write_paged_by_site``) do not move whatever the rules weigh.
    """
    return pages.join(sites.select("sid", *rule_columns), "sid")
