"""Saved pages of public accounts: search results, article history, articles.

Their layout is fixed, so the selectors are too. The pages come from a table;
nothing is fetched here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleaner.functions.columns import BLANKS, upload_path
from gleaner.functions.markup import Element, base_url, outer_html, parse, resolve, select, text_of, text_of_all
from gleaner.functions.readers import page_reader
from gleaner.operators.bodies import image_filename, images_of, rewrite, top_elements
from gleaner.schemas import IMAGES, texts

# Where the saved pages keep things.
SEARCH = {
    "item": "div.news-box > ul.news-list > li[d]",
    "link": "div.txt-box > h3 > a",
    "image": "div.img-box a[data-z] img",
}
HISTORY = {
    "item": "div#history div[msgid]",
    "title": "h4[class=weui_media_title]",
    "image": "span[class=weui_media_hd]",
    "date": "p.weui_media_extra_info",
}
ARTICLE = {
    "title": "h2#activity-name",
    "content": "div#js_content",
    "date": "em#post-date",
    "author": "div.rich_media_meta_list > em[class=rich_media_meta rich_media_meta_text]",
    "images": "div#js_content img",
    "reads": "span#sg_readNum3",
    "likes": "span#sg_likeNum3",
}

ITEM_COLUMNS = ("title", "url", "postdate", "titleimage")
ITEMS_TYPE = T.StructType([T.StructField("items", T.ArrayType(T.StructType(texts(*ITEM_COLUMNS)))), *texts("error")])
ARTICLE_COLUMNS = (
    "content contenttext contentabsurl contentlocalurl title postdate author titleimage readcount likecount".split()
)
ARTICLE_TYPE = T.StructType([*texts(*ARTICLE_COLUMNS), T.StructField("images", IMAGES), *texts("error")])


def _first(found: list[Element], read) -> str:
    return read(found[0]) if found else ""


def search_items(page_url: str, body: str) -> list[tuple]:
    """Items of a saved search result page; they carry no date."""
    items, tree = [], parse(body)
    base = base_url(tree, page_url)
    for item in select(tree, SEARCH["item"]):
        links = select(item, SEARCH["link"])
        image = _first(select(item, SEARCH["image"]), lambda node: resolve(base, node.get("src")))
        items.append(
            (_first(links, text_of), _first(links, lambda node: resolve(base, node.get("href"))), "", image)
        )
    return items


def history_items(page_url: str, body: str) -> list[tuple]:
    """Items of a saved account history page."""
    items, tree = [], parse(body)
    base = base_url(tree, page_url)
    for item in select(tree, HISTORY["item"]):
        titles = select(item, HISTORY["title"])
        style = _first(select(item, HISTORY["image"]), lambda node: node.get("style") or "")
        items.append(
            (
                _first(titles, text_of),
                _first(titles, lambda node: resolve(base, node.get("hrefs"))),
                _first(select(item, HISTORY["date"]), text_of),
                style.replace("background-image:url(", "").replace(")", ""),
            )
        )
    return items


@page_reader(ITEMS_TYPE)
def _items(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    def one(page_url, body, contenttype):
        if body is None:
            return [], ""
        try:
            found = (history_items if contenttype == 1 else search_items)(page_url, body)
        except Exception as failure:
            return [], f"{type(failure).__name__}: {failure}"
        return [dict(zip(ITEM_COLUMNS, item)) for item in found], "" if found else "the page lists no articles"

    for batch in parts:
        yield pd.DataFrame([one(*row) for row in zip(*batch)], columns=["items", "error"])


def account_items(pages: DataFrame, contenttype: Column) -> DataFrame:
    """Article items of saved account pages (``url, body, connecterror``), one row per page.

    Content type 0 is a search result page, 1 an account's history.
    """
    body = F.when(F.col("connecterror") == "", F.col("body"))
    read = pages.withColumn("_read", _items("url", body, contenttype))
    return read.select(
        *[name for name in pages.columns if name not in ("body", "parseerror")],
        F.col("_read.items").alias("items"),
        F.col("_read.error").alias("parseerror"),
    )


def explode_items(listed: DataFrame, *keep: str) -> DataFrame:
    """One row per item with its place on the page."""
    item = listed.select(*keep, F.posexplode("items").alias("pos", "_item"))
    return item.select(*keep, "pos", "_item.title", F.col("_item.url").alias("link"), "_item.postdate", "_item.titleimage")


def _title_image(sources: list[str]) -> str:
    """More than two images: the second; exactly one: that one; else none."""
    if len(sources) > 2:
        return sources[1].strip(BLANKS)
    return sources[0].strip(BLANKS) if len(sources) == 1 else ""


def read_article(body: str, path: str, owner: int) -> tuple:
    """Everything a saved account article holds."""
    tree = parse(body)

    def words(name: str) -> str:
        return _first(select(tree, ARTICLE[name]), text_of)

    title = words("title")
    content = _first(select(tree, ARTICLE["content"]), outer_html).strip(BLANKS)
    authors = select(tree, ARTICLE["author"])
    elements = top_elements(content)
    images = images_of(elements, "data-src")
    sources = [source or "" for _, source in images]
    text = text_of_all(elements)
    with_sources = rewrite(elements, images, sources)
    with_local = rewrite(elements, images, [path + image_filename(owner, place) for place in range(len(images))])
    return (
        content,
        text,
        with_sources,
        with_local,
        title,
        words("date"),
        text_of(authors[1]) if len(authors) > 1 else "",
        _title_image([node.get("data-src") or "" for node in select(tree, ARTICLE["images"])]),
        words("reads"),
        words("likes"),
        [{"urlsrc": source, "urlabs": source} for source in sources],
        "" if title and content else "the page holds no article",
    )


@page_reader(ARTICLE_TYPE)
def _article(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    nothing = (None,) * len(ARTICLE_COLUMNS)

    def one(body, path, owner):
        if body is None:
            return (*nothing, None, "")
        try:
            return read_article(body, path, owner)
        except Exception as failure:
            return (*nothing, None, f"{type(failure).__name__}: {failure}")

    for batch in parts:
        yield pd.DataFrame([one(*row) for row in zip(*batch)], columns=[*ARTICLE_COLUMNS, "images", "error"])


def account_articles(pages: DataFrame, now: int) -> DataFrame:
    """Saved account articles (``cuid, sid, body, connecterror``), one row each.

    The columns of a page that was not read are NULL, which tells it from a
    page whose fields are empty.
    """
    body = F.when(F.col("connecterror") == "", F.col("body"))
    read = pages.withColumn("_read", _article(body, upload_path(F.col("sid"), now), F.col("cuid")))
    return read.select(
        *[name for name in pages.columns if name not in ("body", "parseerror", *ARTICLE_COLUMNS)],
        *[F.col(f"_read.{name}").alias(name) for name in ARTICLE_COLUMNS],
        F.col("_read.images").alias("images"),
        F.col("_read.error").alias("parseerror"),
    )
