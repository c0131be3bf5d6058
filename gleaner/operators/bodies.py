"""Article bodies: text, absolute and local forms, image manifest, reader clean-up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleaner.functions.columns import upload_path
from gleaner.functions.markup import Element, outer_html, parse, resolve, text_of_all
from gleaner.functions.readers import page_reader
from gleaner.schemas import IMAGES, texts

# Image attributes a reader does not get.
READER_STRIPS = ("data-w", "data-ratio", "data-src", "width", "height", "style", "class")

BODY_TYPE = T.StructType([*texts("text", "abs", "local"), T.StructField("images", IMAGES), *texts("error")])


def image_filename(owner: object, place: object) -> str:
    """File name of an article's image: a digest of article and place, so reruns agree."""
    return hashlib.sha256(f"{owner}:{place}".encode()).hexdigest()


def filename_column(owner: Column, place: Column) -> Column:
    """``image_filename`` as a column."""
    return F.sha2(F.concat_ws(":", owner.cast("string"), place.cast("string")), 256)


def top_elements(content: str) -> list[Element]:
    """The elements directly in a body; text between them is dropped."""
    body = parse(content).children[0].children[1]
    return [child for child in body.children if isinstance(child, Element)]


def images_of(elements: list[Element], attribute: str) -> list[tuple[Element, str]]:
    """Image elements in document order, each with the value of one attribute."""
    found = [node for element in elements for node in element.walk() if node.tag == "img"]
    return [(node, node.get(attribute)) for node in found]


def rewrite(elements: list[Element], images: list[tuple[Element, str]], targets: list[str]) -> str:
    """The elements' markup with new image sources."""
    for (node, _), target in zip(images, targets):
        node.attributes["src"] = target
    return "\n".join(outer_html(element) for element in elements)


def _normal(content: str, page_url: str, path: str, owner: int) -> tuple:
    elements = top_elements(content)
    images = images_of(elements, "src")
    absolute = [resolve(page_url, source) for _, source in images]
    words = text_of_all(elements)
    with_absolute = rewrite(elements, images, absolute)
    with_local = rewrite(elements, images, [path + image_filename(owner, place) for place in range(len(images))])
    manifest = [
        {"urlsrc": source or "", "urlabs": target} for (_, source), target in zip(images, absolute)
    ]
    return words, with_absolute, with_local, manifest, ""


@page_reader(BODY_TYPE)
def _normal_body(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    def one(content, page_url, path, owner):
        if content is None:
            return "", "", "", [], ""
        try:
            return _normal(content, page_url, path, owner)
        except Exception as failure:
            return "", "", "", [], f"{type(failure).__name__}: {failure}"

    for batch in parts:
        yield pd.DataFrame([one(*row) for row in zip(*batch)], columns=["text", "abs", "local", "images", "error"])


def normal_body(content: Column, page_url: Column, path: Column, owner: Column) -> Column:
    """Text, markup with absolute images, markup with local images, images and error of a body.

    NULL content, as of an article that failed, gives empty results.
    """
    return _normal_body(content, page_url, path, owner)


def normalise_bodies(articles: DataFrame, now: int) -> DataFrame:
    """Bodies of articles (``cuid, sid, url, content``) in their three forms."""
    body = normal_body(F.col("content"), F.col("url"), upload_path(F.col("sid"), now), F.col("cuid"))
    return articles.withColumn("_body", body).select(
        "cuid",
        F.col("_body.text").alias("contenttext"),
        F.col("_body.abs").alias("contentabsurl"),
        F.col("_body.local").alias("contentlocalurl"),
        F.col("_body.error").alias("parseerror"),
    )


def manifest_rows(articles: DataFrame, images: Column, now: int) -> DataFrame:
    """One row per image of ``images`` (an array column) that has an address."""
    return (
        articles.select("cuid", "sid", F.posexplode(images).alias("pos", "_image"))
        .filter(F.trim("_image.urlabs") != "")
        .select(
            "cuid",
            "sid",
            "pos",
            F.col("_image.urlabs").alias("urlabs"),
            F.col("_image.urlsrc").alias("urlsrc"),
            upload_path(F.col("sid"), now).alias("path"),
            filename_column(F.col("cuid"), F.col("pos")).alias("filename"),
        )
    )


def image_manifest(articles: DataFrame, now: int) -> DataFrame:
    """Images of article bodies (``cuid, sid, url, content``): addresses, folder, file name."""
    body = normal_body(F.col("content"), F.col("url"), upload_path(F.col("sid"), now), F.col("cuid"))
    return manifest_rows(articles.withColumn("_body", body), F.col("_body.images"), now)


def reader_body(content: Column) -> Column:
    """A stored body without the layout attributes of its images.

    Stored bodies are written by ``outer_html``: an attribute stands once in its
    tag, after one space, and its value in double quotes, so a pattern per attribute finds it in an image's tag.
    """
    for name in READER_STRIPS:
        content = F.regexp_replace(content, rf'(<img(?: [^\s=">]+(?:="[^"]*")?)*?) {name}(?:="[^"]*")?(?=[ >])', "$1")
    return content
