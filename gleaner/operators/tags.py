"""Tags of articles: the tag table, the bridge, and both directions of reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.columns import strip
from gleaner.operators.keys import EXACT, collated, first_spellings, new_ids, reading_order, without_known


def split_tags(tag: Column) -> Column:
    """Tag names of a comma list; empty names count except those after the last name."""
    kept = F.regexp_replace(tag, ",+$", "")
    return F.when((strip(tag) != "") & (kept != ""), F.split(kept, ",")).otherwise(
        F.array().cast("array<string>")
    )


def article_tag_names(articles: DataFrame) -> DataFrame:
    """One row per tag name of each article (``cuid, tag``, one row each) with its place; repeats are dropped."""
    names = F.array_distinct(split_tags(F.col("tag")))
    return articles.select("cuid", F.posexplode(names).alias("pos", "tagname"))


def unknown_tags(articles: DataFrame, articletags: DataFrame, equality: str = EXACT) -> DataFrame:
    """Tag rows for the names of the articles that are not known, numbered by first appearance.

    Names equal under the collation ``equality`` are one tag, spelled as it appears first.
    """
    order = reading_order("cuid", F.col("pos"))
    seen = article_tag_names(articles).groupBy("tagname").agg(F.min(order).alias("_first"))
    unknown = without_known(first_spellings(seen, ["tagname"], "_first", equality), articletags, ["tagname"], equality)
    return new_ids(unknown, articletags, "tid", [F.col("_first")]).select("tid", "tagname")


def upsert_tags(articles: DataFrame, articletags: DataFrame, equality: str = EXACT) -> DataFrame:
    """The tag table with the unknown names of the articles."""
    return articletags.select("tid", "tagname").unionByName(unknown_tags(articles, articletags, equality))


def missing_pairs(articles: DataFrame, articletags: DataFrame, contenttags: DataFrame, equality: str = EXACT) -> DataFrame:
    """Bridge rows for the tags of articles that are not there yet; ``articletags`` already holds all names.

    Under a collation an article that spells a tag in two ways has it once, and of tags
    that became equal the one with the lowest id counts.
    """
    names = article_tag_names(articles)
    if equality == EXACT:
        pairs = names.join(articletags.select("tid", "tagname"), "tagname").select("cuid", "tid", "pos")
    else:
        (name,) = collated(articletags, ["tagname"], equality)
        known = articletags.groupBy(name.alias("_same")).agg(F.min("tid").alias("tid"))
        (name,) = collated(names, ["tagname"], equality)
        pairs = names.select("cuid", "pos", name.alias("_same")).join(known, "_same").groupBy("cuid", "tid").agg(F.min("pos").alias("pos"))
    fresh = pairs.join(contenttags.select("cuid", "tid"), ["cuid", "tid"], "left_anti")
    return new_ids(fresh, contenttags, "ctid", [F.col("cuid"), F.col("pos")]).select("ctid", "tid", "cuid")


def upsert_bridge(articles: DataFrame, articletags: DataFrame, contenttags: DataFrame, equality: str = EXACT) -> DataFrame:
    """The article-tag bridge with the pairs not there yet."""
    return contenttags.select("ctid", "tid", "cuid").unionByName(missing_pairs(articles, articletags, contenttags, equality))


def tags_of_articles(contenttags: DataFrame, articletags: DataFrame) -> DataFrame:
    """Articles and their tags through the bridge."""
    return contenttags.select("cuid", "tid").join(articletags.select("tid", "tagname"), "tid").select("cuid", "tid", "tagname")


def tag_strings(contenttags: DataFrame, articletags: DataFrame) -> DataFrame:
    """Tags of each article as one comma text, by tag id."""
    named = tags_of_articles(contenttags, articletags)
    listed = named.groupBy("cuid").agg(F.sort_array(F.collect_list(F.struct("tid", "tagname"))).alias("_tags"))
    return listed.select("cuid", F.array_join("_tags.tagname", ",").alias("tags"))


def tag_lists(contenttags: DataFrame, articletags: DataFrame) -> DataFrame:
    """Tags of each article as a list of id and name, by tag id."""
    named = tags_of_articles(contenttags, articletags)
    tag = F.struct(F.col("tid").alias("tagid"), "tagname")
    return named.groupBy("cuid").agg(F.sort_array(F.collect_list(tag)).alias("tags"))
