"""Page curation on Spark: rules, links, fields, bodies, tags, listings."""
