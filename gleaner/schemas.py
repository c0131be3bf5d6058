"""The state tables: columns, types, defaults.

No column holds NULL: a missing string is ``''``, a missing number 0 (except
the two site periods). Ids are ``bigint``, because a large collection has more
rows than an int can number; flags and epoch seconds stay ``int``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Values of ``status``.
WAITING, IN_PROGRESS, DONE, FETCH_FAILED, PARSE_FAILED = 0, 1, 2, 3, 4

_TEXT, _INT, _BIG = T.StringType(), T.IntegerType(), T.LongType()


def texts(*names: str) -> list[T.StructField]:
    """String fields, for the results of page readers."""
    return [T.StructField(name, _TEXT) for name in names]


IMAGES = T.ArrayType(T.StructType(texts("urlsrc", "urlabs")))


def _columns(ids: str = "", ints: str = "", texts: str = "") -> dict[str, T.DataType]:
    return {
        **{name: _BIG for name in ids.split()},
        **{name: _INT for name in ints.split()},
        **{name: _TEXT for name in texts.split()},
    }


# Column order of every table, then the types by group.
_ORDER = {
    "sites": "sid sitename siteurl entryurl urlformat isenable isweixin wxconfig isbrowser isscroll "
    "islocal listjson listhtml contentjson contenthtml interval schedule lastfetch parseerror listcreated",
    "listurls": "luid sid listurl source dateline lastupdate connectcount parsecount isfirst isenable "
    "status connecterror parseerror duration",
    "contenturls": "cuid luid sid url source postdate dateline lastupdate title author extrainfo contenttext "
    "contentsource contentabsurl contentlocalurl titleimageid indexfinish imagefinish status connecterror "
    "parseerror duration",
    "images": "imgid cuid sid urlabs urlsrc dateline lastupdate path filename size status connecterror duration",
    "articletags": "tid tagname",
    "contenttags": "ctid tid cuid",
    "raw_pages": "url body connecterror duration fetched_at",
}
_TYPES = _columns(
    ids="sid luid cuid imgid tid ctid titleimageid size",
    ints="isenable isweixin isbrowser isscroll islocal interval schedule lastfetch listcreated dateline "
    "lastupdate connectcount parsecount isfirst status duration indexfinish imagefinish fetched_at",
    texts="sitename siteurl entryurl urlformat wxconfig listjson listhtml contentjson contenthtml parseerror "
    "listurl source connecterror url postdate title author extrainfo contenttext contentsource "
    "contentabsurl contentlocalurl urlabs urlsrc path filename tagname body",
)
_DEFAULTS = {"interval": 20, "schedule": 3600}

KEYS = {
    "sites": "sid",
    "listurls": "luid",
    "contenturls": "cuid",
    "images": "imgid",
    "articletags": "tid",
    "contenttags": "ctid",
    "raw_pages": "url",
}
STATE_TABLES = [name for name in KEYS if name != "raw_pages"]
SCHEMAS = {
    table: T.StructType([T.StructField(name, _TYPES[name]) for name in order.split()])
    for table, order in _ORDER.items()
}


def defaults(table: str) -> dict[str, object]:
    """The value of each column that was never set."""
    return {
        field.name: _DEFAULTS.get(field.name, "" if field.dataType == _TEXT else 0)
        for field in SCHEMAS[table].fields
    }
