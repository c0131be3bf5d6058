"""Checks of the JSON rules kept with a site.

Every check takes the name of a rule column and gives a column: ``''`` when the
rule is good, else what is wrong. Rules are read as variants, because the type
of a member decides: a missing member takes its default, a member of the wrong
type (null included) is an error. A rule is parsed once per check, bound to ``d``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The fields of an article; the first two are required.
REQUIRED_FIELDS = ("content", "title")
FIELDS = REQUIRED_FIELDS + ("author", "postdate", "tag", "titleimage")

_BLANKS = "'" + "".join(f"\\u{code:04x}" for code in range(33)) + "'"


def _strip(text: str) -> str:
    return f"btrim({text}, {_BLANKS})"


def _kind(key: str) -> str:
    return f"schema_of_variant(try_variant_get(d, '$.{key}', 'variant'))"


def _is_text(key: str) -> str:
    return f"coalesce({_kind(key)}, 'STRING') = 'STRING'"


def _text(key: str) -> str:
    return f"coalesce(try_variant_get(d, '$.{key}', 'string'), '')"


def _is_int(key: str) -> str:
    number = f"try_variant_get(d, '$.{key}', 'double')"
    return (
        f"({_kind(key)} IS NULL OR coalesce({_kind(key)} RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' "
        f"AND {number} = floor({number}) AND {number} BETWEEN -2147483648 AND 2147483647, false))"
    )


def _int(key: str) -> str:
    return f"CAST(coalesce(try_variant_get(d, '$.{key}', 'double'), 0) AS BIGINT)"


def _is_path(text: str) -> str:
    """Whether a JSON path is made of steps, each an operator and a name."""
    steps = f"split({text}, ' ')"
    return f"(size({steps}) % 2 = 0 AND forall(filter({steps}, (s, i) -> i % 2 = 0), s -> s IN ('|', '||')))"


def _of_document(column: str, text: str) -> str:
    return f"transform(array(try_parse_json({column})), d -> {text})[0]"


def _fault(column: str, good: str, message: str) -> str:
    """NULL for a good rule, else the message."""
    return f"CASE WHEN NOT coalesce({_of_document(column, f'd IS NOT NULL AND {good}')}, false) THEN '{message}' END"


def _both(parts: list[str]) -> str:
    return " AND ".join(parts)


def _urlformat(column: str) -> str:
    url, first, last = _text("url"), _int("numfirst"), _int("numlast")
    good = _both(
        [
            _is_text("url"),
            _is_int("numfirst"),
            _is_int("numlast"),
            f"contains({url}, '<num>')",
            f"(startswith({url}, 'http://') OR startswith({url}, 'https://'))",
            f"CASE WHEN {_is_int('numfirst')} AND {_is_int('numlast')} THEN {first} >= 0 AND {last} >= 0 END",
        ]
    )
    return _fault(column, good, "urlformat rule is not valid")


def _listjson(column: str) -> str:
    good = f"{_is_text('contenturl')} AND {_is_path(_strip(_text('contenturl')))}"
    return _fault(column, good, "listjson rule is not valid")


def _listhtml(column: str) -> str:
    good = _both([f"{_is_text(key)} AND {_text(key)} <> ''" for key in ("list", "contenturl")])
    return _fault(column, good, "listhtml rule is not valid")


def _contentjson(column: str) -> str:
    def field(key: str) -> str:
        path = _strip(_text(key))
        optional = "" if key in REQUIRED_FIELDS else f"{path} = '' OR "
        return f"{_is_text(key)} AND ({optional}{_is_path(path)})"

    return _fault(column, _both([field(key) for key in FIELDS]), "contentjson rule is not valid")


def _contenthtml(column: str) -> str:
    good = [_is_text(key) for key in FIELDS] + [f"{_text(key)} <> ''" for key in REQUIRED_FIELDS]
    return _fault(column, _both(good), "contenthtml rule is not valid")


def _wxconfig(column: str) -> str:
    good = _both(
        [
            _is_text("keyword"),
            f"{_text('keyword')} <> ''",
            f"CASE WHEN {_is_int('contenttype')} THEN {_int('contenttype')} IN (0, 1) END",
        ]
    )
    return _fault(column, good, "wxconfig rule is not valid")


def _error(*faults: str) -> Column:
    return F.expr(f"coalesce({', '.join(faults)}, '')")


def urlformat_error(column: str = "urlformat") -> Column:
    """List URL template: ``url`` with ``<num>``, http or https, page numbers not negative."""
    return _error(_urlformat(column))


def urlformat_parts(column: str = "urlformat") -> Column:
    """Template, first and last page number of a good list URL rule, as a struct."""
    parts = f"named_struct('url', {_text('url')}, 'first', {_int('numfirst')}, 'last', {_int('numlast')})"
    return F.expr(_of_document(column, parts))


def listjson_error(column: str = "listjson") -> Column:
    """JSON list rule: the path of the article links."""
    return _error(_listjson(column))


def listhtml_error(column: str = "listhtml") -> Column:
    """HTML list rule: selectors of the list and of the links in it."""
    return _error(_listhtml(column))


def contentjson_error(column: str = "contentjson") -> Column:
    """JSON article rule: required and optional paths."""
    return _error(_contentjson(column))


def contenthtml_error(column: str = "contenthtml") -> Column:
    """HTML article rule: required and optional selectors."""
    return _error(_contenthtml(column))


def wxconfig_error(column: str = "wxconfig") -> Column:
    """Account rule: a keyword and a content type of 0 or 1."""
    return _error(_wxconfig(column))


def wxconfig_contenttype(column: str = "wxconfig") -> Column:
    """Content type of a good account rule."""
    return F.expr(_of_document(column, _int("contenttype")))


def _one_of(left: str, right: str) -> str:
    one = f"({_strip(left)} <> '') <> ({_strip(right)} <> '')"
    return f"CASE WHEN NOT ({one}) THEN 'needs one of {left} and {right}' END"


def _if_given(column: str, fault: str) -> str:
    return f"CASE WHEN {_strip(column)} <> '' THEN {fault} END"


def site_error() -> Column:
    """The first thing wrong with a site's rules, in the order they are needed."""
    return _error(
        "CASE WHEN urlformat = '' THEN 'urlformat is empty' END",
        _urlformat("urlformat"),
        _one_of("listjson", "listhtml"),
        _if_given("listjson", _listjson("listjson")),
        _if_given("listhtml", _listhtml("listhtml")),
        _one_of("contentjson", "contenthtml"),
        _if_given("contentjson", _contentjson("contentjson")),
        _if_given("contenthtml", _contenthtml("contenthtml")),
    )


def account_error() -> Column:
    """What is wrong with an account site's rule."""
    return _error("CASE WHEN wxconfig = '' THEN 'wxconfig is empty' END", _wxconfig("wxconfig"))
