"""Article ids in free text, and the status of downloaded bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = "[()\\[\\]{}.!?:\"'`<>]+"


def article_ids(text: Column, most: int) -> Column:
    """Digits of the PMC ids in a text, in order of first sight, at most `most`: tokens between blanks, commas and
    semicolons, stripped of enclosing punctuation, that are PMC (any case) and 1 to 12 ASCII digits, not zero."""
    tokens = F.split(text, "[ ,;\\n\\r\\t]+")
    bare = F.transform(tokens, lambda t: F.upper(F.regexp_replace(F.regexp_replace(t, "^" + _EDGE, ""), _EDGE + "$", "")))
    numbers = F.transform(F.filter(bare, lambda t: t.rlike("^PMC[0-9]{1,12}$")), lambda t: F.substring(t, 4, 12).cast("long"))
    return F.slice(F.array_distinct(F.transform(F.filter(numbers, lambda n: n > 0), lambda n: n.cast("string"))), 1, most)


def article_name(digits: Column) -> Column:
    """PMC and the digits without leading zeros; null for anything but digits."""
    return F.when(digits.rlike("^[0-9]+$"), F.concat(F.lit("PMC"), digits.cast("long").cast("string")))


def summary_line(*fields: Column) -> Column:
    """Fields joined by ' | ', null and empty ones shown as '?'."""
    return F.concat_ws(" | ", *[F.coalesce(F.nullif(f.cast("string"), F.lit("")), F.lit("?")) for f in fields])


def body_status(body: Column, is_article: Column) -> Column:
    """The status of a downloaded body, the first that holds: a whole article is ok whatever words it holds;
    error phrases count only among the first 2,048 characters."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 2048))
    says = lambda *words: F.greatest(*[head.contains(w) for w in words], F.lit(False))
    return (
        F.when(F.coalesce(body, F.lit("")) == "", "invalid(empty_body)").when(is_article, "ok").when(says("rate limit exceeded", "too many requests"), "rate_limited")
        .when(says("503 service unavailable", "502 bad gateway", "500 internal server error"), "retryable(server_unavailable)").when(says("<html", "<!doctype html"), "invalid(http_error_page)")
        .otherwise("invalid(malformed_or_nonarticle_xml)")
    )


def json_status(body: Column, kind: Column) -> Column:
    """The status of a downloaded JSON body, `kind` being search or summary, the first that holds: error phrases among the
    first 2,048 characters as for articles, then what the JSON holds."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 2048))
    says = lambda *words: F.greatest(*[head.contains(w) for w in words], F.lit(False))
    tree = F.try_parse_json(body)
    kind_of = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(tree, path, "variant")), F.lit(""))
    has = lambda path: F.try_variant_get(tree, path, "variant").isNotNull()
    is_list = lambda path: kind_of(path).startswith("ARRAY")
    return (
        F.when(F.coalesce(body, F.lit("")) == "", "invalid(empty_body)").when(says("rate limit exceeded", "too many requests"), "rate_limited")
        .when(says("503 service unavailable", "502 bad gateway", "500 internal server error"), "retryable(server_unavailable)").when(says("<html", "<!doctype html"), "invalid(http_error_page)")
        .when(tree.isNull(), "invalid(malformed_json)").when(has("$.error"), "invalid(api_error)")
        .when(((kind == "search") & is_list("$.esearchresult.idlist")) | ((kind == "summary") & is_list("$.result.uids")), "ok").otherwise("invalid(unexpected_json_shape)")
    )
