"""Keys of the label layers: SHA-256 over all that a labeller was shown. Give them NFKC text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.cleaners import raw_name
from ..functions.text import override_text, squeeze

# Separators of parts, of a list's items and of lists; versions of the layers' instructions.
PART, ITEM, LIST = "\x1f", "\x1e", "\x1d"
VERSIONS = {"sentiment": "sentiment-v1", "product": "product-name-v1", "excerpt": "excerpt-v2-rewrite", "picks": "comment-picks-v3-aspect-coverage", "category": "product-category-v1", "grounding": "grounding-v1"}


def _key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(PART, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def _plain(text: Column) -> Column:
    return squeeze(F.coalesce(text, F.lit("")))


def _items(texts: Column) -> Column:
    return F.array_join(F.transform(texts, _plain), ITEM)


def sentiment_key(source: Column, tag: Column, text: Column) -> Column:
    """The legacy key of a comment: no context, no account."""
    return _key(F.trim(source), F.trim(tag), override_text(F.coalesce(text, F.lit(""))))


def sentiment_key_v2(source: Column, tag: Column, text: Column, brand: Column, product: Column, title: Column, version: str = VERSIONS["sentiment"]) -> Column:
    normal = lambda c: override_text(F.coalesce(c, F.lit("")))
    return _key(F.trim(source), F.trim(tag), normal(text), F.trim(brand), normal(product), normal(title), F.lit(version))


def product_key(brand: Column, title: Column, raw: Column) -> Column:
    return _key(F.trim(brand), raw_name(title), raw_name(raw))


def product_key_v2(brand: Column, title: Column, raw: Column, guess: Column, version: str = VERSIONS["product"]) -> Column:
    return _key(F.trim(brand), raw_name(title), raw_name(raw), raw_name(guess), F.lit(version))


def rule_guess(items: Column) -> Column:
    """How a labeller is shown what the rules found: array<struct<name, price>> as ``name | price`` lines."""
    return F.array_join(F.transform(items, lambda i: F.concat(i["name"], F.lit(" | "), F.coalesce(i["price"].cast("string"), F.lit("")))), "\n")


def excerpt_key(post: Column, product: Column, review: Column) -> Column:
    return _key(_plain(post), _plain(product), _plain(review))


def excerpt_key_v2(post: Column, product: Column, review: Column, brand: Column, others: Column, candidates: Column, version: str = VERSIONS["excerpt"]) -> Column:
    return _key(_plain(post), _plain(product), _plain(review), _plain(brand), _plain(others), _items(candidates), F.lit(version))


def picks_key(brand: Column, product: Column, comments: Column, body: Column, others: Column, version: str = VERSIONS["picks"]) -> Column:
    return _key(_plain(brand), _plain(product), F.concat_ws(LIST, _items(comments), _items(body)), _plain(others), F.lit(version))


def category_key(brand: Column, product: Column, version: str = VERSIONS["category"]) -> Column:
    return _key(_plain(brand), _plain(product), F.lit(version))


def grounding_key(rewrite: Column, source: Column, version: str = VERSIONS["grounding"]) -> Column:
    return _key(_plain(rewrite), _plain(source), F.lit(version))
