"""HTML cards as a table function: ``SELECT p.page_id, c.* FROM pages p, LATERAL html_cards(p.html, 'nav li', ...) c``.

The columns are what the selectors are called, so they are known when the query is analysed.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillon.sources.listings import Selector, card_items

#: Columns that every call has besides its selectors'.
OWN = ("position", "text", "attributes", "error")


def _constant(argument: AnalyzeArgument, what: str) -> str:
    if not argument.isConstantExpression or not isinstance(argument.value, str):
        raise ValueError(f"{what} must be a constant string")
    return argument.value


def _named(written: str) -> dict[str, Selector]:
    try:
        found = json.loads(written)
    except ValueError as e:
        raise ValueError(f"selectors must be a JSON object of names and selectors: {e}") from None
    if not isinstance(found, dict) or not all(isinstance(v, str) for v in found.values()) or set(found) & set(OWN):
        raise ValueError(f"selectors must be a JSON object of names (other than {', '.join(OWN)}) and selectors")
    return {k: Selector.parse(v) for k, v in found.items()}


class HtmlCards:
    """html_cards(html, card, selectors): for each element that ``card`` finds its position, what each selector of the
    JSON object ``selectors`` finds in it (a column each, null for nothing), its text, and a map of its attributes
    (``attr.*``) and of all data attributes in it (``data.*``). A page without cards, or null, gives one row with an
    error."""

    @staticmethod
    def analyze(html: AnalyzeArgument, card: AnalyzeArgument, selectors: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(html.dataType, StringType):
            raise ValueError("html must be a string")
        Selector.parse(_constant(card, "card"))
        schema = StructType().add("position", IntegerType())
        for name in _named(_constant(selectors, "selectors")):
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema.add("text", StringType()).add("attributes", MapType(StringType(), StringType())).add("error", StringType()))

    def __init__(self):
        self.parsed = None

    def eval(self, html: str, card: str, selectors: str):
        if self.parsed is None:  # constants: the same for all rows
            self.parsed = Selector.parse(card), _named(selectors)
        item, named = self.parsed
        at = -1
        for at, found in enumerate(card_items(html, item, named)):
            rest = {k: v for k, v in found.items() if k.startswith(("attr.", "data.")) and k not in named}
            yield (at, *(found.get(k) for k in named), found["_text"], rest, None)
        if at < 0:
            yield (None, *(None for _ in named), None, None, "no card found")


def register(spark: SparkSession) -> None:
    """Makes html_cards known to the session's SQL; rows go to Python in Arrow batches."""
    spark.udtf.register("html_cards", udtf(HtmlCards, useArrow=True))
