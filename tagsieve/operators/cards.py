"""Records from listing pages: elements of class card in HTML, read with the parser of the standard library."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.functions.text import comma_tags

CARDS_A_PAGE = 24
#: Parts of tags that do not name a series. Fixed values.
NO_SERIES = ["1girl", "1boy", "hair", "eyes", "long", "short", "solo"]
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SCHEMA = "page long, name string, image string, tags string, card long"


class _Cards(HTMLParser):
    """Collects for each card the header text, its first span, the thumbnail and the text of the tag box."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.cards: list[dict] = []

    def _inside(self, role: str) -> bool:
        return any(r == role for _, r in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        classes = given.get("class", "").split()
        role = None
        if tag == "div" and "card" in classes:
            self.cards.append({"header": None, "span": None, "image": None, "box": None})
            role = "card"
        elif self._inside("card"):
            card = self.cards[-1]
            if tag == "div" and "card-header" in classes and card["header"] is None:
                card["header"], role = [], "header"
            elif tag == "span" and self._inside("header") and card["span"] is None:
                card["span"], role = [], "span"
            elif tag == "img" and given.get("alt") == "thumbnail" and card["image"] is None:
                card["image"] = given.get("src", "")
            elif tag == "div" and "alert-secondary" in classes and card["box"] is None:
                card["box"], role = [], "box"
        if tag not in _VOID:
            self.open.append((tag, role))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        for role in ("header", "span", "box"):
            if self._inside(role) and self.cards:
                self.cards[-1][role].append(data)


def _rows(page: int, html: str | None) -> list[tuple]:
    parser = _Cards()
    parser.feed(html or "")
    parser.close()
    out = []
    for k, card in enumerate(parser.cards):
        if card["header"] is None:
            continue
        parts = card["span"] if card["span"] is not None else card["header"]
        name = "".join(p.strip() for p in parts)
        if name:
            out.append((page, name, card["image"], " ".join(" ".join(card["box"] or []).split()), k))
    return out


def extract_cards(pages: DataFrame, base_url: str, rank_base: int = 0, source: str | None = None) -> DataFrame:
    """(name, series, tags, image_url, rank) of pages (page, html), and their source where it is given.

    Cards without a header or name are skipped but keep their place in the rank. Relative image paths get the base. The
    series is the first of the next three tags with at most four words and none of NO_SERIES inside.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for page, html in zip(f["page"], f["html"]) for r in _rows(page, html)]
            yield pd.DataFrame(rows, columns=["page", "name", "image", "tags", "card"])

    cards = pages.select(F.col("page").cast("long").alias("page"), "html").mapInPandas(read, SCHEMA)
    listed = comma_tags("tags")
    others = F.when(F.lower(F.get(listed, 0)) == F.lower("name"), F.slice(listed, F.lit(2), F.greatest(F.size(listed), F.lit(1)))).otherwise(listed)
    short = F.filter(F.slice(others, 1, 3), lambda t: (F.size(F.split(t, r"(?U)\s+")) <= 4) & ~t.rlike("|".join(NO_SERIES)))
    root = base_url.rstrip("/")
    image = F.when(F.coalesce("image", F.lit("")) == "", None).when(F.col("image").startswith("http"), F.col("image")).otherwise(F.concat(F.lit(root + "/"), F.regexp_replace("image", "^/+", "")))
    rank = (F.col("page") - 1) * CARDS_A_PAGE + F.col("card") + 1 + F.lit(rank_base)
    found = cards.select("name", F.get(short, 0).alias("series"), "tags", image.alias("image_url"), rank.alias("rank"))
    return found if source is None else found.withColumn("source", F.lit(source))
