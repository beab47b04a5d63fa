"""The main text of web pages (operator 13): trees of blocks (``html_tree``) judged by a graphical model (``content_model``)."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.batches import bound_batches
from tallyframe.llm.content_model import Model, train
from tallyframe.llm.html_tree import read_page
from tallyframe.llm.layouts import labelled_pages

# Labelled pages made by rule that train the default model.
LABELLED = 1000
# A forest holds pages of so many characters of markup together, and one page at least.
FOREST_CHARS = 1 << 20


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages(LABELLED))


def fit(labelled: DataFrame, html_col: str = "html", text_col: str = "text", most: int = 2000) -> Model:
    """Train on a table of pages with their known main text: the ``most`` pages of the smallest hashes of their markup.

    The bound keeps training on one machine. Rows with a null page or text are not used.
    """
    known = labelled.select(F.col(html_col).alias("html"), F.col(text_col).alias("text")).where("html IS NOT NULL AND text IS NOT NULL")
    rows = known.orderBy(F.sha2("html", 256), "text").limit(most).collect()
    return train([(row.html, row.text) for row in rows])


def main_texts(pages: list[str], model: Model) -> list[str]:
    """The main text of each page: runs of text that more likely than not are content, joined by empty lines."""
    read = [read_page(page) for page in pages]
    return [
        "\n\n".join(node.text for node, share in zip(page.nodes, content) if not node.tag and share > 0.5)
        for page, content in zip(read, model.marginals(read))
    ]


def extract(pages: DataFrame, html_col: str = "html", model: Model | None = None) -> DataFrame:
    """Add ``text``, the main text of each page, and ``n_chars``, its code points (both replace columns of the names).

    Blocks stand in page order, joined by two line feeds; character references are decoded, white space inside a block is
    one space. Scripts, styles, comments in the markup and form controls never count as text; menus, headers, footers,
    sidebars, notices, adverts, forms and reader comments are left out by the model. A null or empty page has an empty
    text; pages are read whole, whatever their length. Every row stays, with its other columns.
    """
    bound_batches(pages.sparkSession)
    chosen = model or default_model()

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for page in column:
            held.append(page)
            size += len(page)
            if size >= FOREST_CHARS:
                out += main_texts(held, chosen)
                held, size = [], 0
        return pd.Series(out + main_texts(held, chosen), dtype=object)

    return pages.withColumn("text", text_of(F.coalesce(html_col, F.lit("")))).withColumn(
        "n_chars", F.length("text").cast("bigint")
    )
