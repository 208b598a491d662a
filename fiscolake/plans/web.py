"""Stored web pages to the records the knowledge base reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fiscolake.operators.crawl import crawl, structured_pages
from fiscolake.sources.writers import write_json_lines

# Where the crawl of the tax portal begins, and its host suffix.
START_URL = "https://www.gov.br/receitafederal/pt-br/assuntos/meu-imposto-de-renda/"
HOST_SUFFIX = "gov.br"


def crawl_to_json(pages: DataFrame, out: str, start_url: str = START_URL,
                  host_suffix: str = HOST_SUFFIX) -> int:
    """Crawl the stored pages, extract main texts and write them as JSON lines.
    Returns the number of records."""
    return write_json_lines(structured_pages(crawl(pages, start_url, host_suffix)), out)
