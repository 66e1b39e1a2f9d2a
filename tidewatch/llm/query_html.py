"""op10: main text of all pages; wrappers have no SQL form, so it is tested on built pages and against
a plain parse of the test pages."""

from pyspark.sql import functions as F

from tidewatch.llm import html
from tidewatch.llm.base import query, table


@query("op10_html")
def op10_html(spark, sf):
    out = html.extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
