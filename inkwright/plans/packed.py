"""Query of problem 3."""

from inkwright.operators.packed import tag_rows
from inkwright.plans.registry import CORE
from inkwright.sources.tables import table


@CORE.query("p3_found")
def p3_found(spark, sf_dir):
    return tag_rows(table(spark, sf_dir, "papers", "id", "tags"), table(spark, sf_dir, "pdf_upload_sessions", "id", "tags"))
