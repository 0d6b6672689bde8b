"""Connected components of a table of links, by label propagation with pointer jumping.

Each round every node takes the smallest label among its own, its neighbours' and the label of its
label, and the table is written to the shared folder.  Links of one node are combined before the shuffle; the join that hands
labels along links is skew-split by adaptive execution.  Nothing but the count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.files import saved, scratch


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (a, b); component is the smallest id reachable."""
    both = saved(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        with scratch(links.sparkSession):
            heard = both.join(labels, both["b"] == labels["id"]).select(F.col("a").alias("id"), "component")
            jump = labels.select(F.col("component").alias("via"), "id").join(labels.select(F.col("id").alias("via"), "component"), "via").select("id", "component")
            told = heard.unionAll(jump).groupBy("id").agg(F.min("component").alias("heard"))
            after = labels.join(told, "id").select("id", F.least("component", "heard").alias("component"), (F.col("heard") < F.col("component")).alias("changed"))
            after = saved(after, "labels", outlives=True)
        labels = after.select("id", "component")
        if after.where("changed").isEmpty():
            return labels
