"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Links for each file of labels, where there are more than the cores write at once.
FILE_LINKS = 100_000


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b); the label is the least id that it reaches.

    First every id is tied to its least lower neighbour, and its other lower
    neighbours to that one too: what an id is linked with many times over becomes
    about one link.  Then each round takes the least label among the neighbours
    and that label's own label, so the rounds grow with the logarithm of a
    component's width.  Labels are aggregated before they are shuffled, nothing
    is collected by group.  Each round's labels are written, in as few files as
    there are cores or the links call for: an id has one row, so that no file is
    larger than others, and small labels are broadcast to the next round.
    """
    files = max(links.sparkSession.sparkContext.defaultParallelism, -(-links.count() // FILE_LINKS))
    pairs = links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    tied = written(pairs, files)
    root = tied.groupBy("high").agg(F.min("low").alias("root"))
    ends = F.explode(F.array("low", "high")).alias("b")
    star = tied.join(root, "high").select(F.col("root").alias("a"), ends).where("a <> b").distinct()
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    edges = written(star.select(both).select("e.a", "e.b"), files)
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), files)
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        roots = labels.select(F.col("id").alias("low"), F.col("label").alias("root"))
        new = written(lower.join(roots, "low", "left").select("id", F.least("low", F.coalesce("root", "low")).alias("label"), "old"), files)
        labels = new.select("id", "label")
        if new.where("label != old").isEmpty():
            return labels
