"""Connected components of a link table, by hooking and contraction.

Every node hooks to its smallest neighbour, the resulting forest is flattened
by pointer jumping, and links are rewritten between roots until none is left.
Links and labels stay tables; each step is written to the shared folder, so a
lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_stage


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in ``links(a, b)``; comp is the smallest id of
    its component.  Null ends are ignored."""
    edges = links.select("a", "b").filter("a <> b")
    labels = None
    while True:
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(
            edges.select(F.col("b").alias("id"), F.col("a").alias("to"))
        )
        hooks = write_stage(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("comp")), "cc-hooks")
        if hooks.isEmpty():
            return hooks if labels is None else labels
        while True:  # flatten: comp becomes the root
            up = hooks.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
            flat = write_stage(
                hooks.join(up, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"), (F.col("root") < F.col("comp")).alias("moved")),
                "cc-flat",
            )
            hooks = flat.select("id", "comp")
            if flat.filter("moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
            labels = write_stage(labels.join(up, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "cc-labels")
        end = lambda c: hooks.select(F.col("id").alias(c), F.col("comp").alias(f"root_{c}"))  # noqa: B023, E731
        edges = write_stage(
            edges.join(end("a"), "a").join(end("b"), "b").filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(),
            "cc-edges",
        )
        if edges.isEmpty():
            return labels
