"""What the two joins share: union-find inside a task, and classes from its results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.llm.components import components


class Forest:
    """Union-find over 0..n-1; a root is the least of its set."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, many: np.ndarray) -> None:
        roots = {self.find(int(j)) for j in many}
        roots.add(self.find(i))
        least = min(roots)
        for r in roots:
            self.up[r] = least

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def classes(groups: DataFrame, found: DataFrame) -> DataFrame:
    """groups with class and links.

    groups: rows with rep (their least id, unique) and copies. found: rows (rep, links, root), the
    links that a task has counted for a representative, weighted by copies, and one that it
    can reach. A representative's links are the sum of these and its other copies.
    """
    reach = components(found, "rep", "root")
    links = found.groupBy(F.col("rep").alias("node")).agg(F.sum("links").alias("n"))
    known = links.join(reach, "node", "left")
    joined = groups.join(known, F.col("rep") == F.col("node"), "left")
    return joined.select(*groups.columns, F.coalesce("component", "rep").alias("class"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
