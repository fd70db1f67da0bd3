"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidegrid.operators import graph


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the smallest node reachable.

    By the library's random contraction, whose rounds grow with the logarithm of the nodes, on long chains too, and are
    tables in the shared folder.
    """
    return graph.components(links)
