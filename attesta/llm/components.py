"""Connected components, with steps written to the shared folder as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attesta.llm.common import written
from attesta.operators import components


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b); see attesta.operators.components."""
    return components.connected_components(edges, cut=lambda df: written(df, "edges"))
