"""Column names and the small descriptions that go with edge tables.

A pattern matrix is a table of (row, col); a graph is a table of edges (u, v).
Ids are 0-based longs.  Nothing here is ever materialised as a compressed matrix:
row slices, degrees and neighbourhoods are filters and aggregations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

COO = StructType([StructField("row", LongType()), StructField("col", LongType())])
EDGE = StructType([StructField("u", LongType()), StructField("v", LongType())])


@dataclass(frozen=True)
class Matrix:
    """Entries (row, col) of a 0/1 matrix and its shape."""

    entries: DataFrame
    numrows: int
    numcols: int


@dataclass(frozen=True)
class GeneratedGraph:
    """A generator's edge multiset (u, v) over the vertices 0 .. 2**scale - 1."""

    edges: DataFrame
    scale: int
    edgefactor: int

    @property
    def vertices(self) -> DataFrame:
        return self.edges.sparkSession.range(1 << self.scale)


@dataclass(frozen=True)
class BuiltGraph:
    """Symmetric edges (src, dst, owner), vertices (id, owner) and the number of parts."""

    edges: DataFrame
    vertices: DataFrame
    parts: int
