"""A spatial index as a table of items with their bounding boxes and the cells that those meet."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.operators import spatial


@dataclass(frozen=True)
class SpatialIndex:
    """items: any columns with minx, miny, maxx, maxy. Changing an index gives another one."""

    items: DataFrame
    size_of_cell: float = 1.0

    @classmethod
    def new(cls, spark: SparkSession, schema: str, size_of_cell: float = 1.0) -> SpatialIndex:
        return cls(spark.createDataFrame([], f"{schema}, minx double, miny double, maxx double, maxy double"), size_of_cell)

    @classmethod
    def of(cls, df: DataFrame, shape: str, size_of_cell: float = 1.0) -> SpatialIndex:
        return cls(spatial.with_bounds(df, shape), size_of_cell)

    def insert(self, rows: DataFrame) -> SpatialIndex:
        return replace(self, items=self.items.unionByName(rows))

    def remove(self, keys: DataFrame, key: str) -> SpatialIndex:
        return replace(self, items=self.items.join(keys, key, "left_anti"))

    def size(self) -> int:
        return self.items.count()

    insert_all = insert

    def clear(self) -> SpatialIndex:
        return replace(self, items=self.items.limit(0))

    def bounds(self) -> DataFrame:
        """minx, miny, maxx, maxy of all items: one row, of nulls if there are none."""
        return self.items.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))

    def query_radius(self, x: float, y: float, radius: float) -> DataFrame:
        """The items whose boxes come within the radius of a point, with dist."""
        dx = F.greatest(F.col("minx") - x, x - F.col("maxx"), F.lit(0.0))
        dy = F.greatest(F.col("miny") - y, y - F.col("maxy"), F.lit(0.0))
        near = self.query(x - radius, y - radius, x + radius, y + radius)
        return near.withColumn("dist", F.hypot(dx, dy)).filter(F.col("dist") <= radius)

    def get_cell(self, x: float, y: float) -> DataFrame:
        """The items whose boxes meet the point's cell of the grid."""
        size = self.size_of_cell
        west, south = x // size * size, y // size * size
        return self.items.filter((F.col("maxx") >= west) & (F.col("minx") < west + size) & (F.col("maxy") >= south) & (F.col("miny") < south + size))

    def query(self, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
        """The items whose boxes meet this one."""
        return spatial.bbox_query(self.items, minx, miny, maxx, maxy)

    def query_point(self, x: float, y: float) -> DataFrame:
        return spatial.query_point(self.items, x, y)

    def nearest(self, x: float, y: float, n: int, key: str) -> DataFrame:
        """The n items whose boxes' centres are nearest, with dist."""
        centred = self.items.withColumn("_x", (F.col("minx") + F.col("maxx")) / 2).withColumn("_y", (F.col("miny") + F.col("maxy")) / 2)
        return spatial.nearest(centred, x, y, n, key, "_x", "_y").drop("_x", "_y")

    def join(self, other: SpatialIndex) -> DataFrame:
        """Pairs of items whose boxes meet; columns of the other get the suffix _b."""
        return spatial.box_join(self.items, other.items, self.size_of_cell)

    def written(self, path: str) -> None:
        """As Parquet in the order of cells, so that a query reads few row groups."""
        cells = self.items.withColumn("_cx", spatial.cell(F.col("minx"), self.size_of_cell)).withColumn("_cy", spatial.cell(F.col("miny"), self.size_of_cell))
        cells.repartitionByRange("_cx", "_cy").sortWithinPartitions("_cx", "_cy").drop("_cx", "_cy").write.mode("overwrite").parquet(path)


#: One table serves for all kinds of index: boxes reach the scan, and joins go by cells.
RTree = QuadTree = STRTree = GridIndex = SpatialIndex
