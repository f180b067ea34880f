"""Tables of a folder that change by owner: each commit is a generation, and the newest complete one that spoke of an owner holds its rows.

A commit writes its tables and who they speak of, then one row in ``commits``.  Until that row is there, readers see what was
before, and a commit that failed is overwritten by the next one, which has its number.  Nothing is
rewritten, so a change costs what its owners' rows cost.  One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts and vectors take about two thirds of the disk that the default codec needs.
CODEC = "zstd"


class Versions:
    """``owner`` is the column that says whose a row is."""

    def __init__(self, spark: SparkSession, folder: str, owner: str = "paper_id") -> None:
        self.spark, self.folder, self.owner = spark, folder.rstrip("/"), owner

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, gen int").parquet(f"{self.folder}/{name}")
        except AnalysisException as absent:
            if absent.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, gen int")

    def commits(self) -> DataFrame:
        return self._read("commits", "at timestamp, label string")

    def last(self) -> int:
        """The newest complete generation, -1 where there is none."""
        found = self.commits().agg(F.max("gen")).first()[0]
        return -1 if found is None else found

    def found(self, label: str) -> int | None:
        """The complete generation of that label."""
        row = self.commits().where(F.col("label") == label).agg(F.min("gen").alias("gen")).first()
        return row["gen"]

    def all(self, name: str, schema: str) -> DataFrame:
        """Rows of all complete generations, with ``gen``."""
        return self._read(name, schema).join(F.broadcast(self.commits().select("gen").distinct()), "gen", "left_semi")

    def table(self, name: str, schema: str, after: int = -1) -> DataFrame:
        """The rows that count now: all but those of generations whose owner a later one spoke of, which are few against the rows.

        With ``after`` only those that came after that generation; folders of others are not read.
        """
        spoke = self.all("owners", f"table_name string, {self.owner} string").where(F.col("table_name") == name)
        newest = spoke.groupBy(self.owner).agg(F.max("gen").alias("newest"), F.count("*").alias("times")).where("times > 1")
        old = spoke.join(newest, self.owner).where("gen < newest").select(self.owner, "gen")
        rows = self.all(name, schema).where(F.col("gen") > after)
        if not old.isEmpty():  # else the rows would be shuffled for nothing
            rows = rows.join(old, [self.owner, "gen"], "left_anti")
        return rows.select(*[c for c in rows.columns if c != "gen"])

    def write(self, gen: int, name: str, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Writes a table's rows of a generation and gives them; no reader of tables sees them before the commit."""
        at = f"{self.folder}/{name}/gen={gen}"
        rows.write.mode("overwrite").option("compression", CODEC).partitionBy(*(by or [])).parquet(at)
        return self.spark.read.parquet(at)

    def commit(self, gen: int, tables: dict[str, tuple[DataFrame | None, DataFrame]], label: str | None = None, by: dict[str, list[str]] | None = None) -> None:
        """Writes, for each table, the rows and the owners that have exactly these rows from now on (none: they are gone).

        Where ``write`` has written the rows, None stands for them.
        A ``label`` names what was committed, so that whoever repeats it can see that it is there; ``by`` names the columns that a table's folders are by.
        """
        owners = None
        for name, (rows, own) in tables.items():
            if rows is not None:
                self.write(gen, name, rows, (by or {}).get(name))
            one = own.select(F.lit(name).alias("table_name"), F.col(self.owner).cast("string").alias(self.owner)).distinct()
            owners = one if owners is None else owners.unionByName(one)
        owners.write.mode("overwrite").parquet(f"{self.folder}/owners/gen={gen}")
        self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(label).cast("string").alias("label")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/gen={gen}")

    def staged(self, gen: int, name: str, rows: DataFrame) -> DataFrame:
        """Rows written down for the steps of one commit; readers of tables never see them."""
        return self.write(gen, f"staging/{name}", rows)

    def used_up(self, gen: int, name: str) -> None:
        """Frees the disk of staged rows that no later step reads: no rows are written in their place."""
        at = f"{self.folder}/staging/{name}/gen={gen}"
        self.spark.createDataFrame([], self.spark.read.parquet(at).schema).write.mode("overwrite").parquet(at)
