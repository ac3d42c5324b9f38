"""A catalogue of features: versions, lineage and statistics in four Parquet tables.

The tables are metadata, one row for each feature, version or edge, so an update
writes a new copy of the table it changes.  Several writers may work at once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators.cleaning import feature_stats
from chronolith.operators.tables import upsert

SCHEMAS = {
    "features": "name string, entity string, description string, owner string, feature_type string, created_date double, is_archived boolean",
    "feature_versions": "version_id long, feature_name string, version int, created_date double, is_active boolean, schema_json string, run_id string",
    "lineage": "version_id long, source_type string, source_name string",
    "statistics": "version_id long, column string, missing_rate double, iv_score double, n_unique long, mean double, std double, min_value double, max_value double, p50 double, p95 double, computed_at double",
}


class FeatureStore:
    """The catalogue below ``path``, a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str, wait: float = 60.0):
        self.spark, self.path, self.wait = spark, path.rstrip("/"), wait

    def _fs(self, path: str):
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(hadoop), at

    def _versions(self, name: str) -> list[int]:
        """Versions of a table that are written in whole."""
        fs, folder = self._fs(f"{self.path}/{name}")
        if not fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(folder)]
        return [int(n[1:]) for n in found if n.startswith("v") and fs.exists(self._fs(f"{self.path}/{name}/{n}/_SUCCESS")[1])]

    def table(self, name: str, at: int | None = None) -> DataFrame:
        """The newest version of a table, whoever wrote it."""
        at = max(self._versions(name), default=0) if at is None else at
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}/v{at}") if at else self.spark.createDataFrame([], SCHEMAS[name])

    def _claimed(self, fs, claim) -> bool:
        """Whether a claim that was free is this writer's.

        A file is made by one writer alone; where the store lets two by at the
        same moment, the one whose mark is left has it.
        """
        mark = uuid.uuid4().hex
        try:
            out = fs.create(claim, False)
            out.writeUTF(mark)
            out.close()
            time.sleep(0.1)
            held = fs.open(claim)
            own = held.readUTF() == mark
            held.close()
            return own
        except Py4JJavaError:
            # another writer was faster by a moment, or the store fails
            if not fs.exists(claim):
                raise
            return False

    def _change(self, name: str, make: Callable[[DataFrame], DataFrame]) -> None:
        """Write ``make`` of the newest version as the next one.

        Writers take turns: the next version's number is claimed by a file that one
        of them alone can create, and what is changed is read under the claim.  The claim of
        a writer that has not ended within ``wait`` seconds is passed over.
        """
        began, skipped = time.monotonic(), 0
        while True:
            newest = max(self._versions(name), default=0)
            number = newest + 1 + skipped
            fs, claim = self._fs(f"{self.path}/{name}/claim-{number}")
            fs.mkdirs(claim.getParent())
            if not fs.exists(claim) and self._claimed(fs, claim):
                break
            if time.monotonic() - began > self.wait:
                began, skipped = time.monotonic(), skipped + 1
            time.sleep(0.1)
        columns = self.spark.createDataFrame([], SCHEMAS[name]).columns
        try:
            made = make(self.table(name, newest))
            made.select(*columns).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/v{number}")
        except BaseException:
            # nothing was written: the number is free again
            fs.delete(claim, False)
            raise

    def _put(self, name: str, rows: Sequence[tuple], keys: Sequence[str]) -> None:
        self._change(name, lambda old: upsert(old, self.spark.createDataFrame(rows, SCHEMAS[name]), keys))

    # --- features and versions ---

    def register(self, name: str, entity: str, feature_type: str = "numeric", description: str = "", owner: str = "system", raw_columns: Sequence[str] = (), upstream: Sequence[str] = (), schema: dict | None = None, run_id: str | None = None) -> int:
        """Add or update a feature, with a new active version; returns the version's number."""
        self._put("features", [(name, entity, description, owner, feature_type, time.time(), False)], ["name"])
        version_id, version = self.create_version(name, schema, run_id)
        edges = [(version_id, "column", c) for c in raw_columns] + [(version_id, "feature", c) for c in upstream]
        if edges:
            self._put("lineage", edges, ["version_id", "source_type", "source_name"])
        self.activate(version_id)
        return version

    def create_version(self, name: str, schema: dict | None = None, run_id: str | None = None) -> tuple[int, int]:
        """``(version_id, version)`` of a new, inactive version."""
        made: list[int] = []

        def make(old: DataFrame) -> DataFrame:
            row = old.agg(F.coalesce(F.max("version_id"), F.lit(0)), F.coalesce(F.max(F.when(F.col("feature_name") == name, F.col("version"))), F.lit(0))).first()
            made[:] = row[0] + 1, row[1] + 1
            new = (*made[:1], name, made[1], time.time(), False, json.dumps(schema) if schema else None, run_id)
            return upsert(old, self.spark.createDataFrame([new], SCHEMAS["feature_versions"]), ["version_id"])

        self._change("feature_versions", make)
        return made[0], made[1]

    def activate(self, version_id: int) -> None:
        """Make one version the only active one of its feature."""

        def make(old: DataFrame) -> DataFrame:
            found = old.where(F.col("version_id") == version_id).first()
            if not found:
                raise ValueError(f"no version {version_id}")
            own = F.col("feature_name") == found["feature_name"]
            return old.withColumn("is_active", F.when(own, F.col("version_id") == version_id).otherwise(F.col("is_active")))

        self._change("feature_versions", make)

    def rollback(self, name: str, version: int) -> None:
        found = self.versions(name).where(F.col("version") == version).first()
        if not found:
            raise ValueError(f"{name} has no version {version}")
        self.activate(found["version_id"])

    def versions(self, name: str) -> DataFrame:
        return self.table("feature_versions").where(F.col("feature_name") == name).orderBy("version")

    def active(self, name: str):
        return self.versions(name).where("is_active").first()

    def archive(self, name: str) -> None:
        self.feature(name)
        self._change("features", lambda old: old.withColumn("is_archived", F.col("is_archived") | (F.col("name") == name)))

    def feature(self, name: str, version: int | None = None) -> dict:
        """A feature with one of its versions, the active one unless named; an unknown feature is a KeyError."""
        row = self.table("features").where(F.col("name") == name).first()
        if not row:
            raise KeyError(name)
        chosen = self.active(name) if version is None else self.versions(name).where(F.col("version") == version).first()
        return row.asDict() | {"version": chosen["version"] if chosen else None}

    def features(self, entity: str | None = None, archived: bool = False) -> DataFrame:
        found = self.table("features")
        found = found if archived else found.where("not is_archived")
        return (found.where(F.col("entity") == entity) if entity else found).orderBy("name")

    # --- lineage ---

    def _edges(self, all_versions: bool = False) -> DataFrame:
        versions = self.table("feature_versions")
        versions = versions if all_versions else versions.where("is_active")
        return self.table("lineage").join(versions.select("version_id", "feature_name"), "version_id").select(F.col("feature_name").alias("name"), "source_type", "source_name").distinct()

    def upstream(self, name: str, recursive: bool = False) -> list[str]:
        """Names a feature is made from, directly or through others."""
        return upstream(self._edges(), name, recursive)

    def downstream(self, name: str, all_versions: bool = False) -> list[str]:
        rows = self._edges(all_versions).where(F.col("source_name") == name).select("name").distinct().collect()
        return sorted(r[0] for r in rows)

    def has_cycle(self) -> bool:
        """Whether some feature is its own source: names without remaining sources go until none is left."""
        edges = {(r["name"], r["source_name"]) for r in self._edges().where("source_type = 'feature'").collect()}
        while edges:
            open_names = {a for a, _ in edges}
            left = {(a, b) for a, b in edges if b in open_names}
            if left == edges:
                return True
            edges = left
        return False

    # --- statistics ---

    def record_statistics(self, name: str, df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None) -> None:
        """Statistics of a feature's columns: the column of its name, else those that begin with it; ``iv_score`` needs a ``target``."""
        version = self.active(name)
        if not version:
            raise KeyError(name)
        columns = columns or ([name] if name in df.columns else [c for c in df.columns if c.startswith(name)])
        stats = feature_stats(df, columns, target).withColumns({} if target else {"iv_score": F.lit(None).cast("double")}).select(F.lit(version["version_id"]).cast("long").alias("version_id"), F.col("feature").alias("column"), "missing_rate", "iv_score", "n_unique", "mean", "std", "min_value", "max_value", "p50", "p95", F.lit(time.time()).alias("computed_at"))
        self._change("statistics", lambda old: upsert(old, stats, ["version_id", "column"]))


def upstream(edges: DataFrame, name: str, recursive: bool = False, max_depth: int = 100) -> list[str]:
    """Sources of ``name`` in an edge table (name, source_name), level by level; an error if there are more levels than ``max_depth``."""
    found: set[str] = set()
    frontier = [name]
    for _ in range(max_depth if recursive else 1):
        rows = edges.where(F.col("name").isin(frontier)).select("source_name").distinct().collect()
        frontier = [r[0] for r in rows if r[0] not in found]
        found.update(frontier)
        if not frontier:
            break
    else:
        if recursive:
            raise ValueError(f"the lineage of {name} is deeper than {max_depth} levels")
    return sorted(found)
