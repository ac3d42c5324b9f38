"""A catalogue of the features of one run: filters, JSON, and a bridge to the feature store."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from chronolith.plans.store import FeatureStore


class FeatureCatalog:
    """Entries with ``source``, ``feature_names``, ``depends_on_target``, ``is_stateful``, and optional meaning and unit."""

    def __init__(self, entries: Sequence[dict] = (), name: str = "catalog"):
        self.name, self.entries = name, [{"physical_meaning": "", "unit": ""} | dict(e) for e in entries]

    def _sources(self, test: Callable[[dict], bool]) -> list[str]:
        return [e["source"] for e in self.entries if test(e)]

    def feature_names(self) -> list[str]:
        return [c for e in self.entries for c in e["feature_names"]]

    def stateful(self) -> list[str]:
        return self._sources(lambda e: e["is_stateful"])

    def target_dependent(self) -> list[str]:
        return self._sources(lambda e: e["depends_on_target"])

    def of_source(self, source: str) -> list[str]:
        return [c for e in self.entries if e["source"] == source for c in e["feature_names"]]

    def to_dict(self) -> dict:
        return {"catalog_name": self.name, "total_entries": len(self.entries), "total_features": len(self.feature_names()), "all_feature_names": self.feature_names(), "stateful_feature_sources": self.stateful(), "target_dependent_sources": self.target_dependent(), "entries": self.entries}

    def export(self, spark: SparkSession, path: str) -> None:
        """Write the catalogue as one JSON text below ``path``."""
        spark.createDataFrame([(json.dumps(self.to_dict()),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeatureCatalog:
        data = json.loads(spark.read.text(path).first()[0])
        return FeatureCatalog(data["entries"], data["catalog_name"])

    def to_store(self, store: FeatureStore, entity: str = "transaction") -> None:
        """Register each entry as one derived feature; registering again adds a version."""
        for e in self.entries:
            store.register(e["source"], entity, "derived", e["physical_meaning"] or e["source"], schema={k: e[k] for k in ("feature_names", "physical_meaning", "unit", "depends_on_target", "is_stateful")})
