"""Rules before the model: blacklist, velocity, amount; the first that fires decides."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.spec import Roles
from chronolith.windows import masked, older, prior


@dataclass(frozen=True)
class Blacklist:
    """Block rows whose ``column``, as text, is in ``values`` (a table with one column ``value``)."""

    column: str
    values: DataFrame
    name: str = "blacklist"
    action: str = "block"

    def apply(self, df: DataFrame, roles: Roles, open_rows: Column | None = None) -> tuple[DataFrame, Column]:
        listed = self.values.select(F.col("value").cast("string").alias("_listed")).where("_listed is not null").distinct()
        joined = df.join(listed, F.col(self.column).cast("string") == F.col("_listed"), "left").withColumn("_blocked", F.col("_listed").isNotNull()).drop("_listed")
        return joined, F.when(F.col("_blocked"), F.lit(self.action))


@dataclass(frozen=True)
class Velocity:
    """Challenge a key with more than ``most`` rows in the last ``width`` ticks, the current one included.

    Only rows that no rule before has decided count.
    """

    width: int = 3600
    most: int = 5
    name: str = "velocity"
    action: str = "challenge"

    def apply(self, df: DataFrame, roles: Roles, open_rows: Column | None = None) -> tuple[DataFrame, Column]:
        seen = F.lit(1) if open_rows is None else open_rows.cast("int")
        before = F.coalesce(F.sum(seen).over(prior(roles)), F.lit(0)) - F.coalesce(F.sum(seen).over(older(roles, self.width)), F.lit(0))
        counted = df.withColumn("_recent", masked(before + 1, 0, roles.key))
        return counted, F.when(F.col("_recent") > self.most, F.lit(self.action))


@dataclass(frozen=True)
class Amount:
    """Challenge amounts strictly over ``limit``."""

    limit: float = 10000.0
    name: str = "amount"
    action: str = "challenge"

    def apply(self, df: DataFrame, roles: Roles, open_rows: Column | None = None) -> tuple[DataFrame, Column]:
        return df, F.when(F.col(roles.amount) > self.limit, F.lit(self.action))


@dataclass
class RuleEngine:
    """Rules in order.  A row that one rule decides is not seen, or counted, by the next."""

    rules: list = field(default_factory=list)
    #: What went wrong with the rules that the last evaluation left out, by name.
    failed: dict[str, str] = field(default_factory=dict)

    def evaluate(self, df: DataFrame, roles: Roles) -> DataFrame:
        """``df`` with ``rule`` and ``rule_action`` (null where none fires), from one scan of it.

        What has decided a row is carried along as a column, and windows by key
        share one exchange, however many rules there are.  A rule that cannot be
        applied to ``df`` (a column that is absent or of the wrong type) is left
        out and reported in ``failed``; the others judge on.
        """
        self.failed, columns = {}, df.columns
        out = df.withColumns({"rule": F.lit(None).cast("string"), "rule_action": F.lit(None).cast("string")})
        for rule in self.rules:
            open_rows = F.col("rule").isNull()
            try:
                applied, action = rule.apply(out, roles, open_rows)
                fired = open_rows & action.isNotNull()
                out = applied.withColumn("_fired", fired).select(*columns, F.when(F.col("_fired"), F.lit(rule.name)).otherwise(F.col("rule")).alias("rule"), F.when(F.col("_fired"), action).otherwise(F.col("rule_action")).alias("rule_action"))
            except AnalysisException as e:
                self.failed[rule.name] = e.getMessage() if hasattr(e, "getMessage") else str(e)
        return out

    def list_rules(self) -> list[str]:
        return [r.name for r in self.rules]


def default_engine(blacklist: DataFrame, column: str) -> RuleEngine:
    return RuleEngine([Blacklist(column, blacklist), Velocity(), Amount()])


def decide(df: DataFrame, score: str, low: float | None = 0.4, high: float | None = 0.8) -> DataFrame:
    """Scores after rules: a block is probability 1 and high, a challenge 0.5 and medium, else the model decides."""
    p = F.when(F.col("rule_action") == "block", 1.0).when(F.col("rule_action") == "challenge", 0.5).otherwise(F.col(score))
    level = F.when(p >= high, "high").when(p >= low, "medium").otherwise("low")
    return df.select("*", p.alias("probability"), level.alias("risk_level"), F.when(level == "high", "auto_block").when(level == "medium", "manual_review").otherwise("auto_pass").alias("action"), F.when(F.col("rule").isNotNull(), "rule").otherwise("model").alias("decision_source"))
