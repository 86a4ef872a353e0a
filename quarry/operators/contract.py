"""Data contracts: declared rules of a table, checked in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.missing import is_numeric, present

VIOLATION = "code string, column string, severity string, amount double"


@dataclass
class Rule:
    """What a column must satisfy; None leaves a part out."""

    kind: str | None = None
    low: float | None = None
    high: float | None = None
    allowed: tuple | None = None
    max_missing: float | None = None
    unique: bool = False


@dataclass
class DataContract:
    """Rules by column, required columns, and whether more columns are allowed."""

    rules: dict[str, Rule] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    max_missing: float | None = None
    allow_extra: bool = True

    def validate(self, df: DataFrame) -> DataFrame:
        """code, column, severity, amount: one row a violation; amount counts rows (missing_rate: the rate).

        All value rules are counted in one pass; only unique ones need a shuffle.
        """
        spark, known, flat = df.sparkSession, set(df.columns), []
        flat += [("missing_column", c, "error", 1.0) for c in dict.fromkeys([*self.required, *self.rules]) if c not in known]
        if not self.allow_extra:
            flat += [("extra_column", c, "error", 1.0) for c in df.columns if c not in self.rules and c not in self.required]
        counts, n = [], F.count("*")
        for c in df.columns:
            rule, v = self.rules.get(c, Rule()), present(df, c)
            if rule.kind and rule.kind != ("numeric" if is_numeric(df, c) else "categorical"):
                flat.append(("kind", c, "error", 1.0))
            most = rule.max_missing if rule.max_missing is not None else self.max_missing
            if most is not None:
                rate = F.count_if(v.isNull()) / n
                counts.append(F.struct(F.lit("missing_rate").alias("code"), F.lit(c).alias("column"), F.when(rate > most, rate).otherwise(0.0).alias("amount")))
            tests = {"range_min": None if rule.low is None else v < rule.low, "range_max": None if rule.high is None else v > rule.high, "allowed_values": None if rule.allowed is None else v.isNotNull() & ~v.isin(*rule.allowed)}
            counts += [F.struct(F.lit(code).alias("code"), F.lit(c).alias("column"), F.count_if(t).cast("double").alias("amount")) for code, t in tests.items() if t is not None]
            if rule.unique:
                counts.append(F.struct(F.lit("unique").alias("code"), F.lit(c).alias("column"), (F.count(v) - F.count_distinct(v)).cast("double").alias("amount")))
        fixed = spark.createDataFrame(flat, VIOLATION)
        if not counts:
            return fixed
        found = df.agg(F.array(*counts).alias("all")).select(F.explode("all").alias("r")).select("r.code", "r.column", F.lit("error").alias("severity"), "r.amount").filter(F.col("amount") > 0)
        return fixed.unionByName(found)
