"""Base scores of vulnerability vectors, versions 2.0, 3.0 and 3.1, by their public formulas, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.rules import vector_estimate
from lodestone.functions.text import bound

# Weights of the metrics' values.
V3 = {"AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62}, "C": {"H": 0.56, "L": 0.22, "N": 0.0}, "I": {"H": 0.56, "L": 0.22, "N": 0.0}, "A": {"H": 0.56, "L": 0.22, "N": 0.0}}
#: Privileges weigh more where the scope changes.
PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
V2 = {"AV": {"L": 0.395, "A": 0.646, "N": 1.0}, "AC": {"H": 0.35, "M": 0.61, "L": 0.71}, "Au": {"M": 0.45, "S": 0.56, "N": 0.704}, "C": {"N": 0.0, "P": 0.275, "C": 0.66}, "I": {"N": 0.0, "P": 0.275, "C": 0.66}, "A": {"N": 0.0, "P": 0.275, "C": 0.66}}


def metric(vector: Column, name: str) -> Column:
    """The value of a metric, empty if the vector doesn't state it."""
    return F.regexp_extract(vector, rf"(?:^|[/(]){name}:([A-Z]+)(?=$|[/)])", 1)


def _table(*columns: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for c in columns for kv in c.items() for x in kv])


def _weights(vector: Column, names: dict[str, dict[str, float]]) -> dict[str, Column]:
    return {name: F.element_at(_table(weights), metric(vector, name)) for name, weights in names.items()}


def _loss(w: dict[str, Column]) -> Column:
    return 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])


def base_score_3(vector: Column) -> Column:
    """The 3.x base score; null unless all eight metrics are stated. A vector of 3.0 is rounded as 3.0 has it."""
    w = _weights(vector, V3)
    rights = {f"{scope}{k}": x for scope, values in PRIVILEGES.items() for k, x in values.items()}
    ease = 8.22 * w["AV"] * w["AC"] * w["UI"] * F.element_at(_table(rights), F.concat(metric(vector, "S"), metric(vector, "PR")))
    changed = metric(vector, "S") == "C"

    def scored(x: Column) -> Column:
        impact = F.when(x["changed"], 7.52 * (x["loss"] - 0.029) - 3.25 * F.pow(x["loss"] - 0.02, F.lit(15))).otherwise(6.42 * x["loss"])
        return bound(impact, lambda i: F.when(i <= 0, F.when(x["ease"].isNotNull(), 0.0)).otherwise(bound(F.when(x["changed"], 1.08 * (i + x["ease"])).otherwise(i + x["ease"]), rounded)))

    def rounded(total: Column) -> Column:
        most = F.when(total > 10, 10.0).otherwise(total)
        # 3.1 rounds up from whole hundred-thousandths, so that binary fractions don't decide
        return F.when(F.startswith(vector, F.lit("CVSS:3.0")), F.ceil(most * 10) / 10).otherwise(F.ceil(F.round(most * 100_000) / 10_000) / 10)

    return bound(F.struct(_loss(w).alias("loss"), ease.alias("ease"), changed.alias("changed")), scored)


def base_score_2(vector: Column) -> Column:
    """The 2.0 base score; null unless all six metrics are stated."""
    w = _weights(vector, V2)
    parts = F.struct((10.41 * _loss(w)).alias("impact"), (20 * w["AV"] * w["AC"] * w["Au"]).alias("ease"))
    return bound(parts, lambda x: F.when(x["impact"] == 0, F.when(x["ease"].isNotNull(), 0.0)).otherwise(F.round((0.6 * x["impact"] + 0.4 * x["ease"] - 1.5) * 1.176, 1)))


def vector_score(vector: Column) -> Column:
    """The base score by the vector's version, else the rough estimate from what it states; null without either.

    Vectors of version 4.0 only have the estimate. Temporal and environmental
    metrics don't count.
    """
    return F.coalesce(F.when(~F.startswith(vector, F.lit("CVSS:4")), F.coalesce(base_score_3(vector), base_score_2(vector))), vector_estimate(vector))
