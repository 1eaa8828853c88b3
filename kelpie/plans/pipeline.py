"""The stages of a corpus run, in order, with gates between them; the metrics that cohorts compare; texts of comparisons and cohorts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.naming import shown_number
from kelpie.operators import headline

#: Numbers of the headline that a cohort compares, with a label each.
METRICS = tuple((path, name.replace("_", " ")) for name, path, _ in headline.HEADLINE if name not in headline.TEXT_FIELDS)


@dataclass(frozen=True)
class Stage:
    """A step of a run; ``gate`` says of its result whether the steps after it may run."""

    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    gate: Callable[[DataFrame], bool] | None = None
    wanted: bool = True


def run_stages(spark: SparkSession, stages: Sequence[Stage], given: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """(results by name, (stage, what became of it)). A stage reads the results before it. What is not wanted is left out; after a gate that
    does not open, nothing runs."""
    results, told = dict(given or {}), []
    open_ = True
    for stage in stages:
        if not open_:
            told.append((stage.name, "not run"))
        elif not stage.wanted:
            told.append((stage.name, "left out"))
        else:
            results[stage.name] = stage.run(spark, results)
            open_ = stage.gate is None or stage.gate(results[stage.name])
            told.append((stage.name, "done" if open_ else "stopped here"))
    return results, told


def compared(a: DataFrame, b: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, a, b, change) of two rows of measurements, one row for each metric: what a comparison shows."""
    both = a.select(*[F.col(m).alias(f"a_{m}") for m in metrics]).limit(1).crossJoin(b.select(*[F.col(m).alias(f"b_{m}") for m in metrics]).limit(1))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").cast("double").alias("a"), F.col(f"b_{m}").cast("double").alias("b")) for m in metrics])
    out = both.select(F.explode(rows).alias("x")).select("x.*")
    return out.select("metric", shown_number(F.col("a"), 2).alias("a"), shown_number(F.col("b"), 2).alias("b"), shown_number(F.col("b") - F.col("a"), 2, True).alias("change"))


def as_text(rows: DataFrame, most: int = 60) -> str:
    """A small table as aligned text; more rows than ``most`` are told, not shown."""
    found = rows.limit(most + 1).collect()
    cells = [rows.columns, *[["" if v is None else str(v) for v in r] for r in found[:most]]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in cells]
    return "\n".join(lines + (["..."] if len(found) > most else []))
