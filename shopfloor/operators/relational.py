"""The normalised failure-mode model: six tables instead of one flat one.

Functions are identified by (process step, component, function), failure modes
by their text inside a function, and effects, causes and controls by (text,
rating) inside a failure mode. Ids follow the order of first appearance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.operators.sequence import dense_sequence, join_groups
from shopfloor.sources.staging import stage, stage_all

FLAT_COLUMNS = [
    "ID",
    "Process_Step",
    "Component",
    "Function",
    "Failure_Mode",
    "Effect",
    "Severity",
    "Cause",
    "Occurrence",
    "Current_Control",
    "Detection",
]
MODE = ["function_id", "failure_mode_id"]
# entity table: (flat text column, flat rating column, id letter, rating name, link column)
ENTITIES = {
    "effects": ("Effect", "Severity", "E", "severity", "effect_id"),
    "causes": ("Cause", "Occurrence", "C", "occurrence", "cause_id"),
    "controls": ("Current_Control", "Detection", "CT", "detection", "control_id"),
}


@dataclass(frozen=True)
class RiskModel:
    """Six frames. ``ord`` columns hold the traversal order of functions and modes."""

    functions: DataFrame  # function_id, ord, process_step, component, description
    failure_modes: DataFrame  # function_id, failure_mode_id, ord, description
    effects: DataFrame  # function_id, failure_mode_id, id, description, severity
    causes: DataFrame  # ... occurrence
    controls: DataFrame  # ... detection
    links: DataFrame  # function_id, failure_mode_id, row_id, effect_id, cause_id, control_id

    def entities(self) -> dict[str, DataFrame]:
        return {"effects": self.effects, "causes": self.causes, "controls": self.controls}


def _numbered(df: DataFrame, keys: Sequence[str], prefix: Column, out: str) -> DataFrame:
    """Id from the order of first appearance inside ``keys``."""
    placed = dense_sequence(df, keys, ["_ord"], out="_n")
    return placed.withColumn(out, F.concat(prefix, (F.col("_n") + 1).cast("string"))).drop("_n")


def to_relational(flat: DataFrame, order: str = "ID", *, materialize: bool = True) -> RiskModel:
    """Normalise validated flat rows; ``order`` gives the row order.

    The model's tables build on each other and are read several times, so each is
    written once and read from there; ``materialize=False`` leaves them lazy.
    """
    keep = stage if materialize else lambda frame, label: frame
    function_key = ["Process_Step", "Component", "Function"]
    mode_key = [*function_key, "Failure_Mode"]
    functions = flat.groupBy(*function_key).agg(F.min(order).alias("_ord"))
    functions = keep(_numbered(functions, [], F.lit("F"), "function_id"), "functions")
    modes = flat.groupBy(*mode_key).agg(F.min(order).alias("_ord"))
    modes = join_groups(modes, functions.drop("_ord"), function_key)
    modes = keep(_numbered(modes, ["function_id"], F.concat(F.col("function_id"), F.lit("-M")), "failure_mode_id"), "modes")

    rows = join_groups(flat, modes.drop("_ord"), mode_key)
    tables = {}
    for name, (text, rating, letter, rating_name, link) in ENTITIES.items():
        found = rows.groupBy(*MODE, text, rating).agg(F.min(order).alias("_ord"))
        found = _numbered(found, MODE, F.concat(F.col("failure_mode_id"), F.lit(f"-{letter}")), link)
        tables[name] = found.drop("_ord")
    if materialize:
        tables = stage_all(tables)
    for name, (text, rating, _, _, link) in ENTITIES.items():
        rows = join_groups(rows, tables[name], [*MODE, text, rating])
    links = rows.select(*MODE, F.col("ID").alias("row_id"), *[e[4] for e in ENTITIES.values()])

    entity_tables = {
        name: tables[name].select(
            *MODE, F.col(link).alias("id"), F.col(text).alias("description"), F.col(rating).alias(rating_name)
        )
        for name, (text, rating, _, rating_name, link) in ENTITIES.items()
    }
    return RiskModel(
        functions=functions.select(
            "function_id",
            F.col("_ord").alias("ord"),
            F.col("Process_Step").alias("process_step"),
            F.col("Component").alias("component"),
            F.col("Function").alias("description"),
        ),
        failure_modes=modes.select(*MODE, F.col("_ord").alias("ord"), F.col("Failure_Mode").alias("description")),
        links=keep(links, "links"),
        **entity_tables,
    )


def resolved_links(model: RiskModel) -> DataFrame:
    """Links with the text and rating of their effect, cause and control."""
    rows = model.links
    for name, table in model.entities().items():
        text, rating, _, rating_name, link = ENTITIES[name]
        named = table.select(
            *MODE, F.col("id").alias(link), F.col("description").alias(text), F.col(rating_name).alias(rating)
        )
        rows = join_groups(rows, named, [*MODE, link])
    return rows


def to_flat(model: RiskModel, *, ordered: bool = True) -> DataFrame:
    """The flat rows of the model, by id."""
    modes = model.failure_modes.select(*MODE, F.col("description").alias("Failure_Mode"))
    functions = model.functions.select(
        "function_id",
        F.col("process_step").alias("Process_Step"),
        F.col("component").alias("Component"),
        F.col("description").alias("Function"),
    )
    named_modes = join_groups(modes, functions, ["function_id"])
    rows = join_groups(resolved_links(model), named_modes, MODE)
    flat = rows.withColumnRenamed("row_id", "ID").select(*FLAT_COLUMNS)
    return flat.orderBy("ID") if ordered else flat


def _exploded(counted: DataFrame, scope: Column, item: Column, rules: Sequence[tuple[Column, Column | str]]) -> DataFrame:
    """Rows (scope, item, message) for every rule a counted row breaks."""
    hits = [F.when(broken, F.lit(m) if isinstance(m, str) else m) for broken, m in rules]
    return counted.select(
        scope.alias("scope"), item.cast("string").alias("item"), F.explode(F.array_compact(F.array(*hits))).alias("message")
    )


def model_errors(model: RiskModel) -> DataFrame:
    """Every broken rule of the model as (scope, item, message) rows; empty when sound.

    Definitions and uses of an id are counted together in one aggregation, which
    finds repeated, unknown and unreferenced ids without joins; the map-side
    combine absorbs hot failure modes.
    """
    one = F.lit(1)
    root, mode_scope = F.lit("model"), F.concat_ws("::", *MODE)

    functions = model.functions.select("function_id", one.alias("f"), F.lit(0).alias("m")).unionByName(
        model.failure_modes.select("function_id", F.lit(0).alias("f"), one.alias("m"))
    )
    functions = functions.groupBy("function_id").agg(F.sum("f").alias("f"), F.sum("m").alias("m"))
    found = [
        _exploded(
            functions,
            root,
            F.col("function_id"),
            [
                (F.col("f") > 1, "duplicate function ID"),
                (F.col("f") == 0, "unknown function ID"),
                (F.col("m") == 0, "function without failure modes"),
            ],
        ),
        _exploded(
            model.links.groupBy("row_id").agg(F.count(one).alias("c")),
            root,
            F.col("row_id"),
            [(F.col("c") > 1, "duplicate row ID")],
        ),
    ]

    parts = {"failure_mode": model.failure_modes, **model.entities(), "links": model.links}
    children = reduce(DataFrame.unionByName, [t.select(*MODE, F.lit(k).alias("part")) for k, t in parts.items()])
    children = children.groupBy(*MODE).agg(*[F.count_if(F.col("part") == k).alias(k) for k in parts])
    rules: list[tuple[Column, Column | str]] = [
        (F.col("failure_mode") > 1, "duplicate failure-mode ID"),
        (F.col("failure_mode") == 0, "unknown failure-mode ID"),
    ]
    rules += [(F.col(k) == 0, f"failure mode without {k}") for k in parts if k != "failure_mode"]
    found.append(_exploded(children, F.col("function_id"), F.col("failure_mode_id"), rules))

    defined = reduce(
        DataFrame.unionByName,
        [
            t.select(*MODE, F.lit(k[:-1]).alias("kind"), "id", "description", F.col(ENTITIES[k][3]).alias("rating"))
            for k, t in model.entities().items()
        ],
    )
    pairs = defined.groupBy(*MODE, "kind", "description", "rating").agg(F.count(one).alias("c"))
    pair = F.concat_ws(" / ", F.col("description"), F.col("rating").cast("string"))
    twice = F.concat(F.lit("duplicate "), F.col("kind"), F.lit(" (description, rating)"))
    found.append(_exploded(pairs, mode_scope, pair, [(F.col("c") > 1, twice)]))

    references = F.array(*[F.struct(F.lit(k[:-1]).alias("kind"), F.col(e[4]).alias("id")) for k, e in ENTITIES.items()])
    used = model.links.select(*MODE, "row_id", F.explode(references).alias("r")).select(*MODE, "r.kind", "r.id", "row_id")
    ids = defined.select(*MODE, "kind", "id", one.alias("d"), F.lit(None).cast("long").alias("row_id")).unionByName(
        used.select(*MODE, "kind", "id", F.lit(0).alias("d"), "row_id")
    )
    ids = ids.groupBy(*MODE, "kind", "id").agg(F.sum("d").alias("d"), F.min("row_id").alias("row_id"))
    found.append(
        _exploded(
            ids,
            mode_scope,
            F.col("id"),
            [
                (F.col("d") > 1, F.concat(F.lit("duplicate "), F.col("kind"), F.lit(" ID"))),
                (
                    F.col("d") == 0,
                    F.concat(F.lit("link row "), F.col("row_id").cast("string"), F.lit(": unknown "), F.col("kind"), F.lit(" ID")),
                ),
                (F.col("row_id").isNull(), F.concat(F.lit("unreferenced "), F.col("kind"), F.lit(" ID"))),
            ],
        )
    )
    return reduce(DataFrame.unionByName, found)


def with_links(model: RiskModel, links: DataFrame) -> RiskModel:
    return replace(model, links=links)
