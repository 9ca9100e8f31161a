"""Table contracts: what a valid upload looks like, checked for all rows at once.

A contract turns a frame into an error table (one row per broken rule, addressed
as a spreadsheet user sees it) and into typed rows. Row rules are projections;
only the uniqueness rule shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopfloor.functions import fixed
from shopfloor.operators.sequence import join_groups

ROW_NO = "_row_no"
ECHO_LENGTH = 50
ERROR_COLUMNS = ["row_no", "ord", "column", "value", "msg", "message"]
NUMBER_TEXT = r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$"


class IngestError(ValueError):
    """A failure whose message may be shown to the person who sent the file."""


@dataclass(frozen=True)
class Field:
    """One column of a contract.

    ``kind`` is ``text``, ``strict_int`` (whole numbers only), ``int`` or
    ``float`` (read from any numeric text) or ``choice``.
    """

    name: str
    kind: str
    low: int | None = None
    high: int | None = None
    above: int | None = None
    max_length: int | None = None
    optional: bool = False
    blank_message: str = ""
    choices: tuple[str, ...] = ()
    range_message: str = ""

    def raw(self, df: DataFrame) -> Column:
        """Cell as text, null when missing (empty, NaN or null)."""
        c = F.col(self.name)
        if isinstance(df.schema[self.name].dataType, T.IntegralType):
            return c.cast("string")
        if isinstance(df.schema[self.name].dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        text = c.cast("string")
        missing = F.trim(text) == "" if self.optional or self.kind != "text" else text == ""
        return F.when(~missing, text)

    def number(self, df: DataFrame) -> Column:
        """The cell's value: whole numbers of strict columns exactly, as long; double otherwise."""
        if isinstance(df.schema[self.name].dataType, T.IntegralType):
            return F.col(self.name).cast("long" if self.kind == "strict_int" else "double")
        text = F.trim(self.raw(df))
        if self.kind == "strict_int":
            return text.try_cast("long")
        return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))

    def problems(self, raw: Column, number: Column) -> list[tuple[Column, str]]:
        """(broken, message) pairs in the order they are looked at, of a cell's text and value."""
        missing = F.lit(False) if self.optional else raw.isNull()
        if self.kind == "text":
            found = [(missing, "Input should be a valid string"), (F.trim(raw) == "", self.blank_message)]
            if self.max_length:
                found.append((F.length(F.trim(raw)) > self.max_length, f"String should have at most {self.max_length} characters"))
            return found
        if self.kind == "choice":
            listed = ", ".join(f"'{c}'" for c in self.choices[:-1]) + f" or '{self.choices[-1]}'"
            return [(missing, f"Input should be {listed}"), (~raw.isin(*self.choices), f"Input should be {listed}")]
        if self.kind == "strict_int":
            found = [(missing, "Input should be a valid integer"), (raw.isNotNull() & number.isNull(), "Input should be a valid integer")]
        else:
            what, kind = ("integer", "an integer") if self.kind == "int" else ("number", "a number")
            found = [
                (missing, f"Input should be a valid {what}"),
                (
                    raw.isNotNull() & number.isNull(),
                    f"Input should be a valid {what}, unable to parse string as {kind}",
                ),
                (F.isnan(number) | (F.abs(number) == F.lit(float("inf"))), "Input should be a finite number"),
            ]
            if self.kind == "int":
                found.append(
                    (number != F.floor(number), "Input should be a valid integer, got a number with a fractional part")
                )
        if self.above is not None:
            found.append((number <= self.above, f"Input should be greater than {self.above}"))
        if self.low is not None:
            found.append((number < self.low, self.range_message or f"Input should be greater than or equal to {self.low}"))
        if self.high is not None:
            found.append((number > self.high, self.range_message or f"Input should be less than or equal to {self.high}"))
        return found

    def typed(self, df: DataFrame) -> Column:
        raw = self.raw(df)
        if self.kind in ("text", "choice"):
            return F.trim(raw)
        if self.kind == "float":
            return self.number(df)
        return self.number(df).try_cast("long" if self.kind == "strict_int" and self.high is None else "int")


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]
    unique: tuple[str, ...] = ()
    unique_message: str = ""
    hint: str = ""
    row_rules: Callable[[dict[str, Column]], list[tuple[Column, str]]] | None = None
    required: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "required", tuple(f.name for f in self.fields if not f.optional))

    def hint_text(self) -> str:
        return f" Check your data against the template at {self.hint}." if self.hint else ""

    def present(self, df: DataFrame) -> list[Field]:
        return [f for f in self.fields if f.name in df.columns]

    def check_shape(self, df: DataFrame, *, non_empty: bool = True) -> DataFrame:
        """Raise unless the required columns, and at least one row, are there."""
        if non_empty and df.isEmpty():
            raise IngestError(
                f"No data rows found. A {self.name} file must contain at least one row below the header."
                + self.hint_text()
            )
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise IngestError(
                f"Missing required column(s): {missing}. Expected columns: {list(self.required)}." + self.hint_text()
            )
        return df

    def typed(self, df: DataFrame) -> DataFrame:
        """Rows with contract columns trimmed and cast; other columns pass through."""
        casts = {f.name: f.typed(df) for f in self.present(df)}
        return df.select(*[casts.get(c, F.col(c)).alias(c) for c in df.columns])

    def row_errors(self, df: DataFrame, row_no: str = ROW_NO) -> DataFrame:
        """First problem of every bad cell, then broken row rules of rows without bad cells.

        A clean row costs its checks alone: each cell's first broken check is a small
        number, rows without any are dropped, and texts are made for the others.
        """
        fields = self.present(df)
        n = len(fields)
        read = df.select(
            F.col(row_no).alias("row_no"),
            *[f.raw(df).alias(f"_r{i}") for i, f in enumerate(fields)],
            *[f.number(df).alias(f"_n{i}") for i, f in enumerate(fields) if f.kind not in ("text", "choice")],
            *([f.typed(df).alias(f"_t{i}") for i, f in enumerate(fields)] if self.row_rules else []),
        )
        codes, messages = [], []
        for i, f in enumerate(fields):
            found = f.problems(F.col(f"_r{i}"), F.col(f"_n{i}"))
            code = reduce(lambda c, k: c.when(found[k][0], k + 1), range(1, len(found)), F.when(found[0][0], 1))
            codes.append(F.coalesce(code, F.lit(0)).alias(f"_c{i}"))
            messages.append([message for _, message in found])
        rules = []
        if self.row_rules:
            places = {f.name: i for i, f in enumerate(fields)}
            typed = {f.name: F.col(f"_t{places[f.name]}") if f.name in places else F.lit(None).cast("double") for f in self.fields}
            rules = self.row_rules(typed)
        broken = F.lit(0)
        for i, (condition, _) in reversed(list(enumerate(rules))):
            broken = F.when(condition, i + 1).otherwise(broken)
        coded = read.select("*", *codes, broken.alias("_rule"))
        cells_ok = reduce(lambda x, y: x & y, [F.col(f"_c{i}") == 0 for i in range(n)], F.lit(True))
        bad = coded.where(~cells_ok | (F.col("_rule") > 0)).withColumn("_rule", F.when(cells_ok, F.col("_rule")).otherwise(0))

        def cell(ord_: Column, column: Column, value: Column, texts: Sequence[str], code: Column) -> Column:
            msg = F.element_at(F.array(*map(F.lit, texts)), code)
            return F.when(code > 0, F.struct(ord_.alias("ord"), column.alias("column"), value.alias("value"), msg.alias("msg")))

        cells = [cell(F.lit(i), F.lit(f.name), F.col(f"_r{i}"), messages[i], F.col(f"_c{i}")) for i, f in enumerate(fields)]
        if rules:
            none = F.lit(None).cast("string")
            cells.append(cell(F.lit(len(self.fields) - 1) + F.col("_rule"), none, none, [m for _, m in rules], F.col("_rule")))
        found = bad.select("row_no", F.explode(F.array_compact(F.array(*cells))).alias("e")).select("row_no", "e.*")
        return found.withColumn("message", self._row_message())

    def _row_message(self) -> Column:
        numeric = F.col("value").try_cast("double").isNotNull()
        quoted = F.when(
            F.col("value").contains("'") & ~F.col("value").contains('"'), F.concat(F.lit('"'), F.col("value"), F.lit('"'))
        ).otherwise(F.concat(F.lit("'"), F.col("value"), F.lit("'")))
        shown = F.when(F.col("value").isNull(), "None").when(numeric, F.col("value")).otherwise(quoted)
        cut = F.concat(F.substring(shown, 1, ECHO_LENGTH - 3), F.lit("..."))
        shown = F.when(F.length(shown) > ECHO_LENGTH, cut).otherwise(shown)
        where = F.concat(F.lit("Row "), F.col("row_no").cast("string"))
        addressed = F.concat(where, F.lit(", column '"), F.col("column"), F.lit("': "), F.col("msg"), F.lit(" (got "), shown, F.lit(")."))
        plain = F.concat(where, F.lit(": "), F.col("msg"), F.lit("."))
        return F.concat(F.coalesce(addressed, plain), F.lit(self.hint_text()))

    def duplicates(self, df: DataFrame, row_no: str = ROW_NO) -> DataFrame:
        """Every repeat of an already seen key, by row; a key used three times is listed twice.

        Keys are counted first (partial aggregation), and only rows of repeated
        keys are looked at again, salted, so one hot key stays spread out.
        """
        by_name = {f.name: f for f in self.fields}
        keys = [f"_k{i}" for i in range(len(self.unique))]
        rows = df.select(
            F.col(row_no).alias("row_no"), *[by_name[c].typed(df).alias(k) for c, k in zip(self.unique, keys)]
        ).dropna(subset=keys)
        first = rows.groupBy(*keys).agg(F.min("row_no").alias("_first"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
        repeats = join_groups(rows, first.drop("_c"), keys).where(F.col("row_no") > F.col("_first"))
        shown = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
        value = shown if len(keys) == 1 else F.concat(F.lit("("), shown, F.lit(")"))
        msg = F.lit(self.unique_message)
        text = F.concat(F.lit(f"{self.name} dataset is invalid: "), msg, F.lit(": ["), value, F.lit("]."), F.lit(self.hint_text()))
        return repeats.select(
            "row_no",
            F.lit(1000).alias("ord"),
            F.lit(None).cast("string").alias("column"),
            value.alias("value"),
            msg.alias("msg"),
            text.alias("message"),
        )

    def errors(self, df: DataFrame, row_no: str = ROW_NO) -> DataFrame:
        """All row errors and repeated keys."""
        found = self.row_errors(df, row_no)
        return found.unionByName(self.duplicates(df, row_no)) if self.unique else found

    def require_valid(self, df: DataFrame, row_no: str = ROW_NO) -> DataFrame:
        """Strict mode: raise the first row error, else the first repeated key; then type the rows."""
        self.check_shape(df)
        for found in (self.row_errors(df, row_no), self.duplicates(df, row_no) if self.unique else None):
            first = found.orderBy("row_no", "ord").take(1) if found is not None else []
            if first:
                raise IngestError(first[0]["message"])
        return self.typed(df)


def _text(name: str, max_length: int, blank: str, **more: object) -> Field:
    return Field(name, "text", max_length=max_length, blank_message=blank, **more)


_STRICT_BLANK = "Value error, field must not be blank or whitespace-only"
_BLANK = "Value error, must not be blank or whitespace-only"
_SCALE = f"out of range. Valid range is {fixed.RATING_MIN}–{fixed.RATING_MAX} (AIAG FMEA-4 scale)"


def _rating(name: str) -> Field:
    return Field(name, "strict_int", low=fixed.RATING_MIN, high=fixed.RATING_MAX, range_message=_SCALE)


FMEA = Contract(
    "FMEA",
    (
        Field("ID", "strict_int", above=0),
        _text("Process_Step", 2000, _STRICT_BLANK),
        _text("Component", 2000, _STRICT_BLANK),
        _text("Function", 2000, _STRICT_BLANK),
        _text("Failure_Mode", 2000, _STRICT_BLANK),
        _text("Effect", 2000, _STRICT_BLANK),
        _rating("Severity"),
        _text("Cause", 2000, _STRICT_BLANK),
        _rating("Occurrence"),
        _text("Current_Control", 2000, _STRICT_BLANK),
        _rating("Detection"),
    ),
    unique=("ID",),
    unique_message="duplicate IDs found",
)

SPC = Contract(
    "SPC",
    (
        _text("stream", 200, "Value error, stream must not be blank or whitespace-only"),
        Field("subgroup", "int", low=1),
        Field("value", "float"),
    ),
)

GAGE = Contract(
    "Gage R&R",
    (
        _text("part", 200, _BLANK),
        _text("appraiser", 200, _BLANK),
        Field("trial", "int", low=1),
        Field("measurement", "float"),
    ),
    unique=("part", "appraiser", "trial"),
    unique_message="duplicate (part, appraiser, trial) rows found",
)


def _tolerance_rules(c: dict[str, Column]) -> list[tuple[Column, str]]:
    lsl, usl, target = c["lsl"], c["usl"], c["target"]
    return [
        (usl <= lsl, "usl must be greater than lsl"),
        (((target < lsl) | (target > usl)) & lsl.isNotNull() & usl.isNotNull(), "target must be within [lsl, usl]"),
    ]


PLAN = Contract(
    "Control Plan",
    (
        _text("characteristic", 200, _BLANK),
        Field("lsl", "float", optional=True),
        Field("usl", "float", optional=True),
        Field("target", "float", optional=True),
        _text("measurement_method", 200, _BLANK),
        Field("sample_size", "int", low=1),
        _text("frequency", 200, _BLANK),
        Field("recommended_chart", "choice", optional=True, choices=tuple(fixed.CHART_KEYS)),
        _text("reaction_plan", 2000, _BLANK),
        _text("source_cause_id", 300, _BLANK, optional=True),
    ),
    unique=("characteristic",),
    unique_message="duplicate characteristic rows found",
    row_rules=_tolerance_rules,
)

ACTION = Contract(
    "Action",
    (
        Field("row_id", "strict_int", above=0),
        _text("owner", 200, _STRICT_BLANK),
        Field("status", "choice", choices=tuple(fixed.ACTION_STATUSES)),
        Field("s_after", "strict_int", low=1, high=10, optional=True),
        Field("o_after", "strict_int", low=1, high=10, optional=True),
        Field("d_after", "strict_int", low=1, high=10, optional=True),
    ),
)


def action_errors(edited: DataFrame) -> DataFrame:
    """Errors of an edited action table, addressed by failure-mode id; rows without an owner are ignored."""
    kept = edited.where(F.length(F.trim(F.coalesce(F.col("owner"), F.lit("")))) > 0)
    kept = kept.withColumn("status", F.coalesce("status", F.lit("Open")))
    found = ACTION.row_errors(kept, "row_id").withColumnRenamed("row_no", "row_id")
    shown = F.when(
        F.col("column") == "status", F.concat(F.lit("'"), F.col("value"), F.lit("' is not a valid status"))
    ).otherwise(F.col("msg"))
    message = F.concat(F.lit("Row ID "), F.col("row_id").cast("string"), F.lit(", '"), F.col("column"), F.lit("': "), shown)
    found = found.withColumn("message", message)
    if "due" not in edited.columns:
        return found
    due = F.trim(F.col("due").cast("string"))
    bad = kept.where((due != "") & due.try_cast("date").isNull()).select(
        "row_id",
        F.lit(len(ACTION.fields)).alias("ord"),
        F.lit("due").alias("column"),
        due.alias("value"),
        F.lit("Input should be a valid date").alias("msg"),
        F.concat(F.lit("Row ID "), F.col("row_id").cast("string"), F.lit(", 'due': Input should be a valid date")).alias("message"),
    )
    return found.unionByName(bad)

