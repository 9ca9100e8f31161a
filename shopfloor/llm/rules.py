"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a condition that rejects a document. A sample tells what a rule
costs and how much it rejects; the rules then run in order of rejection per
cost, and a document that one rule rejects is not measured for the next.
The order affects cost and which rule is named, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.sources.staging import stage

SYMBOLS = "#*$%&|<>"
_GAP = r"[\x20\x09-\x0D]+"
SAMPLE_ROWS = 2_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    """Only texts with equal lines have their lines looked at."""

    def repeated(worded: Column) -> Column:
        return F.size(worded) - F.size(F.array_distinct(worded))

    def counted(every: Column) -> Column:
        return F.when(F.size(every) == F.size(F.array_distinct(every)), 0).otherwise(let(lines(text), repeated))

    return let(F.split(text, "\n"), counted).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, each word once.

    Texts whose windows all differ are done with their hashes. Else windows are
    sorted by hash, so equal ones are neighbours; their starts in text order then
    cover three words each, less where the next start is closer.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def at(x: Column, k: Column) -> Column:
        return F.get(x, k)["h"]

    def repeated(x: Column) -> Column:
        same = lambda w, k: w["h"].eqNullSafe(at(x, k - 1)) | w["h"].eqNullSafe(at(x, k + 1))
        return F.sort_array(F.transform(F.filter(x, same), lambda w: w["i"]))

    def covered(starts: Column) -> Column:
        step = lambda s, k: F.coalesce(F.least(F.lit(3), F.get(starts, k + 1) - s), F.lit(3))
        return F.aggregate(F.transform(starts, lambda s, k: step(s, k)), F.lit(0), lambda a, b: a + b)

    def in_repeats(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(placed, repeated), covered))

    return let(words, lambda w: F.when(F.size(w) < 3, 0).otherwise(let(hashes(w), in_repeats))).cast("long")


MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.length(F.array_join(words, "")).cast("long"),
    "n_symbols": lambda text, words: F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
    "n_dup_lines": lambda text, words: n_dup_lines(text),
    "n_repeat_words": lambda text, words: n_repeat_words(words),
}


class Measures:
    """The measures of a text by name: columns where the frame has them already, else computed from the text."""

    def __init__(self, text: Column, words: Column, given: Collection[str] = ()):
        self.text, self.words, self.given = text, words, given

    def __getitem__(self, name: str) -> Column:
        return F.col(name) if name in self.given else MEASURES[name](self.text, self.words)


@dataclass(frozen=True)
class Rule:
    """Rejects a text where the condition on its measures holds."""

    name: str
    test: Callable[[Measures], Column]

    def rejects(self, of: Column | Measures) -> Column:
        """The condition on a text, or on measures of one."""
        return self.test(of if isinstance(of, Measures) else Measures(of, words(of)))


def _repeats_lines(m: Measures) -> Column:
    enough = let(F.size(lines(m.text)), lambda n: (n >= 4) & (2 * m["n_dup_lines"] > n))
    return (m["n_dup_lines"] > 2) & enough


BASE = [
    Rule("too_short", lambda m: m["n_words"] < 50),
    Rule("repetitive", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
]
RULES = [
    *BASE,
    Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("word_length", lambda m: ~m["word_chars"].between(2 * m["n_words"], 20 * m["n_words"])),
    Rule("repeated_lines", _repeats_lines),
    Rule("shouting", lambda m: 10 * (F.length(m.text) - F.length(F.replace(m.text, F.lit("!"), F.lit("")))) > 3 * m["n_words"]),
]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-3)


def estimates(df: DataFrame, rules: list[Rule], text: str = "text", given: Collection[str] = (), sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and rejections of each rule alone, on a sample of about ``sample_rows`` rows that is written down once."""
    share = min(1.0, sample_rows / max(df.count(), 1))
    # Only texts are drawn: a column of measures would be computed for every row before the draw.
    sample = stage(df.select(F.coalesce(F.col(text), F.lit("")).alias("text")).sample(share, seed=7), "rule-sample")
    if given:
        sample = stage(measured(sample).select("text", *given), "rule-sample-measured")
    sample, measures = _worded(sample, "text", given)

    def timed(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        found = sample.agg(F.coalesce(F.sum(condition.cast("int")), F.lit(0))).first()[0]
        return time.perf_counter() - began, int(found)

    idle = min(timed(F.length("text") < 0)[0] for _ in range(2))
    made = []
    for rule in rules:
        seconds, rejected = timed(rule.rejects(measures))
        made.append(Estimate(rule, max(seconds - idle, 0.0), rejected))
    return made


def ordered(found: list[Estimate]) -> list[Rule]:
    """Rules by rejections per second, best first; rules that rejected nothing by cost."""
    return [e.rule for e in sorted(found, key=lambda e: (-e.gain, e.seconds))]


def _worded(df: DataFrame, text: str, given: Collection[str] = ()) -> tuple[DataFrame, Measures]:
    """The frame with the words of its texts in a column of a free name, and its measures; drop what is added by name."""
    free = "_words"
    while free in df.columns:
        free = "_" + free
    value = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(free, words(value)), Measures(value, F.col(free), given)


def apply_rules(
    df: DataFrame, rules: list[Rule] | None = None, text: str = "text", out: str = "rejected_by", given: Collection[str] = ()
) -> DataFrame:
    """Add the name of the first rule of the cascade that rejects each document, null for those kept.

    All columns and rows are kept, repeated rows too; null texts count as empty.
    An empty table stays empty. ``given`` names measures that the frame has as
    columns, as ``measured`` adds them: they are read, not computed again.
    """
    cascade = ordered(estimates(df, rules or RULES, text, given))
    worded, measures = _worded(df, text, given)
    verdict = None
    for rule in cascade:
        hit = rule.rejects(measures)
        verdict = F.when(hit, rule.name) if verdict is None else verdict.when(hit, rule.name)
    kept = [F.col(c) for c in df.columns if c != out]
    return worded.select(*kept, verdict.alias(out))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add every measure of MEASURES as a column; columns of those names are replaced."""
    worded, measures = _worded(df, text)
    kept = [F.col(c) for c in df.columns if c not in MEASURES]
    return worded.select(*kept, *(measures[name].alias(name) for name in MEASURES))
