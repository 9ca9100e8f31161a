"""Personal data: fixed patterns, and identifiers found by the company they keep.

The fixed patterns give sure entities (seeds). Tokens that look like identifiers
are candidates; the words around them are lexical patterns. Spark scores the
graph of patterns and instances in rounds: a pattern is trusted as far as the
instances it meets are known, an instance as far as the patterns that meet it
are. Candidates no fixed pattern knows are taken where a trusted pattern meets
them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from shopfloor.llm.workers import own_turn
from shopfloor.sources.staging import stage

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
MIN_SEEDS = 5
"""Distinct known instances that a pattern must meet before it counts."""
TRUST = 0.8
"""Confidence from which a pattern is trusted and an instance is taken."""
LONGEST = 64
"""Characters of the longest candidate token."""

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind only saves time: a match begins at the start of its digits or not at all.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")
_HINT = re.compile("[0-9@]")
_GAP = "\t\n\v\f\r "
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'()[]{}<>,;:!?.*#$%&|="

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    """From each @ outwards, so that long words cost no more than their length."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield "email", start, done
        at = text.find("@", max(done, at + 1))


def _is_ip(found: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in found.split(".")]
    return all(len(p) < 4 and int(p) <= 255 for p in parts)


def _is_card(found: str) -> bool:
    digits = [int(c) for c in found if c.isdigit()]
    if not 12 <= len(digits) <= 19:
        return False
    doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _is_phone(found: str) -> bool:
    return 9 <= sum(c.isdigit() for c in found) <= 15


def base_spans(text: str | None) -> list[Span]:
    """Entities by the fixed patterns, leftmost and apart within each kind, by start and then kind."""
    if not text or not _HINT.search(text):
        return []
    found = list(_emails(text)) if "@" in text else []
    if _DIGITS.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m.group())]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m.group())]
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if _is_phone(m.group())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _words_before(text: str, at: int) -> list[str]:
    return [w.strip(_EDGE).lower() for w in _TOKEN.findall(text[max(0, at - 80) : at])[-2:]]


def candidates(text: str, spans: list[Span]) -> list[tuple[int, int, str, str | None, list[str]]]:
    """(start, end, instance, kind if known, patterns) of the seeds and of other tokens that look like identifiers.

    Such a token has an @ or at least four digits. Patterns are the two words
    before it, and the word before it with the word after.
    """
    found = [(s, e, k) for k, s, e in spans]
    done, busy = 0, sorted((s, e) for _, s, e in spans)
    for hint in _HINT.finditer(text):
        if hint.start() < done:
            continue
        near = hint.start() - LONGEST
        start = max(text.rfind(c, max(near, 0), hint.start()) for c in _GAP) + 1
        token = _TOKEN.match(text, start, start + LONGEST + 1) if start or near <= 0 else None
        if token is None or len(token.group()) > LONGEST:
            done = hint.end()
            continue
        done = token.end()
        core = token.group().strip(_EDGE)
        start = token.start() + token.group().find(core) if core else start
        end = start + len(core)
        shaped = "@" in core or sum(c.isdigit() for c in core) >= 4
        if shaped and not any(s < end and start < e for s, e in busy):
            found.append((start, end, None))
    made = []
    for start, end, kind in found:
        before = _words_before(text, start)
        after = _TOKEN.search(text, end, end + 40)
        following = after.group().strip(_EDGE).lower() if after else ""
        patterns = []
        if len(before) == 2 and all(before):
            patterns.append("L " + " ".join(before))
        if before and before[-1] and following and not _HINT.search(following):
            patterns.append(f"B {before[-1]} _ {following}")
        patterns = [p for p in patterns if not _HINT.search(p[2:])]
        made.append((start, end, text[start:end].lower(), kind, patterns))
    return made


_SPANS = "array<struct<kind: string, start: int, end: int>>"
_FOUND = "array<struct<start: int, end: int, instance: string, kind: string, patterns: array<string>>>"


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``scan``: base spans and candidates of each whole text."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    one = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("kind", pa.string()), ("patterns", pa.list_(pa.string()))])
    names = ["start", "end", "instance", "kind", "patterns"]

    @arrow_udf(f"struct<spans: {_SPANS}, found: {_FOUND}>")
    @own_turn()
    def scan(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            spans, found = [], []
            for value in part:
                t = value.as_py() or ""
                base = base_spans(t)
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in base])
                found.append([dict(zip(names, c)) for c in candidates(t, base)] if _HINT.search(t) else [])
            yield pa.StructArray.from_arrays([pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(one))], ["spans", "found"])

    return df.withColumn("scan", scan(F.col(text)))


def trusted_patterns(met: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, trust: float = TRUST) -> DataFrame:
    """Pattern, kind and confidence of trusted patterns.

    ``met`` has pattern, instance and kind (null where unknown). A pattern's
    confidence for a kind is the sum of what its distinct instances are worth (a
    seed of the kind 1, of another kind 0, others their score) over their number;
    an instance's score for a kind is the mean confidence of the patterns that
    meet it. Only patterns with ``min_seeds`` distinct seeds of the kind take part.
    """
    edges = stage(met.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")), "pattern-edges")
    seeds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    seeds = stage(seeds.where(F.col("seeds") >= min_seeds).withColumnRenamed("kind", "of"), "pattern-seeds")
    graph = stage(edges.join(seeds, "pattern"), "pattern-graph")
    known = F.when(F.col("kind").isNotNull(), (F.col("kind") == F.col("of")).cast("double"))
    scores = None
    for _ in range(rounds):
        worth = graph.withColumn("worth", F.coalesce(known, F.lit(0.0)))
        if scores is not None:
            worth = graph.join(scores, ["instance", "of"], "left").withColumn("worth", F.coalesce(known, "score", F.lit(0.0)))
        confidence = stage(worth.groupBy("pattern", "of").agg(F.avg("worth").alias("confidence")), "pattern-scores")
        meets = graph.where("kind is null").join(confidence, ["pattern", "of"])
        scores = stage(meets.groupBy("instance", "of").agg(F.avg("confidence").alias("score")), "instance-scores")
    return confidence.where(F.col("confidence") >= trust)


def extra_spans(scans: DataFrame, keys: list[str]) -> DataFrame:
    """Per document that has any: the spans of candidates that trusted patterns meet, as ``extra``."""
    found = scans.select(*keys, F.explode("scan.found").alias("f")).select(*keys, "f.*").withColumn("pattern", F.explode("patterns"))
    found = stage(found.select(*keys, "start", "end", "instance", "kind", "pattern"), "pii-candidates")
    trusted = stage(trusted_patterns(found.select("pattern", "instance", "kind")), "trusted")
    unseen = found.where("kind is null").join(trusted, "pattern")
    # A candidate that patterns of several kinds meet is of the kind they trust most.
    best = unseen.groupBy(*keys, "start", "end").agg(F.max_by("of", F.struct("confidence", "of")).alias("kind"))
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("extra"))


def _joined(spans: Column) -> Column:
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s.alias("s"))))
    return F.array_join(F.transform(order, lambda o: F.concat_ws(":", o["s"]["kind"], o["s"]["start"], o["s"]["end"])), ",")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, counts of base entities per kind, base_sha256, and ``found`` (all spans).

    Null and empty texts have no spans. Rows are kept; rows equal in key and text
    have equal results. Overlapping spans of different kinds all stand. An empty
    table gives no rows.
    """
    scans = stage(scanned(docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))).drop("text"), "pii-scan")
    keyed = scans.withColumn("doc", F.struct("doc_id", "same"))
    extra = stage(extra_spans(keyed.dropDuplicates(["doc_id", "same"]), ["doc"]), "pii-extra")
    together = keyed.join(extra.withColumnRenamed("doc", "other"), F.col("doc").eqNullSafe(F.col("other")), "left")
    count = lambda k: F.size(F.filter("scan.spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    none = F.array().cast(_SPANS)
    return together.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_joined(F.col("scan.spans")), 256).alias("base_sha256"),
        F.concat(F.col("scan.spans"), F.coalesce("extra", none)).alias("found"),
    )


def spans_text(found: Column) -> Column:
    """kind:start:end of all spans, by start and then kind, comma-joined."""
    return _joined(found)


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows with every found span of the text replaced by its kind in brackets.

    Where spans overlap, the first by start (then the longest) is replaced and
    what is left of the others after it too. Null texts stay null.
    """
    keyed = docs.withColumn("_pii_same", F.xxhash64(text))
    scans = scanned(keyed.select(F.col(key).alias("doc_id"), F.col("_pii_same").alias("same"), F.col(text).alias("text"))).drop("text")
    scans = stage(scans, "pii-scan").where("size(scan.found) > 0").dropDuplicates(["doc_id", "same"])
    extra = stage(extra_spans(scans.withColumn("doc", F.struct("doc_id", "same")), ["doc"]), "pii-extra")
    extra = extra.withColumnsRenamed({"doc": "_pii_doc", "extra": "_pii_extra"})

    @arrow_udf("string")
    @own_turn()
    def mask(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, more in parts:
            yield pa.array([_replaced(t.as_py(), m.as_py() or []) for t, m in zip(texts, more)], pa.string())

    struct = F.struct(F.col(key).alias("doc_id"), F.col("_pii_same").alias("same"))
    found = keyed.join(extra, struct.eqNullSafe(F.col("_pii_doc")), "left")
    return found.withColumn(text, mask(F.col(text), F.col("_pii_extra"))).select(*docs.columns)


def _replaced(text: str | None, extra: list[dict]) -> str | None:
    spans = base_spans(text) + [(s["kind"], s["start"], s["end"]) for s in extra]
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        out += [text[at : max(start, at)], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]
