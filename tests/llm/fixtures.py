"""Small tables with the awkward rows every operator must take, and plain restatements of the contracts."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.DoubleType()),  # clashes with an output name
    ]
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    full = [(i, t, lang, "s", None if t is None else len(t), 0.5) for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS)


def awkward():
    """(doc_id, text, lang): nulls, empty, blank, very long, repeated rows, ties, odd characters."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7)))
    long = " ".join(word() for _ in range(9_000))
    base = [word() for _ in range(80)]
    rows = [
        (1, None, "en"),
        (2, "", None),
        (3, " \t\n ", "en"),
        (4, long, "de"),
        (5, "x" * 60_000, "en"),
        (6, "one two", "en"),
        (7, "one two", "fr"),
        (8, " ".join(base), "en"),
        (9, " ".join(base), "en"),
        (10, " ".join(base[:70] + ["changed"] + base[71:]).upper(), "en"),
        (11, "Ünïcödé İΣ é 日本 <|endoftext|> it's 12  3\n\nend\n", "de"),
        (None, "a row without an id but with words enough to count", "en"),
        (12, "mail a.b@c.example.org, +1 (301) 555-0346 or 4111 1111 1111 1111 at 10.0.0.1", "en"),
    ]
    return rows + [rows[5]]


def shingles(text, n=5):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def jaccard_groups(rows, n=5):
    """{doc_id: (n_shingles, smallest id reachable)} by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if 4 * shared >= 3 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def entities(text):
    """(kind, start, end) by the contract's patterns, plainly applied."""

    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    small = lambda p: len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(0, "email", m) for m in _EMAIL.finditer(text or "")]
    found += [(1, "ip", m) for m in _IP.finditer(text or "") if all(small(p) for p in m.group().split("."))]
    found += [(2, "card", m) for m in _CARD.finditer(text or "") if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(3, "phone", m) for m in _PHONE.finditer(text or "") if 9 <= len(digits(m)) <= 15]
    return [(kind, m.start(), m.end()) for _, kind, m in sorted(found, key=lambda f: (f[2].start(), f[0]))]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
