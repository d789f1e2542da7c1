"""Very many patterns over texts: an index from what a match must contain to the patterns, which then run only there.

Of each alternative of a pattern a literal is found that every match contains, and of that literal one gram of three
characters. A text's grams are met with the index; only patterns with a literal in the text are run. The work on a text
hardly depends on how many patterns there are. A pattern without such a literal is run on every text. The index is as
large as what the user configured; rows are not shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import norm

GRAM = 3
#: Characters whose other case depends on what stands around them or on the language.
_UNCERTAIN = frozenset("σςΣıİ")


def alternatives(pattern: str) -> list[str] | None:
    """Alternatives of a pattern, cut at the bars outside its groups and classes; None for what is not understood."""
    if "\\Q" in pattern or "(?x" in pattern or "&&" in pattern:
        return None
    out, depth, cut, i, in_class = [], 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]" or i == begin + 1
        elif c == "[":
            in_class, begin = True, i + (pattern[i + 1 : i + 2] == "^")
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[cut:i])
            cut = i + 1
        i += 1
    return None if depth or in_class else [*out, pattern[cut:]]


def literals(alternative: str) -> list[str]:
    """Runs of characters that every match of an alternative contains as they stand, in either case.

    What lies in groups and classes is left out, and so is a character that may be absent or that repeats.
    """
    runs, run, i = [], "", 0

    def close(text: str) -> str:
        runs.append(text)
        return ""

    while i < len(alternative):
        c = alternative[i]
        if c == "\\":
            nxt = alternative[i + 1 : i + 2]
            i += 2
            if nxt.isalnum() or not nxt:
                run = close(run)
                # Escapes with arguments, in braces or as digits.
                if nxt and nxt in "pPxkNc" and alternative[i : i + 1] in ("{", "<"):
                    i = max(alternative.find("}" if alternative[i] == "{" else ">", i), i) + 1
                else:
                    i += {"x": 2, "u": 4, "0": 3, "c": 1, "p": 1, "P": 1}.get(nxt, 0)
                continue
            c = nxt
        elif c in "[(":
            run, i = close(run), _past(alternative, i)
            continue
        elif c in "?*{":
            # The character before may be absent, or stand any number of times.
            run = close(run[:-1])
            i = alternative.find("}", i) + 1 if c == "{" else i + 1
            continue
        elif c in "+.^$":
            run, i = close(run), i + 1
            continue
        else:
            i += 1
        # No literal holds a character whose other case is uncertain or longer.
        run = close(run) if c in _UNCERTAIN or len(c.upper()) + len(c.lower()) != 2 else run + c
    close(run)
    return [r for r in runs if r]


def _past(pattern: str, i: int) -> int:
    """The place behind a group or class that begins at ``i``."""
    depth, begin, in_class = 0, i, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]" or i == begin + 1
        elif c == "[":
            in_class, begin = True, i + (pattern[i + 1 : i + 2] == "^")
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        i += 1
        if not depth and not in_class:
            return i
    return i


def folded(text: Column) -> Column:
    """A text in one case, as patterns that ignore case compare it."""
    return F.lower(F.upper(text))


class PatternIndex:
    """Which of many patterns a text matches, case ignored, as ``norm.matches`` decides for each."""

    def __init__(self, patterns: Sequence[str]):
        self.patterns = list(patterns)
        self.literals: list[list[str]] = []  # of each pattern one for each alternative; none: it is always run
        for p in self.patterns:
            found = []
            for alternative in alternatives(p) or [""]:
                longest = max((x.upper().lower() for x in literals(alternative)), key=len, default="")
                found.append(longest)
            self.literals.append(found if all(len(x) >= GRAM for x in found) else [])
        grams = lambda x: {x[i : i + GRAM] for i in range(len(x) - GRAM + 1)}
        held = Counter(g for found in self.literals for x in found for g in grams(x))
        self.index: dict[str, list[int]] = {}
        for i, found in enumerate(self.literals):
            for x in found:
                gram = min(grams(x), key=lambda g: (held[g], g))
                if i not in self.index.setdefault(gram, []):
                    self.index[gram].append(i)

    @property
    def always(self) -> list[int]:
        """Patterns that are run on every text."""
        return [i for i, found in enumerate(self.literals) if not found]

    def matched(self, rows: DataFrame, text: Column, into: str) -> DataFrame:
        """Rows with the numbers of the patterns that a text matches in the column ``into``, ascending; none for null.

        The index goes to every task as one broadcast row, since a literal inside a lambda would be made anew each time.
        """
        # Grams share buckets by their crc32; what a bucket has too much is sorted out by the literals.
        buckets: list[set[int]] = [set() for _ in range(1 << (4 * len(self.index)).bit_length())]
        for gram, found in self.index.items():
            buckets[crc32(gram.encode()) % len(buckets)].update(found)
        held = ([sorted(b) for b in buckets], self.literals, [norm.IGNORE_CASE + p for p in self.patterns], self.always)
        schema = "_buckets array<array<int>>, _literals array<array<string>>, _patterns array<string>, _always array<int>"
        table = rows.sparkSession.createDataFrame([held], schema)
        place = lambda g: (F.crc32(g.cast("binary")) % len(buckets)).cast("int") + 1
        literal = lambda i: F.exists(F.element_at("_literals", i + 1), lambda w: F.contains("_folded", w))
        grams = F.regexp_extract_all("_folded", F.lit("(?s)(?=(" + "." * GRAM + "))"), F.lit(1))
        met = F.array_distinct(F.flatten(F.transform(grams, lambda g: F.element_at("_buckets", place(g)))))
        candidates = F.concat("_always", F.filter(met, literal))
        hits = F.filter(candidates, lambda i: F.regexp_like("_text", F.element_at("_patterns", i + 1)))
        out = rows.withColumns({"_text": text, "_folded": folded(text)}).crossJoin(F.broadcast(table))
        out = out.withColumn(into, F.coalesce(F.sort_array(hits), F.array().cast("array<int>")))
        return out.select(*rows.columns, into)
