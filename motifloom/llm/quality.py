"""Line-first quality rules.

Every line is judged on its own by rules of punctuation, navigation and boilerplate.  Lines that fail are removed; a
document that loses more than ``max_loss`` of its word characters by that is rejected, as is one that fails the base
rules on its whole text.

A word is a run of characters other than U+0020 and U+0009 to U+000D.  Null texts count as empty; empty texts have no
words and fail the base rules.  Repeated rows are judged alike and each is returned; an empty table gives no rows.  Of
equal lines the first stays.  A line that breaks several rules counts for the first of navigation, punctuation and
boilerplate.  Very long texts are judged whole, in time that grows with their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# What the rules look for.
TERMINAL = ".!?…。！？؟।:;\"'”’»)]"
SEPARATORS = "|»›•·→>/"
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "general public license",
    "creative commons",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use of cookies",
    "accept cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for",
    "log in to",
    "click here",
    "read more",
    "share this",
    "follow us on",
    "powered by",
    "lorem ipsum",
)


@dataclass(frozen=True)
class Rules:
    """Parameters of the base rules and of the rules for a line."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_loss: float = 0.5
    min_end_words: int = 6  # a line of so many words has to end like a sentence somewhere
    max_mark_ratio: float = 0.3  # of words that carry symbols or repeated marks
    max_upper_ratio: float = 0.6  # of words in capitals
    max_separator_ratio: float = 0.25  # of words that are separators
    max_boilerplate_words: int = 40  # a longer line that holds a phrase of boilerplate is prose about it


def repeat_words(words: list[str]) -> int:
    """How many words lie in a window of three words that occurs at least twice."""
    if len(words) < 4:
        return 0
    ids: dict[str, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    windows = codes[:-1] * len(ids) + codes[1:]
    if len(ids) > 2_000_000:  # else three codes fit in 63 bits
        windows = np.unique(windows, return_inverse=True)[1]
    windows = windows[:-1] * len(ids) + codes[2:]
    _, group, count = np.unique(windows, return_inverse=True, return_counts=True)
    if len(count) == len(windows):
        return 0
    again = count[group] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(windows) + k] |= again
    return int(covered.sum())


class Judge:
    """Judges lines and documents under given rules."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.boilerplate = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE).search
        self.marked = re.compile(rf"[^{re.escape(SPACE)}]*?(?:[#*$%&<>~^=]|[!?]{{2}})[^{re.escape(SPACE)}]*").findall
        self.symbols = re.compile(f"[{re.escape(SYMBOLS)}]").findall
        self.separators = frozenset(SEPARATORS) | {"-", "--", "::", "<<", ">>"}

    def line_failure(self, line: str, words: list[str]) -> str | None:
        """The rule that the line breaks, if any: punctuation, navigation or boilerplate."""
        rules, n = self.rules, len(words)
        if sum(map(self.separators.__contains__, words)) > rules.max_separator_ratio * n:
            return "navigation"
        if len(self.marked(line)) > rules.max_mark_ratio * n:
            return "punctuation"
        if n >= rules.min_end_words:
            if words[-1][-1] not in TERMINAL and not any(w[-1] in TERMINAL for w in words):
                return "punctuation"
            if sum(map(str.isupper, words)) > rules.max_upper_ratio * n:
                return "punctuation"
        if n <= rules.max_boilerplate_words and self.boilerplate(line):
            return "boilerplate"
        return None

    def document(self, text: str) -> dict:
        """Counts, verdicts and the cleaned text of one document."""
        rules = self.rules
        lines = [(line, split_words(line)) for line in text.split("\n")]
        words = [w for _, own in lines for w in own]
        n, repeated = len(words), repeat_words(words)
        seen: set[str] = set()
        duplicates = lost = total = 0
        clean, failed = [], {"punctuation": 0, "navigation": 0, "boilerplate": 0}
        for line, own in lines:
            if not own:
                clean.append(line)
                continue
            size = sum(map(len, own))
            total += size
            failure = self.line_failure(line, own)
            if line in seen:
                duplicates += 1
                failure = failure or "boilerplate"
            seen.add(line)
            if failure:
                failed[failure] += 1
                lost += size
            else:
                clean.append(line)
        base_failed = n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n
        return {
            "n_words": n,
            "word_chars": total,
            "n_symbols": len(self.symbols(text)),
            "n_dup_lines": duplicates,
            "n_repeat_words": repeated,
            "base_failed": base_failed,
            "kept": not base_failed and lost <= rules.max_loss * total,
            "lost_chars": lost,
            "failed_punctuation": failed["punctuation"],
            "failed_navigation": failed["navigation"],
            "failed_boilerplate": failed["boilerplate"],
            "clean_text": "\n".join(clean),
        }


#: Only ASCII white space separates words; str.split() without an argument would split at more.
split_words = re.compile(f"[^{re.escape(SPACE)}]+").findall

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINES = ("lost_chars", "failed_punctuation", "failed_navigation", "failed_boilerplate")
SCHEMA = pa.schema([*((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), *((c, pa.int64()) for c in LINES), ("clean_text", pa.string())])


def judge(docs: DataFrame, rules: Rules = Rules(), *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = True, renamed: bool = False) -> DataFrame:
    """The columns ``keep`` of every row, its counts, ``base_failed``, ``kept``, lines failed by rule and, if asked
    for, ``clean_text``: the text without the lines that failed.  ``renamed``: kept columns get the prefix ``kept_``,
    so that none can clash with these; the text, if among them, is not carried."""
    names = [f.name for f in SCHEMA if with_text or f.name != "clean_text"]
    carried = [c for c in keep if not (renamed and c == text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Judge(rules).document
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [of(t or "") for t in part.column(len(carried)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(carried))), *(pa.array([x[c] for x in found], SCHEMA.field(c).type) for c in names)], names=[*given, *names])

    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    given = [f"kept_{c}" if renamed else c for c in carried]
    types = [f"`{g}` {docs.schema[c].dataType.simpleString()}" for g, c in zip(given, carried)]
    schema = ", ".join([*types, *(f"{c} {kinds[SCHEMA.field(c).type]}" for c in names)])
    # the text once more, under a name that no kept column has
    return docs.select(*(docs[c].alias(g) for c, g in zip(carried, given)), docs[text_col].alias("judged text")).mapInArrow(run, schema)
