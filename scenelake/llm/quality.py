"""Quality rules, lines first.

Each line is judged on its own: does it end like a sentence and are its words
free of stray punctuation, is it navigation (separators, arrows, menus), is it
boilerplate (notices, script remnants) or a repetition of an earlier line?
Failing lines are removed. A document is rejected if it fails the whole-text
rules or if too much of its text went with the lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scenelake.llm.common import ASCII_SPACE, arrow_pass, utf8

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in windows that occur twice
SYMBOLS = b"#*$%&|<>"

# A line may hold these shares (of its words) of symbols and of words ending in repeated or stray marks.
LINE_SYMBOLS = 0.3
LINE_STRAY = 0.3
NAVIGATION_MARKS = 2  # separators that make a line a menu, if it has
NAVIGATION_WORDS = 8  # no more words to a separator than these
BOILERPLATE_WORDS = 25  # most words to a mark of boilerplate in a line that is boilerplate
MENU_WORDS = 4  # a line of so few words without a sentence end is a menu entry
LOST = 0.5  # share of the word bytes that may go with removed lines

SENTENCE_END = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"]", "…".encode(), "”".encode(), "»".encode(), "。".encode())
SEPARATORS = (b"|", ">".encode(), "»".encode(), "›".encode(), "•".encode(), "·".encode())
# Phrases between word borders; bytes of other scripts are letters.
BOILERPLATE = re.compile(
    rb"(?<![0-9a-z\x80-\xff])(?:cookies?|javascript|privacy policy|terms of use|terms of service|all rights reserved|"
    rb"lorem ipsum|click here|sign in|log in|subscribe to|newsletters?|skip to content)(?![0-9a-z\x80-\xff])|"
    rb"copyright \(c\)|" + "©".encode())
# Cheap test before the pattern: a line without any of these has no phrase.
HINTS = (b"cookie", b"javascript", b"privacy policy", b"terms of", b"all rights", b"lorem ipsum", b"click here", b"sign in",
         b"log in", b"subscribe to", b"newsletter", b"skip to", b"copyright", "©".encode())

_CONTINUED = bytes(range(0x80, 0xC0))


@dataclass
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:  # keep the combined number below 2**63
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + ids[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    marked = np.zeros(n, dtype=bool)
    for i in range(3):
        marked[i:n - 2 + i] |= twice
    return int(marked.sum())


def measure(text: bytes) -> tuple[Measures, list[bytes], list[bool]]:
    """Measures, lines, and whether each line repeats an earlier one."""
    words = text.split()
    lines, seen, again = text.split(b"\n"), set(), []
    for line in lines:
        has_word = bool(line.strip(ASCII_SPACE))
        again.append(has_word and line in seen)
        if has_word:
            seen.add(line)
    return Measures(
        len(words), len(text.translate(None, ASCII_SPACE + _CONTINUED)), len(text) - len(text.translate(None, SYMBOLS)),
        sum(again), repeated_words(words)), lines, again


def line_rule(line: bytes) -> str | None:
    """The rule a line fails, or None; lines without a word fail nothing."""
    words = line.split()
    if not words:
        return None
    n = len(words)
    marks = sum(line.count(mark) for mark in SEPARATORS)
    if marks >= NAVIGATION_MARKS and n <= NAVIGATION_WORDS * marks:
        return "navigation"
    stripped = line.strip(ASCII_SPACE)
    ends = stripped.endswith(SENTENCE_END)
    if not ends and n <= MENU_WORDS:
        return "navigation"
    # Marks weigh by the words they stand among: a single one does not condemn a long line.
    low = line.lower()
    marks = (len(BOILERPLATE.findall(low)) if any(hint in low for hint in HINTS) else 0) + min(line.count(b"{"), line.count(b"}"))
    if marks and n <= BOILERPLATE_WORDS * marks:
        return "boilerplate"
    if len(line) - len(line.translate(None, SYMBOLS)) > LINE_SYMBOLS * n:
        return "punctuation"
    stray = sum(w[-1:] in b"!?#*$%&~^=" and len(w) > 1 and w[-2:-1] in b"!?#*$%&~^=" for w in words)
    if stray > LINE_STRAY * n and stray > 1:
        return "punctuation"
    if not ends and n < LEAST_WORDS // 10:
        return "punctuation"
    return None


def clean(lines: list[bytes], again: list[bool]) -> tuple[list[bytes], int, int]:
    """(kept lines, bytes of words, bytes of words in removed lines)."""
    kept, total, lost = [], 0, 0
    for line, repeats in zip(lines, again):
        size = len(line.translate(None, ASCII_SPACE))
        total += size
        if repeats or line_rule(line) is not None:
            lost += size
        else:
            kept.append(line)
    return kept, total, lost


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed, kept, cleaned (the text that is left).

    Null and empty texts have no words, fail and are not kept; repeated rows get
    equal verdicts; further columns are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            rows, failed, kept, cleaned = [], [], [], []
            for text in batch.column(1).to_pylist():
                found, lines, again = measure(text or b"")
                left, total, lost = clean(lines, again)
                rows.append(found)
                failed.append(found.failed)
                kept.append(not found.failed and lost <= LOST * total)
                cleaned.append(None if text is None else b"\n".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([getattr(r, n) for r in rows], pa.int64()) for n in names],
                 pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(cleaned, pa.string())],
                ["doc_id", *names, "base_failed", "kept", "cleaned"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_pass(docs.select("doc_id", utf8()), run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names)
                      + ", base_failed boolean, kept boolean, cleaned string")
