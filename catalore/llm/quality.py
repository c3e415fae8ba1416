"""Line-first cleaning: rules on each line, then a verdict on what is left of the text.

A line fails for its punctuation (no sentence mark at all, shouting, symbols), as
navigation (separators between few words) or as boilerplate (a short line with a stock
phrase). Failing lines are removed; a document is kept while at most MOST_LOST percent
of its words went with them. Before that, the base rules reject documents of under 50
words and those that mostly repeat three-word windows.

Words are runs of characters other than the six ASCII white-space characters, lines end
at \\n. A null text counts as the empty text: no words, base_failed, not kept. Rows are
judged one by one, so that ties and repeated rows need no rule; other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from catalore.llm.common import SPACE, map_texts

LEAST_WORDS = 50
MOST_REPEATED = 50
MOST_LOST = 40

SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
#: Marks of a line that count against its punctuation, and separators of navigation.
LOOSE = [bytes([c]) for c in b"#*$%&<>"]
SEPARATORS = [s.encode() for s in "|>»›•·"]
SENTENCE_MARKS = [s.encode() for s in ".!?…。！？"]
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "uses cookies", "accept cookies", "enable javascript", "lorem ipsum", "click here",
    "sign up for", "subscribe to", "log in to", "read more", "share this", "skip to content",
    "back to top", "page not found", "advertisement",
)
STOCK_PHRASE = re.compile("|".join(BOILERPLATE).encode())
#: Words of a boilerplate line at most.
LONGEST_BOILERPLATE = 30


def fails(line: bytes, words: int) -> bool:
    """Whether a line with words breaks one of the rules."""
    bangs = line.count(b"!")
    loose = sum(line.count(s) for s in LOOSE)
    if 3 * bangs > words + 5 or 3 * loose > words + 5:
        return True
    if not any(mark in line for mark in SENTENCE_MARKS):
        return True
    if 4 * sum(line.count(s) for s in SEPARATORS) > words:
        return True
    return words <= LONGEST_BOILERPLATE and STOCK_PHRASE.search(line.lower()) is not None


def clean(text: str) -> tuple[str, int, int]:
    """The text without failing lines; how many lines and words they had."""
    left, lines, lost = [], 0, 0
    for line in text.encode().split(b"\n"):
        words = len(line.split())
        if words and fails(line, words):
            lines += 1
            lost += words
        else:
            left.append(line)
    return b"\n".join(left).decode(), lines, lost


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    count, covered = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            count += at + 3 - max(at, covered)
            covered = at + 3
    return count


def duplicate_lines(data: bytes) -> int:
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def judge(text: str) -> tuple:
    data = text.encode()
    words = data.split()
    n = len(words)
    repeated = repeated_words(words)
    base_failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    _, lines, lost = clean(text)
    return (
        n,
        len(text) - sum(text.count(c) for c in SPACE),
        sum(data.count(s) for s in SYMBOLS),
        duplicate_lines(data),
        repeated,
        base_failed,
        not base_failed and 100 * lost <= MOST_LOST * n,
        lines,
        lost,
    )


VERDICT = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
    "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean",
    "n_removed_lines": "long", "n_removed_words": "long",
}


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept, and what the line rules removed."""
    return map_texts(docs, lambda texts: [judge(t) for t in texts], VERDICT)


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id and ``clean_text``, the text without failing lines, of the documents kept."""

    def run(texts: list[str]) -> list[tuple]:
        return [(clean(t)[0], judge(t)[6]) for t in texts]

    return map_texts(docs, run, {"clean_text": "string", "kept": "boolean"}).filter("kept").drop(
        "kept"
    )
