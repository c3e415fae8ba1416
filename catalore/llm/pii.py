"""Personal data in texts: pattern spans, and spans of a semi-Markov CRF.

Patterns give the base spans of four kinds (email, ip, card, phone); they always stay.
A semi-Markov conditional random field adds spans that the patterns miss: written-out
addresses, phone numbers without a plus sign, cards and IP addresses with other
separators. Its features look at a whole candidate segment (digit groups, separators,
check sums, what stands before and after), and a dynamic programme over the tokens of a
window chooses boundaries and kinds together. A segment has at most LONGEST tokens; a
window has as many entities as fit in. Windows are the places where a segment with a digit
or an at sign can be, everything else is outside anyway; a long one is cut into windows
of WIDEST characters that overlap by more than any segment that is likely.

The field is trained on windows of a bounded sample of documents, by conditional
likelihood. Labels are the base spans; each is also rewritten in the forms that the
patterns do not know, and plain numbers (dates, versions, amounts) are added as
negatives; both also stand in lists. Training is deterministic, and every row is scanned with the weights.

Spans count code points, the end is exclusive; added spans do not overlap base spans or
each other. A null text counts as the empty text and has no spans. With no base span in
the sample the rewritten examples alone train the field. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalore.llm.common import hashed_sample, map_texts, whole_text

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# A match can only start where a run of digits starts; possessive runs keep it linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    doubled = sum(sum(divmod(2 * d, 10)) for d in values[1::2])
    return (sum(values[::2]) + doubled) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> list[Span]:
    """Local part back from each at sign, domain after it; linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = free + len(text[free:at].rstrip(LOCAL))
        if domain and start < at:
            found.append((start, domain.end(), "email"))
            free = domain.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)
    return found


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, each kind leftmost and non-overlapping."""
    found = emails(text) if "@" in text else []
    if not any(d in text for d in "0123456789"):
        return found
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = digits_of(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


# --- the semi-Markov field ---------------------------------------------------------

#: Tokens of a segment at most and characters of one at least; characters of a window, and
#: those that it shares with the next one.
LONGEST, SHORTEST = 24, 7
WIDEST, SHARED = 256, 80
#: Entities that fit in a window; the programme itself does not count them.
MOST_ENTITIES = WIDEST // SHORTEST
#: Documents that the field is trained on at most, and windows of them.
SAMPLE_DOCS = 2_000
SAMPLE_WINDOWS = 200
ROUNDS, RATE, DECAY = 70, 1.0, 1e-4
#: Pieces of a kind that are rewritten for training.
EXAMPLES_OF_KIND = 20
#: Digits of a segment at most; no kind has more than 19.
MOST_DIGITS = 24
#: What must be said for a segment before it becomes a span.
LEAST_PROBABILITY = 0.8

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
#: Written-out at sign and dot.
AT = re.compile(r"@|[\[({]\s?at\s?[\])}]", re.I)
DOT = re.compile(r"\.|[\[({]\s?dot\s?[\])}]", re.I)
NAME = r"[A-Za-z0-9._%+-]+"
ADDRESS = re.compile(
    NAME + r"\x20?(?:@|[\[({]\x20?at\x20?[\])}])\x20?[A-Za-z0-9-]+"
    r"(?:\x20?(?:\.|[\[({]\x20?dot\x20?[\])}])\x20?[A-Za-z0-9-]+)+", re.I
)
#: Windows: runs of number characters with a digit, and places of a possible address.
NUMBERS = re.compile(r"[+(]{0,2}[0-9][0-9 ().+/:-]*+")
AT_PLACE = re.compile(r"@|[\[({]\x20?at\x20?[\])}]", re.I)
ADDRESS_CHARACTERS = re.compile(r"[A-Za-z0-9._%+\-@\[\](){}\x20]*+")
REACH = 80
WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$")
CUES = {
    "email": {"mail", "email", "contact", "write"}, "ip": {"ip", "host", "address", "server"},
    "card": {"card", "visa", "mastercard", "credit", "pan"},
    "phone": {"tel", "phone", "call", "fax", "mobile", "telephone"},
}


def windows(text: str) -> list[tuple[int, int]]:
    """Parts of the text where a segment can be, in order and apart."""
    found = []
    if any(d in text for d in "0123456789"):
        found += [m.span() for m in NUMBERS.finditer(text) if m.end() - m.start() >= SHORTEST]
    lower = text.lower() if any(b in text for b in "[({") else ""
    if "@" in text or "at]" in lower or "at)" in lower or "at}" in lower or "at " in lower:
        for m in AT_PLACE.finditer(text):
            low = max(0, m.start() - REACH)
            before = text[low : m.start()].rstrip(" ")
            start = low + len(before.rstrip(LOCAL))
            end = ADDRESS_CHARACTERS.match(text, m.end(), m.end() + REACH).end()
            found.append((start, end))
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return [
        (at, min(at + WIDEST, end))
        for start, end in merged
        for at in range(start, max(start + 1, end - SHARED), WIDEST - SHARED)
    ]


#: Features of a segment, by kind; the first is the kind's bias.
FEATURES = (
    "bias", "whole", "left_joined", "right_joined", "edge_space", "cue", "plus", "parens",
    "one_separator", "mixed", "digits_7_9", "digits_10_15", "digits_16_19", "digits_few",
    "digits_many", "luhn", "octets", "four_groups", "fours", "area", "address", "letters",
    "short_ends",
)
WIDTH = len(FEATURES)


def features(text: str, start: int, end: int, window: tuple[int, int]) -> dict[str, float]:
    """What the whole segment looks like; shared by the kinds but for cues."""
    piece = text[start:end]
    digits = digits_of(piece)
    groups = re.findall("[0-9]+", piece)
    separators = set(re.findall("[^0-9]+", piece.strip("+()")))
    n = len(digits)
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    letters = any(c.isalpha() for c in piece)
    return {
        "bias": 1.0,
        "whole": float((start, end) == window),
        "left_joined": float(before.isalnum() or before in ("+", "(", "@") and bool(before)),
        "right_joined": float(after.isalnum() or after in (".", "-") and text[end + 1 : end + 2].isalnum()),
        "edge_space": float(piece[:1].isspace() or piece[-1:].isspace()),
        "plus": float(piece[:1] == "+"),
        "parens": float(bool(re.search(r"\([0-9]{2,4}\)", piece))),
        "one_separator": float(len(separators) == 1),
        "mixed": float(len(separators) > 2),
        "digits_7_9": float(7 <= n <= 9 and not letters),
        "digits_10_15": float(10 <= n <= 15 and not letters),
        "digits_16_19": float(16 <= n <= 19 and not letters),
        "digits_few": float(n < 7 and not letters),
        "digits_many": float(n > 19),
        "luhn": float(16 <= n <= 19 and luhn(digits)),
        "octets": float(len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)),
        "four_groups": float(len(groups) == 4 and not letters),
        "fours": float(n == 16 and [len(g) for g in groups] == [4] * 4),
        "area": float([len(g) for g in groups][-3:] == [3, 3, 4]),
        "address": float(bool(ADDRESS.fullmatch(piece))),
        "letters": float(letters),
        "short_ends": float(piece[-1:] in " .(-/:+" or piece[:1] in " .)-/:"),
    }


class Window:
    """Tokens of a window with the features of every candidate segment."""

    def __init__(self, text: str, span: tuple[int, int]) -> None:
        self.text, self.span = text, span
        self.cuts = [span[0]] + [m.end() for m in TOKEN.finditer(text, *span)]
        self.count = len(self.cuts) - 1
        before = WORD_BEFORE.search(text, max(0, span[0] - 24), span[0])
        self.word = before[1].lower() if before else ""
        ends = [text[a] not in " \n" for a in self.cuts[:-1]]
        self.segments, rows = [], []
        for i in range(self.count):
            if not ends[i]:
                continue
            for j in range(i + 1, min(self.count, i + LONGEST) + 1):
                start, end = self.cuts[i], self.cuts[j]
                piece = text[start:end]
                digits = sum(c in "0123456789" for c in piece)
                if digits > MOST_DIGITS:
                    break
                if end - start >= SHORTEST and piece[-1] not in " \n" and (digits >= 4 or AT.search(piece)):
                    self.segments.append((i, j))
                    rows.append(list(self.of(start, end).values()))
        self.ending, self.starting = grouped(self, 1), grouped(self, 0)
        self.rows = np.array(rows, float).reshape(len(rows), WIDTH)
        self.cue = np.array([self.word in CUES[k] for k in KINDS], float)

    def of(self, start: int, end: int) -> dict[str, float]:
        found = features(self.text, start, end, self.span)
        return {name: found.get(name, 0.0) for name in FEATURES}

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Score of every segment for every kind."""
        return self.rows @ weights.T + weights[:, FEATURES.index("cue")] * self.cue


def grouped(window: Window, side: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Segments by their start (0) or end (1): their numbers, and the cuts at the other side."""
    found: dict[int, list[int]] = {}
    for number, segment in enumerate(window.segments):
        found.setdefault(segment[side], []).append(number)
    return {
        cut: (np.array(numbers), np.array([window.segments[n][1 - side] for n in numbers]))
        for cut, numbers in found.items()
    }


def forward(window: Window, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log sums of the labellings before and after each cut."""
    n = window.count
    before, after = np.zeros(n + 1), np.zeros(n + 1)
    total = np.logaddexp.reduce(scores, axis=1)
    for cut in range(1, n + 1):
        before[cut] = before[cut - 1]
        if cut in window.ending:
            numbers, starts = window.ending[cut]
            new = np.logaddexp.reduce(before[starts] + total[numbers])
            before[cut] = np.logaddexp(before[cut], new)
    for cut in range(n - 1, -1, -1):
        after[cut] = after[cut + 1]
        if cut in window.starting:
            numbers, ends = window.starting[cut]
            new = np.logaddexp.reduce(after[ends] + total[numbers])
            after[cut] = np.logaddexp(after[cut], new)
    return before, after


def marginals(window: Window, weights: np.ndarray) -> np.ndarray:
    """Probability of every segment and kind."""
    scores = window.scores(weights)
    before, after = forward(window, scores)
    starts, ends = np.array(window.segments).T
    inside = before[starts] + after[ends]
    return np.exp(scores + inside[:, None] - before[window.count])


def best(window: Window, weights: np.ndarray) -> list[tuple[int, int]]:
    """The likeliest labelling: the number and the kind of each of its segments."""
    scores = window.scores(weights)
    n = window.count
    value, came = np.zeros(n + 1), np.full(n + 1, -1)
    kinds, tops = scores.argmax(axis=1), scores.max(axis=1)
    for cut in range(1, n + 1):
        value[cut] = value[cut - 1]
        if cut in window.ending:
            numbers, starts = window.ending[cut]
            new = value[starts] + tops[numbers]
            top = new.argmax()
            if new[top] > value[cut]:
                value[cut], came[cut] = new[top], numbers[top]
    cut, found = n, []
    while cut > 0:
        number = int(came[cut])
        if number < 0:
            cut -= 1
            continue
        found.append((number, int(kinds[number])))
        cut = window.segments[number][0]
    return found[::-1]


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Spans of the field that overlap no base span."""
    taken, found = sorted(base), []
    for span in windows(text):
        if any(s <= span[0] and span[1] <= e for s, e, _ in near(taken, span)):
            continue
        window = Window(text, span)
        if not window.segments:
            continue
        chosen = best(window, weights)
        if not chosen:
            continue
        sure = marginals(window, weights)
        for number, kind in chosen:
            i, j = window.segments[number]
            start, end = window.cuts[i], window.cuts[j]
            if sure[number, kind] >= LEAST_PROBABILITY and not near(taken, (start, end)):
                # Also the next window must not take a part of it.
                if not found or found[-1][1] <= start:
                    found.append((start, end, KINDS[kind]))
    return found


def near(spans: list[Span], span: tuple[int, int]) -> list[Span]:
    """The spans of a sorted list that overlap ``span``; they are at most a few of each kind."""
    first = bisect_left(spans, (span[0],))
    while first > 0 and any(s[1] > span[0] for s in spans[max(0, first - len(KINDS)) : first]):
        first -= 1
    last = bisect_left(spans, (span[1],))
    return [s for s in spans[first:last] if s[1] > span[0]]


# --- training ----------------------------------------------------------------------

#: Entities that stand in for base spans where the sample has none of a kind.
EXAMPLES = {
    "email": ["ann.lee@mail.example.com", "j.doe@example.org", "sales@shop.example.net"],
    "ip": ["10.12.0.7", "192.168.1.20", "172.16.254.1"],
    "card": ["4111 1111 1111 1111", "5500005555555559", "4012888888881881"],
    "phone": ["+1 (555) 010-4477", "+44 20 7946 0958", "+1 555 010 2233"],
}
#: Numbers that are no personal data.
NEGATIVES = (
    "2024-01-15", "15.01.2024", "12:30:45", "3.10.2", "4.0.1-2", "1 200 500", "19.99", "2023/2024",
    "1234567", "20240115", "1234567890123456", "300.400.500.600", "1-2-3-4", "100-200", "0.123456789",
    "978-3-16-148410-0", "1000000", "12 34 56 78 90 12 34 56 78 90 12", "5555 5555 5555 5555 5555 5555",
    "2001-02-03 04:05:06", "1.2.3.4.5.6.7", "99999999999999999999999", "(2019) 14-22", "10/11/2012",
)


#: What stands between the members of a list, and how many of them a list for training has.
BETWEEN = (" ", " / ", "/", ", ", "; ", "\n", " - ")
LISTED = 5


def lists(pieces: list[str]) -> list[tuple[str, list[tuple[int, int]]]]:
    """LISTED pieces at a time in a text, joined in one of the ways after the other."""
    found = []
    for number in range(0, len(pieces), LISTED):
        between, text, places = BETWEEN[number // LISTED % len(BETWEEN)], "", []
        for piece in pieces[number : number + LISTED]:
            text += between if text else ""
            places.append((len(text), len(text) + len(piece)))
            text += piece
        found.append((text, places))
    return found


def rewritten(piece: str, kind: str) -> list[str]:
    """The piece in forms that the patterns do not know."""
    if kind == "email":
        name, _, domain = piece.partition("@")
        return [f"{name} [at] {domain}", f"{name} (at) {domain.replace('.', ' (dot) ')}",
                f"{name}[at]{domain.replace('.', '[dot]')}"]
    digits = digits_of(piece)
    if kind == "ip":
        return [piece.replace(".", " . ")]
    if kind == "card":
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [".".join(groups), "/".join(groups)]
    tail = digits[-10:]
    if len(tail) < 10:
        return []
    return [f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}",
            f"{tail[:3]}.{tail[3:6]}.{tail[6:]}"]


def examples(sampled: list[str]) -> list[tuple[str, list[Span]]]:
    """Short texts with the spans that they should have."""
    cases: list[tuple[str, list[Span]]] = []
    pieces: dict[str, list[str]] = {kind: list(EXAMPLES[kind]) for kind in KINDS}
    for text in sampled:
        base = base_spans(text)
        for s, e, kind in base:
            if e - s <= 64:
                pieces[kind].append(text[s:e])
        for low, high in windows(text):
            at = max(0, low - 24)
            around = text[at : high + 8]
            inner = [(s - at, e - at, k) for s, e, k in base if at <= s and e <= at + len(around)]
            if len(around) <= 200:
                cases.append((around, inner))
    for kind in KINDS:
        cue = min(CUES[kind])
        for number, piece in enumerate(pieces[kind][:EXAMPLES_OF_KIND]):
            for form in [piece, *rewritten(piece, kind)]:
                lead = f"{cue}: " if number % 3 == 0 else "and "
                cases.append((f"{lead}{form} end", [(len(lead), len(lead) + len(form), kind)]))
        rewrites = [(p, rewritten(p, kind)) for p in pieces[kind][:EXAMPLES_OF_KIND]]
        for forms in zip(*([p, *more] for p, more in rewrites if more)):
            for text, places in lists([f for f in forms for _ in BETWEEN]):
                cases.append((text, [(s, e, kind) for s, e in places]))
    cases += [(text, []) for text, _ in lists([p for p in NEGATIVES for _ in BETWEEN])]
    for piece in NEGATIVES:
        cases += [(f"{lead}{piece}{tail}", []) for lead, tail in (("and ", " end"), ("no. ", "."))]
    return cases


def train(sampled: list[str]) -> np.ndarray:
    """Weights (kind by feature) by gradient ascent on the conditional likelihood."""
    cases = []
    for text, spans in examples(sampled):
        gold = {(s, e): KINDS.index(k) for s, e, k in spans}
        for span in windows(text):
            window = Window(text, span)
            if window.segments:
                truth = np.zeros((len(window.segments), len(KINDS)))
                for number, (i, j) in enumerate(window.segments):
                    kind = gold.get((window.cuts[i], window.cuts[j]))
                    if kind is not None:
                        truth[number, kind] = 1.0
                cases.append((window, truth))
    weights = np.zeros((len(KINDS), WIDTH))
    weights[:, 0] = -2.0
    squares = np.full_like(weights, 1e-6)
    cue = FEATURES.index("cue")
    for _ in range(ROUNDS):
        slope = -DECAY * weights * len(cases)
        for window, truth in cases:
            gap = truth - marginals(window, weights)
            slope += gap.T @ window.rows
            slope[:, cue] += gap.sum(axis=0) * window.cue
        squares += slope**2
        weights += RATE * slope / np.sqrt(squares)
    return weights


def sample(docs: DataFrame) -> list[str]:
    """At most SAMPLE_DOCS texts with a digit or an at sign, by the hash of their content."""
    texts = docs.select(whole_text().alias("text")).filter(
        (F.length("text") <= 20_000) & F.col("text").rlike("[0-9@]")
    )
    picked = hashed_sample(texts, ["text"], SAMPLE_DOCS / max(1, texts.count()), SAMPLE_DOCS)
    parts = picked.mapInArrow(window_texts, "part string").distinct()
    return [row.part for row in parts.orderBy(F.xxhash64("part"), "part").limit(SAMPLE_WINDOWS).collect()]


def window_texts(batches):
    """The surroundings of each window, so that whole texts stay on the executors."""
    import pyarrow as pa

    for batch in batches:
        parts = []
        for text in batch.column(0).to_pylist():
            parts += [text[max(0, s - 24) : e + 24] for s, e in windows(text) if e - s <= 128]
        yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.string())})


def in_order(span: Span) -> tuple[int, int, int]:
    return KINDS.index(span[2]), span[0], span[1]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=in_order))


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans."""
    if weights is None:
        weights = train(sample(docs))

    def scan(texts: list[str]) -> list[tuple]:
        rows = []
        for text in texts:
            base = base_spans(text)
            kinds = [kind for _, _, kind in base]
            added = added_spans(text, base, weights)
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((*map(kinds.count, KINDS), digest, joined(base + added)))
        return rows

    return map_texts(
        docs,
        scan,
        {
            "n_email": "long", "n_ip": "long", "n_card": "long", "n_phone": "long",
            "base_sha256": "string", "spans": "string",
        },
    )
