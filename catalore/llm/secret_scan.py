"""Secrets in texts, also below nested encodings.

Every text is scanned for three kinds of secret (assign, access, hex). A worklist then
holds its layers: lines with URL or Unicode escapes are unescaped, runs of base64 (in one
line, or wrapped at one width over several, also behind a separator that base64 uses as
well) are decoded and, where they hold compressed streams (one or several, one after the
other or one in another), decompressed, up to where a stream breaks. Text may have one or
two bytes a character. Each layer is scanned like the text, and unwrapped again,
until no new layer appears. A layer that was seen at the same place before is not taken
again, which ends cycles. Every character of a layer knows the part of the text that it
comes from, so that what is found below goes back as a span of the text; a decompressed
character comes from all streams of its run. Bytes that are not UTF-8 are replaced, and what
is around them is scanned; escapes of such bytes stay.

Spans count code points, the end is exclusive. Of equal texts each row is scanned. A
null text counts as the empty text and has no spans. Other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame

from catalore.llm.common import map_texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
)
#: One of these is in the lower-case text wherever ASSIGN matches.
NAMES = ("passw", "secret", "token", "api_key", "apikey")
LEAST_VALUE = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ACCESS = 16
# A maximal run of at least 32 is what is left of all runs once short ones are dropped.
HEX = re.compile(r"[0-9a-f]{32,}")

#: An escape whose percent sign was escaped again and again is taken at once, so that the
#: number of layers does not grow with the length of such a chain.
PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
#: The same for a backslash that was escaped again and again.
BACKSLASH = r"(?:u005[Cc]|U0000005[Cc]|u\{0{0,4}5[Cc]\}|x5[Cc])"
UNICODE = re.compile(
    r"\\" + BACKSLASH + r"*(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2}))"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
LEAST_RUN = 16
#: Characters of base64 that also part words, and how compressed streams start behind one.
SEPARATOR = re.compile("[/_+-]")
PACKED = re.compile(r"[/_+-](?=(H4sI|eJ|eN|eA|Qlpo|_Td6|/Td6|KLUv))")
#: What stands between lines of base64, and a last line, alone on its line from there on.
LINE_END = re.compile(r"[ \t]*\r?\n[ \t]*")
LAST_LINE = re.compile(r"[A-Za-z0-9+/_-]++={0,2}(?=[\"'`,;)\]}]*[ \t]*(?:\r?\n|\Z))")
#: How wrong bytes stand in a text, and the characters that a text has few of.
WRONG = re.compile("[\udc80-\udcff]")
UNREADABLE = re.compile("[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f\x7f-\x9f\ufffd]")
#: A run of base64 with a larger share of these counts as a layer only with a secret in it;
#: it is scanned and unwrapped all the same.
MOST_UNREADABLE = 1 / 8
#: A stream that unpacks to more is left packed and counted; it guards workers' memory.
MOST_UNPACKED = 1 << 26

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the three kinds, each leftmost and non-overlapping."""
    found = []
    lower = text.lower()
    if any(name in lower for name in NAMES):
        found += [
            (m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
            if len(m[2]) >= LEAST_VALUE
        ]
    if "AKIA" in text:
        found += [
            (m.start(), m.end(), "access") for m in ACCESS.finditer(text)
            if m.end() - m.start() >= LEAST_ACCESS
        ]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


class Layer:
    """A text and where its characters come from: pieces (at, start, end, step).

    From position ``at`` on, a piece with step 1 runs along the source from ``start``;
    with step 0 every character of it comes from ``start`` to ``end``. A layer that is not
    ``sure`` may be no encoded text at all; it is counted only if there is something in it.
    """

    def __init__(
        self, text: str, pieces: list[tuple[int, int, int, int]], sure: bool = True
    ) -> None:
        self.text, self.pieces, self.sure = text, pieces, sure
        self.ats = [p[0] for p in pieces]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The part of the text that characters ``start`` to ``end`` come from."""
        first, last = (self.pieces[bisect_right(self.ats, i) - 1] for i in (start, end - 1))
        low = first[1] + (start - first[0]) * first[3]
        high = last[1] + end - last[0] if last[3] else last[2]
        return low, high

    def joined(self, parts: list[tuple[int, int]]) -> Layer:
        """Parts of the text one after the other, with the sources they have."""
        pieces, at = [], 0
        for low, high in parts:
            while low < high:
                number = bisect_right(self.ats, low) - 1
                piece = self.pieces[number]
                until = min(high, self.ats[number + 1] if number + 1 < len(self.ats) else high)
                pieces.append((at, piece[1] + (low - piece[0]) * piece[3], piece[2], piece[3]))
                at += until - low
                low = until
        return Layer("".join(self.text[low:high] for low, high in parts), pieces)


def unescaped(layer: Layer, pattern: re.Pattern, value, start: int, end: int) -> Layer | None:
    """Characters ``start`` to ``end`` with the escapes replaced that ``value`` can read."""
    text, parts, pieces, at, done = layer.text, [], [], 0, start

    def plain(low: int, high: int) -> int:
        """Characters that stay keep the sources they have."""
        nonlocal at
        kept = layer.joined([(low, high)])
        pieces.extend((at + p[0], *p[1:]) for p in kept.pieces)
        parts.append(kept.text)
        at += high - low
        return high

    changed = False
    for match in pattern.finditer(text, start, end):
        for low, high, new in value(match):
            if new is None:
                continue
            changed = True
            plain(done, low)
            pieces.append((at, *layer.source(low, high), 0))
            parts.append(new)
            at += len(new)
            done = high
    if not changed:
        return None
    plain(done, end)
    return Layer("".join(parts), pieces)


def percent_value(match: re.Match):
    """One part for each character that bytes of the run spell in UTF-8; others stay escaped."""
    escapes = list(ESCAPE.finditer(match.string, match.start(), match.end()))
    at = 0
    for character in bytes(int(e[1], 16) for e in escapes).decode("utf-8", "surrogateescape"):
        until = at + size_of(character)
        yield escapes[at].start(), escapes[until - 1].end(), None if WRONG.match(character) else character
        at = until


def size_of(character: str) -> int:
    """Bytes of a character; one that stands for a wrong byte has one."""
    return len(character.encode("utf-8", "surrogateescape"))


def unicode_value(match: re.Match):
    number = int(match[match.lastindex], 16)
    valid = number < 0x110000 and not 0xD800 <= number < 0xE000
    yield match.start(), match.end(), chr(number) if valid else None


#: What a stream that cannot be read raises.
BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)
ZSTANDARD = b"\x28\xb5\x2f\xfd"
#: Bytes of a zstandard frame that are fed at once; they unpack to a few MB at most. And of
#: a stream that breaks, to find what it holds before that.
FED = 64
FED_BROKEN = 512


def unpacker_of(raw: bytes):
    """What unpacks the compressed stream that ``raw`` starts with, if there is one."""
    if raw[:2] == b"\x1f\x8b" or is_zlib(raw[:2]):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=1 << 28)
    if raw.startswith(ZSTANDARD):
        return zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
    return None


def is_zlib(head: bytes) -> bool:
    """Whether two bytes are the header of a zlib stream, of any window and level."""
    return len(head) == 2 and head[0] & 15 == 8 and head[0] < 0x80 and int.from_bytes(head, "big") % 31 == 0


def before_break(raw: bytes, most: int) -> bytes:
    """What a stream gives before it breaks, or before its check sum turns out wrong."""
    unpacker, parts, size = unpacker_of(raw), [], 0
    # The last bytes one by one: a wrong check sum takes nothing that came before it.
    cuts = [*range(0, max(0, len(raw) - 16), FED_BROKEN), *range(max(0, len(raw) - 16), len(raw))]
    try:
        for at, to in zip(cuts, [*cuts[1:], len(raw)]):
            parts.append(unpacker.decompress(raw[at:to]))
            size += len(parts[-1])
            if size >= most or unpacker.eof:
                break
    except BROKEN:
        pass
    return b"".join(parts)


def member(unpacker, raw: bytes, most: int) -> tuple[bytes, bytes]:
    """What the first stream of ``raw`` holds, ``most`` bytes or a little more, and what follows."""
    if not raw.startswith(ZSTANDARD):
        found = unpacker.decompress(raw, most)
        return found, unpacker.unused_data if unpacker.eof else b""
    parts, size, at = [], 0, 0
    while at < len(raw) and size < most and not unpacker.eof:
        parts.append(unpacker.decompress(raw[at : at + FED]))
        size, at = size + len(parts[-1]), at + FED
    return b"".join(parts), unpacker.unused_data + raw[at:] if unpacker.eof else b""


def unpacked(raw: bytes) -> bytes | None:
    """What the compressed streams of ``raw`` hold, one after the other; None if it starts with none.

    Zeros between the streams are padding; other bytes after the last one stay as they are.
    """
    parts, left = [], MOST_UNPACKED + 1
    while left > 0 and (unpacker := unpacker_of(raw)):
        try:
            found, raw = member(unpacker, raw, left)
        except BROKEN:
            if not (found := before_break(raw, left)):
                break
            raw = b""
        parts.append(found)
        left -= len(found)
        raw = raw.lstrip(b"\0")
    return b"".join([*parts, raw]) if any(parts) else None


def wide(raw: bytes) -> str | None:
    """The encoding of text in two bytes a character: by its mark, or zeros in every other byte."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16-le" if raw[0] == 0xFF else "utf-16-be"
    half = len(raw) // 2
    for encoding, high, low in (("utf-16-le", 1, 0), ("utf-16-be", 0, 1)):
        if half >= 8 and raw[high::2].count(0) > 0.6 * half and raw[low::2].count(0) < 0.1 * half:
            return encoding
    return None


def is_text(text: str) -> bool:
    """Whether the share of unreadable characters is small enough."""
    return len(UNREADABLE.findall(text)) <= MOST_UNREADABLE * len(text)


def decoded(layer: Layer, start: int, end: int) -> tuple[Layer | None, bool]:
    """The layer in a run of base64, and whether it was too large to unpack."""
    run = layer.text[start:end].rstrip("=")
    if len(run) % 4 == 1:  # one character too many holds no whole byte
        run = run[:-1]
        end = start + len(run)
    try:
        raw = base64.b64decode(run.translate({45: "+", 95: "/"}) + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return None, False
    whole = layer.source(start, end)
    inner, before = unpacked(raw), {hashlib.sha256(raw).digest()}
    while inner is not None and len(inner) <= MOST_UNPACKED:
        # A stream can unpack to itself; all others end.
        if (digest := hashlib.sha256(inner).digest()) in before:
            break
        before.add(digest)
        deeper = unpacked(inner)
        if deeper is None:
            break
        inner = deeper
    if inner is not None:
        if len(inner) > MOST_UNPACKED:
            return None, True
        return Layer(inner.decode(wide(inner) or "utf-8", "replace"), [(0, *whole, 0)]), False
    encoding = wide(raw)
    text = raw.decode(encoding, "replace") if encoding else raw.decode("utf-8", "surrogateescape")
    pieces, byte = [], 0
    for at, character in enumerate(text):
        size = (2 if character < "\U00010000" else 4) if encoding else size_of(character)
        low = start + byte * 4 // 3
        high = start + -(-(byte + size) * 4 // 3)
        pieces.append((at, *layer.source(low, min(high, end)), 0))
        byte += size
    text = WRONG.sub("\ufffd", text)
    return Layer(text, pieces, is_text(text)), False


def out_of_step(layer: Layer, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts of a run that may be base64 behind other text of the same characters.

    Behind a separator base64 starts in one of four steps, and the other three read it too;
    compressed streams have to be read from their first character.
    """
    text = layer.text
    separator = SEPARATOR.search(text, start, end)
    if not separator:
        return
    for step in (1, 2, 3):
        if end - start - step >= LEAST_RUN:
            yield start + step, end
    for match in PACKED.finditer(text, start, end):
        if end - match.start(1) >= LEAST_RUN:
            yield match.start(1), end


def wrapped(layer: Layer, runs: list[tuple[int, int]]) -> Iterator[Layer]:
    """Base64 over several lines as one run: runs of equal length, and a shorter last one."""
    text, number = layer.text, 0
    while number < len(runs):
        lines = [runs[number]]
        width = lines[0][1] - lines[0][0]
        number += 1
        while text[lines[-1][1] - 1] != "=" and (between := LINE_END.match(text, lines[-1][1])):
            start = between.end()
            if number < len(runs) and runs[number] == (start, start + width):
                lines.append(runs[number])
                number += 1
                continue
            last = LAST_LINE.match(text, start)
            if last and last.end() - start < width and not last[0].startswith("--"):
                lines.append(last.span())
            break
        if len(lines) > 1:
            # A last line that does not fit is no part of it.
            if (sum(high - low for low, high in lines) - text.count("=", *lines[-1])) % 4 == 1:
                lines.pop()
            yield layer.joined(lines)


def lines_with(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Start and end of the lines that ``pattern`` occurs in."""
    found, at = [], 0
    while match := pattern.search(text, at):
        start = text.rfind("\n", 0, match.start()) + 1
        end = text.find("\n", match.end())
        end = len(text) if end < 0 else end
        found.append((start, end))
        at = end
    return found


def all_spans(text: str, base: list[Span]) -> tuple[list[Span], int, int]:
    """Base spans with those of all layers; how many layers there were, and oversize ones."""
    spans, layers, oversize = set(base), 0, 0
    work = deque([Layer(text, [(0, 0, len(text), 1)])])
    seen: set[tuple] = set()
    while work:
        layer = work.popleft()
        inner: list[Layer | None] = []
        for escape, pattern, value in (("%", PERCENT, percent_value), ("\\", UNICODE, unicode_value)):
            if escape in layer.text:
                inner += [
                    unescaped(layer, pattern, value, *line)
                    for line in lines_with(layer.text, pattern)
                ]
        runs = [match.span() for match in BASE64.finditer(layer.text)]
        for source, run in [(layer, r) for r in runs] + [
            (lines, (0, len(lines.text))) for lines in wrapped(layer, runs)
        ]:
            found, large = decoded(source, *run)
            inner.append(found)
            oversize += large
            if found is None or not found.sure:
                for part in out_of_step(source, *run):
                    other, large = decoded(source, *part)
                    inner.append(other)
                    oversize += large
        for found in inner:
            if found is None:
                continue
            if not found.text:
                continue
            digest = hashlib.sha256(found.text.encode("utf-8", "surrogatepass")).digest()
            place = (*found.source(0, len(found.text)), digest)
            if place in seen:
                continue
            seen.add(place)
            work.append(found)
            inside = base_spans(found.text)
            layers += found.sure or bool(inside)
            spans.update((*found.source(s, e), kind) for s, e, kind in inside)
    return sorted(spans, key=in_order), layers, oversize


def in_order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(texts: list[str]) -> list[tuple]:
    rows = []
    for text in texts:
        base = sorted(base_spans(text), key=in_order)
        kinds = [kind for _, _, kind in base]
        spans, layers, oversize = all_spans(text, base)
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        rows.append((*map(kinds.count, KINDS), digest, joined(spans), layers, oversize))
    return rows


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, layers and oversize layers."""
    return map_texts(
        docs,
        scan,
        {
            "n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string",
            "spans": "string", "n_layers": "long", "n_oversize": "long",
        },
    )
