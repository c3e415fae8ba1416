"""Token ids of whole texts, each distinct chunk encoded once by a tokenizer library.

A chunk starts at a space with a character other than white space on either side. The
split pattern of byte-level tokenizers always starts a new piece there, so the ids of a
text are those of its chunks one after another. It also starts one between a letter and
a full stop or comma. Most words come again and again, and a chunk that a worker has
seen costs one lookup. Where a pattern makes a single line end between two other characters
a piece by itself, texts are cut there too.
"""

from __future__ import annotations

from collections.abc import Callable

#: Chunks that one worker remembers, and characters of a chunk worth remembering. Others
#: are encoded again; ids do not change.
REMEMBERED = 1_000_000
LONGEST = 64
STOPS = (",", ".")
#: ASCII marks but for the apostrophe; a run of them after letters is a piece by itself.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Runs of white space, and white space other than a space and a line end.
UNEVEN = ("  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))

Encode = Callable[[list[str]], list[bytes]]


def at_edge(piece: str) -> bool:
    """Whether a chunk cannot be cut before or after ``piece``."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


def joined(pieces: list[str]) -> list[str]:
    """Pieces of a split at spaces, put together again where no chunk may be cut."""
    groups, last = [[pieces[0]]], pieces[0]
    for piece in pieces[1:]:
        if not piece or piece[0].isspace() or not last or last[-1].isspace():
            groups[-1].append(piece)
        else:
            groups.append([piece])
        last = piece
    return [" ".join(group) for group in groups]


def lines_of(text: str) -> list[str]:
    """The lines of a text, not cut at line ends beside other white space."""
    lines = text.split("\n")
    if not any(map(at_edge, lines)):
        return lines
    groups, last = [[lines[0]]], lines[0]
    for line in lines[1:]:
        if at_edge(line[:1]) or at_edge(last[-1:]):
            groups[-1].append(line)
        else:
            groups.append([line])
        last = line
    return ["\n".join(group) for group in groups]


#: The key of a line end that is a piece by itself.
LINE_END = ("\n",)


class ChunkIds:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``encode`` turns chunks into such ids. Chunks are remembered without their leading
    space; the first chunk of a text has none and is remembered as a tuple. A full memory
    takes nothing more, and is emptied when most chunks of a call are not in it. With
    ``lines`` a single line end is a piece by itself, and so is any run of marks after letters.
    """

    def __init__(self, encode: Encode, remembered: int = REMEMBERED, lines: bool = False) -> None:
        self.encode, self.remembered, self.known = encode, remembered, {}
        self.ends = dict(zip(STOPS, encode(list(STOPS))))
        self.lines = lines

    def pieces_of(self, text: str) -> list[str | tuple[str]]:
        """The chunks of a text, the first of each line as a tuple."""
        lines = [text]
        # White space is then single spaces and line ends with something on either side.
        plain = text[:1] not in ("", " ", "\n") and text[-1] not in " \n"
        plain = plain and not any(map(text.__contains__, UNEVEN))
        if self.lines and "\n" in text:
            lines = text.split("\n") if plain else lines_of(text)
        pieces: list[str | tuple[str]] = []
        for line in lines:
            found = line.split(" ") if plain else joined(line.split(" "))
            if pieces:
                pieces.append(LINE_END)
            pieces.append((found[0],))
            pieces += found[1:]
        return pieces

    def __call__(self, texts: list[str]) -> list[bytes]:
        # One lookup for each chunk; what it gives stays valid when the memory is emptied.
        known, split, missing, seen = self.known, [], set(), 0
        for text in texts:
            pieces = self.pieces_of(text)
            ids = list(map(known.get, pieces))
            seen += len(pieces)
            gaps = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            chunks = [pieces[i] for i in gaps]
            missing.update(chunks)
            split.append((ids, gaps, chunks))
        found = self.found(missing)
        for ids, gaps, chunks in split:
            for i, chunk in zip(gaps, chunks):
                ids[i] = found[chunk]
        if len(known) + len(found) <= self.remembered:
            known.update({c: x for c, x in found.items() if lasting(c)})
        elif 2 * len(missing) > seen:
            self.known = {}
        return [b"".join(ids) for ids, _, _ in split]

    def stem(self, chunk: str | tuple[str]) -> str | tuple[str] | None:
        """The letters of a chunk of letters and what ends a piece, else None."""
        text = chunk if isinstance(chunk, str) else chunk[0]
        letters = text.rstrip(MARKS) if self.lines else text[:-1] if text[-1:] in self.ends else text
        if len(letters) == len(text) or not letters.isalpha():
            return None
        return letters if isinstance(chunk, str) else (letters,)

    def found(self, missing: set) -> dict:
        """Ids of chunks that are not known; those of marks after a word are added to the word's."""
        stems = {c: stem for c in missing if (stem := self.stem(c))}
        ends = {c: (c if isinstance(c, str) else c[0])[len(s if isinstance(s, str) else s[0]) :] for c, s in stems.items()}
        wanted = missing.difference(stems)
        wanted.update(s for s in stems.values() if s not in self.known)
        listed = list(wanted)
        texts = [c[0] if isinstance(c, tuple) else " " + c for c in listed]
        new_ends = [e for e in set(ends.values()) if e not in self.ends]
        encoded = self.encode(texts + new_ends) if texts or new_ends else []
        found, after = dict(zip(listed, encoded)), dict(zip(new_ends, encoded[len(listed) :]))
        self.ends.update((e, ids) for e, ids in after.items() if len(e) <= 4)
        for c, s in stems.items():
            end = ends[c]
            ids = found[s] if s in found else self.known[s]
            found[c] = ids + (after[end] if end in after else self.ends[end])
        return found


def lasting(chunk: str | tuple[str]) -> bool:
    text = chunk[0] if isinstance(chunk, tuple) else chunk
    return len(text) <= LONGEST and not at_edge(text)
