"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Characters removed from free user input.
UNSAFE_CHARACTERS = "<>&\"'\\;"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def truncate_text(c: Column, limit: int, keep: int | None = None, always: bool = False) -> Column:
    """First ``keep`` characters and ``...`` when longer than ``limit`` (or always)."""
    shortened = F.concat(F.substring(c, 1, limit if keep is None else keep), F.lit("..."))
    if always:
        return shortened
    return F.when(F.length(c) > limit, shortened).otherwise(c)


def cell_text(c: Column) -> Column:
    """A sample cell: at most 50 characters, NULL spelled out."""
    return F.coalesce(truncate_text(c, 50, 47), F.lit("NULL"))


def sanitize(c: Column) -> Column:
    return F.coalesce(strip(F.translate(c, UNSAFE_CHARACTERS, "")), F.lit(""))


def highlight_changes(old: Column, new: Column) -> Column:
    marked = F.concat(
        F.lit("~~"),
        F.coalesce(old, F.lit("None")),
        F.lit("~~ → **"),
        F.coalesce(new, F.lit("None")),
        F.lit("**"),
    )
    return F.when(old.eqNullSafe(new), new).otherwise(marked)


def humanize(c: Column) -> Column:
    return F.translate(c, "_", " ")


def title_label(c: Column) -> Column:
    """Capitalise each part between underscores: ``import_failed`` -> ``Import_Failed``."""
    return F.array_join(F.transform(F.split(c, "_"), F.initcap), "_")


def word_count(c: Column) -> Column:
    """Number of runs of non-blank characters.

    Splitting on a single character avoids the regular expression engine, which
    takes several times as long on long texts.
    """
    spaced = F.translate(c, BLANKS, " " * len(BLANKS))
    return F.size(F.array_remove(F.split(spaced, " "), ""))


def has_words(c: Column, least: int) -> Column:
    """At least ``least`` words; stops at the last word needed, however long the text.

    Possessive quantifiers keep the match linear on texts without blanks.
    """
    gap = f"[{BLANKS}]"
    word = f"[^{BLANKS}]"
    return c.rlike(f"^{gap}*+{word}++" + f"{gap}++{word}++" * (least - 1))


def filter_tokens(filter_text: str | None) -> list[str]:
    """Tokens of a comma list; empty tokens are dropped (they would match every name)."""
    return [token.strip() for token in (filter_text or "").split(",") if token.strip()]


def name_matches(c: Column, filter_text: str | None) -> Column:
    """True where the name contains any token of the comma list; no tokens = no filter."""
    tokens = filter_tokens(filter_text)
    if not tokens:
        return F.lit(True)
    matched = c.contains(tokens[0])
    for token in tokens[1:]:
        matched = matched | c.contains(token)
    return matched


def split_tokens(c: Column) -> Column:
    """The comma list of a column as trimmed, non-empty tokens."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda token: token != "")


def name_matches_tokens(c: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda token: F.contains(c, token))
