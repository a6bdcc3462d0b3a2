"""Pattern text with the word and whitespace rules the results depend on.

Word characters are letters, numbers and underscore of all scripts; whitespace is the
Unicode set below. Java's own ``\\b``, ``\\w`` and ``\\s`` differ (combining marks, digits
such as a superscript two, no-break space), so boundaries are written out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
# Edge next to a character that is known to be a word character.
LEFT = rf"(?<![{WORD}])"
RIGHT = rf"(?![{WORD}])"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]++\z", "")


# The same whitespace as single characters.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def translated(text: Column, swap_from: str, swap_to: str) -> Column:
    """Like ``translate``, which looks up every character; a text without one to exchange is passed on as it is."""
    # single low characters and one range are a quick class, many ranges a slow one; it may say yes too often
    low, high = [[c for c in sorted(set(swap_from)) if (ord(c) < 256) == is_low] for is_low in (True, False)]
    codes = [rf"\x{{{ord(c):x}}}" for c in low] + ([rf"\x{{{ord(high[0]):x}}}-\x{{{ord(high[-1]):x}}}"] if high else [])
    hint = "[" + "".join(codes) + "]"
    return let(text, lambda t: F.when(t.rlike(hint), F.translate(t, swap_from, swap_to)).otherwise(t))


def single_blanks(text: Column, swap_from: str = "", swap_to: str = "") -> Column:
    """Whitespace runs as one blank, after exchanging some characters.

    Only runs of two or more are rewritten: touching every blank costs most of the pass.
    """
    rare = SPACES.replace("\n", "")
    blanks = translated(F.replace(text, F.lit("\n"), F.lit(" ")), swap_from + rare, swap_to + " " * len(rare))
    return F.trim(F.regexp_replace(blanks, "  +", " "))


def quote(word: str) -> str:
    """A literal as pattern text."""
    return "".join("\\" + c if not c.isalnum() and c.isascii() and c != "_" else c for c in word)


def quote_column(word: Column) -> Column:
    """A literal that comes from a column, as pattern text."""
    return F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def any_phrase(phrases) -> str:
    """One pattern that finds any of the phrases between word edges, ignoring case."""
    if not phrases:
        return r"(?!)"
    if all(p and p.isascii() for p in phrases):
        return lexicon_pattern(phrases)  # finds one where the other does, and dismisses most places by a character
    return "(?iu)" + EDGE + "(?:" + "|".join(quote(p) for p in phrases) + ")" + EDGE


def lexicon_pattern(names) -> str:
    """Longest-first alternation over a lexicon, merged on common prefixes.

    A flat alternation tries every name at every word; sharing prefixes makes the cost
    follow the length of the text rather than the number of names.
    """
    tree: dict = {}
    for name in names:
        node = tree
        for char in name.lower():
            node = node.setdefault(char, {})
        node[""] = {}

    def render(node) -> str:
        branches = [quote(c) + render(n) for c, n in sorted(node.items()) if c]
        # At an inner end of a name the longer branches come first.
        if "" in node:
            branches.append(EDGE)
        return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"

    if not tree:
        return r"(?!)"
    # Most positions are dismissed by their first character alone.
    first = "(?=[" + "".join(quote(c) for c in sorted(tree)) + "])"
    left = LEFT if all(c.isalnum() or c == "_" for c in tree) else EDGE
    return "(?iu)" + first + left + render(tree)
