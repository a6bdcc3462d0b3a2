"""Candidate patterns for each indicator type, written for text with single blanks.

The languages matched are fixed. Where a plain pattern would backtrack over a whole run
of labels (deep recursion in java.util.regex, quadratic time), it is written with
possessive groups that can only stop where a match may end.
"""

from __future__ import annotations

from ..fixed_values import FILE_EXTENSIONS
from .textmatch import EDGE, LEFT, RIGHT, WORD

# Shapes of the indicator types.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
DOT = r"(?:\[\.]|\(\.\)|\.)"
SCHEME = r"(?:hxxps?|https?|ftps?)"

URL = rf"(?iu)(?=[hf]){LEFT}{SCHEME}://[^\s/$.?#].\S*{EDGE}"
IPV4 = rf"(?=[0123456789]){LEFT}(?:{OCTET}(?:\[\.\]|\.| )){{3}}{OCTET}{RIGHT}"
HASH = rf"(?=[abcdefABCDEF0123456789]){LEFT}(?:[a-fA-F0-9]{{64}}|[a-fA-F0-9]{{40}}|[a-fA-F0-9]{{32}}){RIGHT}"
CVE = rf"(?iu)(?=c){LEFT}CVE-(?:1999|2\p{{Nd}}{{3}})-(?:0\p{{Nd}}{{2}}[1-9]|[1-9]\p{{Nd}}{{3,}}){RIGHT}"
EMAIL = rf"(?iu){EDGE}[a-zA-Z0-9._%+-]++(?:@|\[@])[a-zA-Z0-9.-]+(?:\[\.]|\.)[a-zA-Z]{{2,24}}{RIGHT}"

# Labels followed by the last top-level part that ends at a word edge.
_STEP = rf"[a-zA-Z0-9][a-zA-Z0-9-]{{0,62}}+(?<!-){DOT}"
_TOP = rf"[a-zA-Z]{{2,24}}+{RIGHT}"
_LABELS = rf"(?:(?:{_STEP}(?!{_TOP}))*+{_STEP}(?={_TOP}))++{_TOP}"
# Not behind "@" or inside a word; a label right behind another one was already tried
# from there.
_BEHIND = rf"(?:(?<![.\])])|(?<!(?<![@{WORD}]){LABEL}{DOT}))"
DOMAIN = rf"(?<![@{WORD}])(?={_STEP}){_BEHIND}{_LABELS}"

# A run up to the first listed extension before a blank, comma, semicolon or the end. Only
# the start of a run, or the end of the match before, can start one.
_EXTENSION = rf"\.(?:{'|'.join(FILE_EXTENSIONS)})"
FILE = rf'(?iu)(?:\G|(?<=[\s"]))[^\s"]+?{_EXTENSION}(?=[\s,;]|\z)'

# Words in which, and across which, nothing but a URL can match: no digit, no dot but at their end, and too short for
# a hash. Many in a row, from the start of a word; only a blank ends a word in normalised text.
DULL = r"(?<![^ ])(?:[^ .0123456789]{0,31}+[.,;:\"')\]]*+ ){3,}+"

URL_ONLY = rf"^(?:{URL})\z"
DOMAIN_ONLY = rf"^(?:{_LABELS})\z"
FILE_ONLY = rf'(?iu)^[^\s"]+{_EXTENSION}\z'

# Cheap conditions without which the pattern cannot match; they only save work.
DOMAIN_HINT = rf"[.\])]{_TOP}"
FILE_HINT = rf"(?iu){_EXTENSION}(?=[\s,;]|\z)"
IPV4_HINT = r"[0-9](?:\.|\[\.]| )[0-9]"
HASH_HINT = r"[a-fA-F0-9]{32}"
CVE_HINT = r"[cC][vV][eE]-"
