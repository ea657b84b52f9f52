"""Patterns of the template key, spelled for java.util.regex.

The word edges are ASCII-only lookarounds because Java's own word boundary
follows Unicode letters. Matching these patterns is most of the work of a
distillation, so what several alternatives begin with is tested once.
"""

from __future__ import annotations

import re

# Word lists, patterns and their order decide the template key.
LEVELS = ["debug", "info", "notice", "warn(?:ing)?", "error", "critical", "alert", "emergency"]
LEVEL_NAMES = ["DEBUG", "INFO", "NOTICE", "WARN", "WARNING", "ERROR", "CRITICAL", "ALERT", "EMERGENCY"]
DATES = [
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
    r"\d{4}/\d{2}/\d{2}",
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{4}/\d{2}",
    r"\d{2}-\d{4}-\d{2}",
    r"\d{4}/\d{2}",
    r"\d{4}-\d{2}",
    r"\d{2}/\d{4}",
    r"\d{2}-\d{4}",
    r"\d{2}:\d{2}:\d{2}",
    # lookbehind and possessive + only spare retries inside one run of letters
    r"(?<![a-z])[a-z]++[\t\n\f\r ]\d{1,2},[\t\n\f\r ]\d{4}",
]
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
ID_DIGITS = r"\d{1,9}"
SPACE = r"\s\x{85}\p{Z}"
# The same class as characters: Unicode White_Space.
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_LEFT, _RIGHT = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def _after_two_digits(pattern: str) -> str:
    if pattern.startswith(r"\d{4}"):
        return r"\d{2}" + pattern.removeprefix(r"\d{4}")
    return pattern.removeprefix(r"\d{2}")


*_NUMERIC, _MONTH = DATES
DATE = rf"\d{{2}}(?:{'|'.join(map(_after_two_digits, _NUMERIC))})|{_MONTH}"
LEVEL = f"(?i)(?=[{''.join(word[0] for word in LEVELS)}]){_LEFT}(?:{'|'.join(LEVELS)}){_RIGHT}"
IP = f"{_LEFT}{IPV4}{_RIGHT}"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_STRICT_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = "[0-9A-Fa-f]{1,4}"
# Every IPv6 spelling: 8 groups, or fewer around one "::", the last two groups
# optionally written as a dotted quad.
_V6 = "|".join(
    [f"(?:{_H}:){{7}}{_H}", f"(?:{_H}:){{6}}{_STRICT_V4}"]
    + [f"(?:{_H}(?::{_H}){{0,{n}}})?::(?:{_H}(?::{_H}){{0,{5 - n}}})?" for n in range(6)]
    + [f"(?:{_H}(?::{_H}){{0,6}})::"]
    + [f"(?:{_H}(?::{_H}){{0,{n}}})?::(?:{_H}:){{0,{4 - n}}}{_STRICT_V4}" for n in range(5)]
)
_MASK_V4 = "/0*(?:3[0-2]|[12]?[0-9])"
_MASK_V6 = "/0*(?:12[0-8]|1[01][0-9]|[1-9]?[0-9])"
# An address, or a block whose address part is wanted.
IP_TOKEN = f"(?:{_STRICT_V4}(?:{_MASK_V4})?|(?:{_V6})(?:{_MASK_V6})?)"
_END_OF_TOKEN = f"(?![^{SPACE}])"
# Only as a whole blank-separated token; the first lookaheads turn words away early.
LONE_IP = (
    f"(?=[0-9A-Fa-f]{{0,4}}[.:])(?<![^{SPACE}])(?=[0-9A-Fa-f.:]+(?:/[0-9]+)?{_END_OF_TOKEN})"
    f"{IP_TOKEN}{_END_OF_TOKEN}"
)


def literal(text: str) -> str:
    """Quote ``text`` for both Java and RE2."""
    return re.sub(r"([^0-9A-Za-z_\s])", lambda m: "\\" + m[1] if ord(m[1]) < 128 else m[1], text)


def log_id(id_log: str) -> str:
    return literal(id_log + "_") + ID_DIGITS


def any_word(words) -> str:
    """A pattern that finds, at each position, the first word of the list that stands there.

    Words share their beginnings in a prefix tree, so a position costs about the length of what
    matches there, however long the list. A word that begins with an earlier one never gets its turn
    and is left out; what remains below a word comes before it in the list, so
    the longest match is the right one.
    """
    tree: dict = {}
    for word in filter(None, words):
        node = tree
        for char in word:
            if _END in node:
                break
            node = node.setdefault(char, {})
        else:
            node[_END] = {}
    if not tree:
        return ""
    firsts = "".join(map(_in_class, tree))
    return f"(?=[{firsts}]){_below(tree)}"


_END = ""


def _in_class(char: str) -> str:
    return f"\\x{{{ord(char):x}}}"


def _below(node: dict) -> str:
    """What may follow in the prefix tree; greedy, as the longest match is wanted."""
    letters = [char for char, child in node.items() if char and set(child) == {_END}]
    longer = [literal(char) + _chain(child) for char, child in node.items() if char and set(child) != {_END}]
    if len(letters) == 1:
        longer.append(literal(letters[0]))
    elif letters:
        longer.append("[" + "".join(map(_in_class, letters)) + "]")
    if not longer:
        return ""
    if _END in node:
        return f"(?:{'|'.join(longer)})?"
    return longer[0] if len(longer) == 1 else f"(?:{'|'.join(longer)})"


def _chain(node: dict) -> str:
    """Text below a node up to the next choice, and what follows there."""
    text = ""
    while len(node) == 1 and _END not in node:
        ((char, node),) = node.items()
        text += literal(char)
    return text + _below(node)
