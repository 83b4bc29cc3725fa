"""The XML parser for single texts, for those that the structural index leaves to it, and checks of single values.

They hold no state between records and never fail: text that is missing or not well-formed gives no element.
"""

from __future__ import annotations

import re
from xml.parsers import expat

_WHOLE = re.compile(r"[ \t\r\n]*[+-]?[0-9]{1,19}[ \t\r\n]*")


def whole_number(text) -> int | None:
    """The whole number that a text in ASCII digits says, if it fits 64 bits; else None."""
    if not isinstance(text, str) or not _WHOLE.fullmatch(text):
        return None
    n = int(text)
    return n if -(1 << 63) <= n < 1 << 63 else None


def xml_elements(text: str | None, name: str = "node", references: bool = False) -> list[tuple]:
    """(attributes, own tags[, references]) of every element called name.

    Own tags are its direct children called tag that have k and v, references the ref of its direct children called nd.
    """
    if text is None:
        return []
    found: list[tuple] = []
    path: list = []

    def start(tag: str, attrs: dict) -> None:
        mine = None
        if tag == name:
            found.append(mine := (attrs, [], []))
        elif path and path[-1] is not None:
            if tag == "tag" and "k" in attrs and "v" in attrs:
                path[-1][1].append((attrs["k"], attrs["v"]))
            elif tag == "nd" and "ref" in attrs:
                path[-1][2].append(attrs["ref"])
        path.append(mine)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, lambda _: path.pop()
    try:
        parser.Parse(text, True)
    except (expat.ExpatError, ValueError, UnicodeError, LookupError):
        return []
    return found if references else [f[:2] for f in found]
