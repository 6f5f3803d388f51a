"""Addresses of the anchors of an HTML text, read by a tokeniser that forgives what browsers forgive.

Tags are gone through attribute by attribute, so a ``>`` inside quotes ends nothing and attributes need no blanks between
them; comments and the text of scripts, styles and the like hold no anchors. Everything is scanned once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_MARKUP = re.compile(r"<(?:(!--)|([!?/])|([A-Za-z][^\s/>]*))")
_COMMENT_END = re.compile(r"--!?>")
# A name, and a value in either quotes or none. A ``=`` where a name is due belongs to the name.
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+)")
# Elements whose content is text up to their end tag.
_TEXT_ELEMENTS = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
_TEXT_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _TEXT_ELEMENTS}
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*+(;|(?![=A-Za-z0-9])))")
_BLANK = " \t\n\r\f"


def decoded(value: str) -> str:
    """An attribute's value with its character references read.

    A named one without its semicolon stays before ``=``, a letter or a digit, as in the query ``?a=1&copy=2``.
    """
    return _REFERENCE.sub(lambda m: unescape(m[0]), value) if "&" in value else value


def _skip_tag(html: str, at: int) -> tuple[int, str | None]:
    """End of the start tag whose attributes begin at ``at`` (-1 where the text ends in it), and its first ``href``."""
    href = None
    while at < len(html):
        found = _ATTRIBUTE.match(html, at)
        if found[1]:
            return found.end(), href
        if found.end() == at:
            return -1, None
        at = found.end()
        if href is None and found[2].lower() == "href":
            href = next((v for v in found.group(3, 4, 5) if v is not None), "")
    return -1, None


def anchors(html: str | None) -> Iterator[str]:
    """The ``href`` of every anchor that has one, in order, decoded, without blanks around it or line ends in it."""
    html, at = html or "", 0
    while found := _MARKUP.search(html, at):
        at = found.end()
        if found[1]:
            if html.startswith((">", "->"), at):  # ``<!-->`` and ``<!--->`` are whole comments
                at = html.index(">", at) + 1
                continue
            end = _COMMENT_END.search(html, at)
            if not end:
                return
            at = end.end()
        elif found[2]:
            at = html.find(">", at) + 1
            if not at:
                return
        else:
            name = found[3].lower()
            at, href = _skip_tag(html, at)
            if at < 0:
                return
            if name == "a" and href is not None:
                yield re.sub(r"[\t\n\r]", "", decoded(href).strip(_BLANK))
            elif name in _TEXT_END:
                end = _TEXT_END[name].search(html, at)
                if not end:
                    return
                at = end.start()
            elif name == "plaintext":
                return
