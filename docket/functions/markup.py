"""Markup as tags and text, by the tokenizer rules of HTML, in one pass: nothing is looked at twice."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

#: Fixed values of HTML: elements without content, elements whose content is text with references but no tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REFERENCES_ONLY = frozenset(("title", "textarea"))
LETTER = re.compile("[a-zA-Z]")
NAME = re.compile(r"[^\s/>]+")
BETWEEN = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"(=?[^\s/>=]*)")
SIGN = re.compile(r"\s*=\s*")
UNQUOTED = re.compile(r"[^\s>]*")


def attributes_at(page: str, at: int) -> tuple[dict[str, str] | None, bool, int]:
    """(attributes, whether the tag ends in a slash, where it ends) from the end of a tag's name; None without an end.

    A quote opens a value only where the value begins; elsewhere, it is a character like others.
    """
    found: dict[str, str] = {}
    slash = False
    while True:
        begin = at
        at = BETWEEN.match(page, at).end()
        slash = page[at - 1 : at] == "/" if at > begin else slash
        if at >= len(page):
            return None, False, at
        if page[at] == ">":
            return found, slash, at + 1
        m = ATTRIBUTE.match(page, at)
        at, slash = m.end(), False
        value, sign = "", SIGN.match(page, at)
        if sign:
            at = sign.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return None, False, len(page)
                value, at = page[at + 1 : end], end + 1
            else:
                m2 = UNQUOTED.match(page, at)
                value, at = m2[0], m2.end()
        found.setdefault(m[1].lower(), value)


def tokens(page: str, skipped: frozenset[str]) -> Iterator[tuple[str, str, dict[str, str] | None, bool]]:
    """(kind, name or text, attributes, slash): kind is 'text', 'open' or 'close'. References in texts are decoded.

    Comments and declarations give nothing; the content of `skipped` elements gives nothing, up to their end tag or the
    end of the page. A tag that the page's end cuts off gives nothing.
    """
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            yield "text", html.unescape(page[at:mark]), None, False
            at = mark
            continue
        following = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                at = page.find(">", at) + 1
                continue
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
        elif following in ("!", "?") and following or following == "/" and not LETTER.match(page, at + 2):
            end = page.find(">", at + 1)
            at = size if end < 0 else end + 1
        elif following == "/" or LETTER.match(page, at + 1):
            closing = following == "/"
            m = NAME.match(page, at + 1 + closing)
            name = m[0].lower()
            found, slash, at = attributes_at(page, m.end())
            if found is None:
                return
            yield ("close" if closing else "open"), name, found, slash
            if closing or name not in skipped and name not in REFERENCES_ONLY:
                continue
            if slash and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            inside = page[at : end.start() if end else size]
            if name not in skipped and inside:
                yield "text", html.unescape(inside), None, False
            at = end.start() if end else size
        else:
            yield "text", "<", None, False
            at += 1


class OpenElements:
    """A stack of open elements that knows where the innermost one of each tag is."""

    def __init__(self):
        self.items: list[tuple] = []
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, *more) -> None:
        self.places[tag].append(len(self.items))
        self.items.append((tag, *more))

    def last(self, *tags: str) -> int:
        """Where the innermost open element of these tags is, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, at: int) -> list[tuple]:
        """Closes the element at `at` and those within it; gives them, innermost first."""
        closed = []
        while len(self.items) > at:
            closed.append(self.items.pop())
            self.places[closed[-1][0]].pop()
        return closed
