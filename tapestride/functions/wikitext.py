"""A small reader of wiki markup: plain text and links with their places in it."""

from __future__ import annotations

import html
import re

#: Templates whose links count but whose text does not.
SILENT = {"refimprove", "citation needed", "cite web", "cite book", "cite journal", "cite news", "reflist", "main", "see also", "coord", "efn", "sfn"}
_TOKEN = re.compile(r"\[\[|\]\]|\{\{|\}\}|\{\||\|\}|<!--.*?-->|<(ref|math|source|gallery|nowiki|pre)\b[^>]*?/>|<(ref|math|source|gallery|nowiki|pre)\b.*?</\2\s*>|<[^<>]*>|\[(?:https?|ftp):[^\]]*\]|'{2,}", re.S | re.I)
_MEDIA = re.compile(r"^\s*:?(image|file|category)\s*:", re.I)


def _split(text: str) -> list[str]:
    """Parts at bars that no link or template encloses."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"\[\[|\]\]|\{\{|\}\}|\|", text):
        if m.group() in ("[[", "{{"):
            depth += 1
        elif m.group() in ("]]", "}}"):
            depth = max(0, depth - 1)
        elif not depth:
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]]


def _close(text: str, at: int, open_: str, close: str) -> int:
    """Where the bracket that opens at ``at`` is closed; -1 if nowhere."""
    depth, i = 0, at
    while i < len(text):
        if text.startswith(open_, i):
            depth, i = depth + 1, i + 2
        elif text.startswith(close, i):
            depth, i = depth - 1, i + 2
            if not depth:
                return i
        else:
            i += 1
    return -1


class Page:
    """Plain text of a page and its links as (surface, destination, start, end) in it."""

    def __init__(self, source: str, deepest: int = 40):
        self.parts: list[str] = []
        self.size = 0
        self.links: list[tuple[str, str, int, int]] = []
        self.deepest = deepest
        self._walk(source or "", False, 0)
        self.text = "".join(self.parts)

    def _write(self, text: str) -> tuple[int, int]:
        text = " ".join(html.unescape(text).split())
        if not text:
            return self.size, self.size
        if self.size:
            self.parts.append(" ")
            self.size += 1
        start = self.size
        self.parts.append(text)
        self.size += len(text)
        return start, self.size

    def _walk(self, text: str, silent: bool, depth: int) -> None:
        at = 0
        while at < len(text):
            m = _TOKEN.search(text, at)
            if not m:
                self._plain(text[at:], silent)
                return
            self._plain(text[at : m.start()], silent)
            token, at = m.group(), m.end()
            if token == "[[":
                end = _close(text, m.start(), "[[", "]]")
                if end > 0:
                    self._link(text[m.end() : end - 2], silent, depth)
                    at = end
            elif token == "{{":
                end = _close(text, m.start(), "{{", "}}")
                if end > 0:
                    self._template(text[m.end() : end - 2], silent, depth)
                    at = end
            elif token == "{|":
                line = text.find("\n", at)
                at = line if line > 0 else at
        return

    def _plain(self, text: str, silent: bool) -> None:
        if not silent:
            text = re.sub(r"(?m)^[=*#:;]+|=+\s*$|^\s*[|!][-+}]?|\|\||!!", " ", text)
            self._write(text)

    def _link(self, inner: str, silent: bool, depth: int) -> None:
        parts = _split(inner)
        destination = parts[0].strip()
        if re.match(r"^\s*(image|file)\s*:", destination, re.I):
            for caption in parts[-1:] if len(parts) > 1 else []:
                self._walk(caption, silent or "=" in caption.split("[[")[0] or caption.strip() in ("thumb", "right", "left", "center", "frame"), depth + 1)
            return
        if _MEDIA.match(destination):
            return
        label = Page("|".join(parts[1:]), self.deepest - 1).text if len(parts) > 1 and self.deepest > 0 else ""
        shown = label or destination
        start, end = (self.size, self.size) if silent else self._write(shown)
        self.links.append((shown, destination, start, end))

    def _template(self, inner: str, silent: bool, depth: int) -> None:
        if depth > self.deepest:
            return
        parts = _split(inner)
        hush = silent or parts[0].strip().lower() in SILENT
        for part in parts[1:]:
            name, eq, value = part.partition("=")
            body = value if eq and "[[" not in name and "{{" not in name else part
            number = re.fullmatch(r"\s*(\d+)\s*", body)
            if number and not 1900 < int(number.group(1)) < 2100:
                continue
            self._walk(body, hush or re.fullmatch(r"\s*[\w .-]+\.(?:jpe?g|png|svg|gif)\s*", body, re.I) is not None or "www." in body and "[[" not in body, depth + 1)
