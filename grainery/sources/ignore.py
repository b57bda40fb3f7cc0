"""Ignore rules of source trees: which paths a list of patterns leaves out."""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    base: str
    pattern: re.Pattern[str]
    keeps: bool
    folders: bool


def _regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            inner = "^" + inner[1:] if inner[0] in "!^" else inner
            out, i = out + "(?!/)[" + inner.replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def rules(lines: str | list[str] | tuple[str, ...], base: str = "") -> list[Rule]:
    """Rules in order. A pattern with a slash before its end is taken from `base` on, others hold for a name at any depth below it;
    one that ends in a slash holds for folders; `!` takes a path back in."""
    found = []
    for line in lines.splitlines() if isinstance(lines, str) else lines:
        text = re.sub(r"(?<!\\)\s+$", "", line)
        if not text or text.startswith("#"):
            continue
        keeps = text.startswith("!")
        glob = text[1:] if keeps else text
        folders = glob.endswith("/")
        glob = glob.rstrip("/") if folders else glob
        if not glob:
            continue
        anchored = "/" in glob
        glob = glob.removeprefix("/")
        try:
            pattern = re.compile(("" if anchored else "(?:[^/]+/)*") + _regex(glob))
        except re.error:
            continue
        found.append(Rule(f"{base}/" if base else "", pattern, keeps, folders))
    return found


def ignored(path: str, folder: bool, some: list[Rule]) -> bool:
    """Whether the last rule that a path (relative to the root) matches leaves it out. Its parents are the caller's matter: what lies in a folder left out is never looked at."""
    for r in reversed(some):
        if path.startswith(r.base) and (folder or not r.folders) and r.pattern.fullmatch(path[len(r.base) :]):
            return not r.keeps
    return False
