"""One markdown text at a time: front matter, links, sections, segments."""

from __future__ import annotations

import re

SEGMENT = 512
_HEADING = re.compile(r"^(#{1,6}) +(.*?) *#* *$")
_LINK = re.compile(r"\[\[([^\]]+?)\]\]|\[([^\]]*)\]\(([^)\s]+)\)")
_TAG = re.compile(r"(?<![\w/#&])#([A-Za-z][\w/-]*)")


def bare(s: str) -> str:
    return re.sub("[`*_]+", "", s).strip()


def anchor(s: str) -> str:
    return re.sub(r"[^\w\- ]+", "", re.sub("[`*_]+", "", s).lower(), flags=re.A).strip().replace(" ", "-")


def fences(lines: list[str]) -> list[bool]:
    """Which lines are part of a fenced block, its marks included; a block ends at a mark of its own kind."""
    out, kind = [], ""
    for line in lines:
        mark = next((m for m in ("```", "~~~") if line.strip().startswith(m)), "")
        out.append(bool(kind or mark))
        if mark and kind in ("", mark):
            kind = "" if kind else mark
    return out


def unfenced(text: str) -> list[tuple[int, str]]:
    """(line number, line) outside fenced blocks."""
    lines = text.split("\n")
    return [(i, line) for i, (line, inside) in enumerate(zip(lines, fences(lines), strict=True), 1) if not inside]


def links(text: str) -> list[dict]:
    """Wiki links and relative links to other notes, with the heading that they stand under; code spans hold none."""
    out, section = [], ""
    for i, line in unfenced(text):
        if m := _HEADING.match(line):
            section = bare(m[2])
        for m in _LINK.finditer(re.sub(r"`[^`]*`", lambda c: " " * len(c[0]), line)):
            wiki = m[1] is not None
            target, display = m[1].partition("|")[::2] if wiki else (m[3], m[2])
            target = target.split("#")[0].strip()
            if target and (wiki or (target.endswith(".md") and not re.match(r"[a-z]+:", target))):
                out.append({"target": target, "section": section, "display": display.strip(), "line": i, "wiki": wiki})
    return out


def front_matter(text: str) -> tuple[dict[str, list[str]], str]:
    """Fields between leading rules (lists in brackets or as dashes), and what follows."""
    m = re.match(r"---[ \t]*\r?\n(?:(.*?)\r?\n)??(?:---|\.\.\.)[ \t]*(?:\r?\n|$)", text, re.S)
    if not m:
        return {}, text
    out: dict[str, list[str]] = {}
    key = None
    for line in (m[1] or "").replace("\r", "").split("\n"):
        if key and re.match(r"\s*- ", line):
            out[key].append(line.strip()[2:].strip().strip("\"'"))
        elif f := re.match(r"([\w-]+):\s*(.*)$", line):
            key, value = f[1].lower(), f[2].strip()
            out[key] = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else [value.strip("\"'")] if value else []
    return out, text[m.end() :]


def note(rel_path: str, text: str) -> tuple:
    """The row of a note: its title is the front matter's, the first heading, or the file's name."""
    fields, body = front_matter(text)
    rest = [line for _, line in unfenced(body)]
    heads = [bare(m[2]) for line in rest if (m := _HEADING.match(line)) and len(m[1]) == 1]
    title = next(iter([*fields.get("title", []), *heads]), rel_path.rsplit("/", 1)[-1].removesuffix(".md"))
    lead = next((re.sub(r"\s+", " ", line).strip() for line in rest if line.strip() and not _HEADING.match(line)), "")
    tags = list(dict.fromkeys([*fields.get("tags", []), *(t for line in rest for t in _TAG.findall(re.sub(r"`[^`]*`", " ", line)))]))
    other = {k: ", ".join(v) for k, v in fields.items() if k not in ("title", "type", "tags", "aliases")}
    return (rel_path, rel_path.rpartition("/")[0], title, next(iter(fields.get("type", [])), ""), lead, body, fields.get("aliases", []), tags, other, links(body))


def sections(text: str) -> list[tuple[str, str, str]]:
    """(anchor, heading, text) of each part from one second-level heading to the next; the first heading titles them all."""
    out: list[tuple[str, str, str]] = []
    title = head = place = ""
    body: list[str] = []
    inside = False

    def flush() -> None:
        rest = "\n".join(body).strip()
        body.clear()
        full = f"{title} › {head}" if title and head and head != title else head or title
        if (inside or rest) and f"{full}\n{rest}".strip():
            out.append((place, full, f"{full}\n{rest}".strip()))

    lines = text.split("\n")
    for line, code in zip(lines, fences(lines), strict=True):
        m = None if code else _HEADING.match(line)
        if not m or len(m[1]) > 2:
            body.append(line)
            continue
        flush()
        first = len(m[1]) == 1 and not title
        head, place, inside = bare(m[2]), anchor(m[2]), not first
        if first:
            title = head
    flush()
    return out


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Pieces of at most size bytes; a cut is at the last white space of the last sixth, or between characters."""
    if len(text.encode()) <= size:
        return [text]
    out = []
    while len(text.encode()) > size:
        head = text.encode()[:size].decode(errors="ignore")
        spot = max((i for i, c in enumerate(head) if c.isspace()), default=-1)
        if spot > 0 and len(head[:spot].encode()) > len(head.encode()) - size // 6:
            head = head[:spot]
        head = head or text[0]
        if head.strip():
            out.append(head.strip())
        text = text[len(head) :].lstrip()
    return [*out, text.strip()] if text.strip() else out
