"""The body of a raw mail message as its sender wrote it."""

from __future__ import annotations

import base64
import html
import quopri
import re

HEADER = re.compile(r"^[A-Za-z][A-Za-z0-9-]*:")
BOUNDARY = re.compile(r"boundary\s*=\s*(?:\"([^\"\n]+)\"|([^\s;]+))", re.I)
CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)
#: The line above a quotation: "On ... X wrote:" and its likes.
ATTRIBUTION = re.compile(r"^(?:(?:On|Am|Le|El)\b.{0,200}|.{1,80}\b(?:wrote|schrieb|a écrit|escribió)\b.{0,120}|.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\b.{0,80})\s?:\s*$")
WROTE = re.compile(r"\b(?:wrote|schrieb|écrit|escribió)\b")
#: The line above a whole copy of the earlier message.
ORIGINAL = re.compile(r"^\s*-{2,}\s*(?:Original Message|Forwarded [Mm]essage|Ursprüngliche Nachricht|Weitergeleitete Nachricht|Message d'origine|Message transféré|Mensaje original|Mensaje reenviado)\s*-{2,}|^\s*Begin forwarded message:", re.I)
RULE = re.compile(r"^\s*_{8,}\s*$")
UUENCODED = re.compile(r"^begin [0-7]{3} \S+[ \t]*\n.*?(?:^end[ \t]*$|\Z)", re.M | re.S)
TAG = re.compile(r"<(?:!--.*?--|/?[a-zA-Z!][^<>]{0,2000})>", re.S)
HIDDEN = re.compile(r"<(script|style|head)\b.*?</\1\s*>", re.I | re.S)
BREAK = re.compile(r"<(?:br|/p|/div|/tr|/li|/h[1-6]|/table)\b[^<>]*>", re.I)


def _split(text: str) -> tuple[dict[str, str], str]:
    """Headers by lower-case name (the first of each) and what follows the first empty line; no header, all is body."""
    if text.startswith("From ") and HEADER.match(text.partition("\n")[2]):  # the separator line of an archive
        text = text.partition("\n")[2]
    if not HEADER.match(text):
        return {}, text[1:] if text.startswith("\n") else text
    head, _, body = text.partition("\n\n")
    headers: dict[str, str] = {}
    for line in re.sub(r"\n[ \t]+", " ", head).split("\n"):
        name, colon, value = line.partition(":")
        if colon:
            headers.setdefault(name.strip().lower(), value.strip())
    return headers, body


def _decoded(headers: dict[str, str], body: str) -> str:
    how = headers.get("content-transfer-encoding", "").lower()
    if "quoted-printable" in how and "=" in body:
        raw = quopri.decodestring(body.encode("utf-8", "replace"))
    elif "base64" in how:
        data = re.sub(r"[^A-Za-z0-9+/]", "", body)
        try:
            raw = base64.b64decode(data + "=" * (-len(data) % 4))
        except ValueError:
            return body
    else:
        return body
    m = CHARSET.search(headers.get("content-type", ""))
    for charset in (m.group(1) if m else "utf-8", "utf-8", "latin-1"):
        try:
            return raw.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


def _shown(text: str) -> str:
    """What a page shows of its markup."""
    return html.unescape(TAG.sub("", BREAK.sub("\n", HIDDEN.sub("", text))))


def _parts(headers: dict[str, str], body: str, depth: int = 0):
    kind = headers.get("content-type", "").lower()
    m = BOUNDARY.search(headers.get("content-type", ""))
    if kind.startswith("multipart") and m and depth < 8:
        mark = re.escape((m.group(1) or m.group(2)).rstrip())
        for piece in re.split(rf"^--{mark}(?:--)?[ \t]*$\n?", body, flags=re.M)[1:]:
            if piece.strip():
                yield from _parts(*_split(piece), depth + 1)
    elif kind.startswith("message/"):
        return
    elif "attachment" not in headers.get("content-disposition", "").lower():
        if not kind or kind.startswith("text/plain"):
            yield "plain", _decoded(headers, body)
        elif kind.startswith("text/html"):
            yield "html", _shown(_decoded(headers, body))
        elif not kind.startswith(("application/", "image/", "audio/", "video/", "text/")):
            yield "plain", _decoded(headers, body)


def content(text: str) -> str:
    """The shown text of a message: its plain parts, else its pages; without headers and attached files."""
    parts = list(_parts(*_split(text.replace("\r\n", "\n").replace("\r", "\n"))))
    plain = [p for kind, p in parts if kind == "plain" and p.strip()]
    return "\n".join(plain or [p for _, p in parts])


def own_words(text: str) -> str:
    """Without quoted text, signature, disclaimer and encoded files."""
    text = text.replace("\r\n", "\n")
    if "\nbegin " in "\n" + text:  # a file among words is attached; where there are no words, it is the body
        rest = UUENCODED.sub("", text)
        return _own(rest) or _own(text)
    return _own(text)


def _own(text: str) -> str:
    out: list[str] = []
    for line in text.split("\n"):
        bare = line.rstrip()
        if bare == "--" or RULE.match(line) or ORIGINAL.match(line):
            break
        if line.lstrip().startswith(">") and not line.lstrip().startswith((">}", ">{")):
            while out and not out[-1].strip():
                out.pop()
            if out and WROTE.search(out[-1]) and out[-1].rstrip().endswith(":"):
                out.pop()
            elif len(out) > 1 and WROTE.search(out[-2] + " " + out[-1]) and out[-1].rstrip().endswith(":"):
                del out[-2:]
            continue
        out.append(bare)
    if out and WROTE.search(out[-1]) and out[-1].endswith(":"):
        out.pop()
    return "\n".join(out).strip("\n")


def body(text: str) -> str:
    return own_words(content(text))
