"""URL parsing by the WHATWG standard, for http and https, in plain Python.

Expressions take the common shapes of URLs (see functions.urls); this takes the rest, and resolves the
references of pages. Internationalised names go through the interpreter's IDNA codec.
"""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

_PORTS = {"http": "80", "https": "443"}
_SPECIAL = {"ftp", "file", "http", "https", "ws", "wss"}
_FORBIDDEN = set("\0\t\n\r #/<>?@[\\]^|%\x7f") | {chr(c) for c in range(32)}


class Url(NamedTuple):
    scheme: str
    userinfo: str
    host: str
    port: str
    path: str
    search: str
    fragment: str

    @property
    def href(self) -> str:
        at = f"{self.userinfo}@" if self.userinfo else ""
        return f"{self.scheme}://{at}{self.host}{':' if self.port else ''}{self.port}{self.path}{self.search}{self.fragment}"


def _encode(text: str, extra: str) -> str:
    out = []
    for c in text:
        if "\x20" < c < "\x7f" and c not in extra:
            out.append(c)
        else:
            out.append("".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")))
    return "".join(out)


def _number(part: str) -> int | None:
    if part == "":
        return None
    base, digits = (16, part[2:]) if part[:2].lower() == "0x" else (8, part[1:]) if len(part) > 1 and part[0] == "0" else (10, part)
    if digits == "":
        return 0
    try:
        return int(digits, base) if re.fullmatch(r"[0-9a-fA-F]+", digits) else None
    except ValueError:
        return None


def _ipv4(host: str) -> str | None:
    """A dotted quad for a host that ends in a number; '' if it doesn't, None if it is malformed."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not (parts[-1].isdigit() and parts[-1].isascii()) and _number(parts[-1] if parts[-1][:2].lower() == "0x" else "x") is None:
        return ""
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n * 256 ** (3 - k) for k, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        import ipaddress

        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") and "%" not in raw else None
        except ValueError:
            return None
    try:
        name = unquote_to_bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return None
    name = name.replace("。", ".").replace("．", ".").replace("｡", ".").replace("­", "")
    if not name.isascii():
        try:
            name = ".".join(label if label.isascii() else label.encode("idna").decode() for label in name.split("."))
        except UnicodeError:
            return None
    name = name.lower()
    if name == "" or _FORBIDDEN & set(name):
        return None
    quad = _ipv4(name)
    return name if quad == "" else quad


def _path(raw: str) -> str:
    out: list[str] = []
    parts = re.split(r"[/\\]", raw)[1:] if raw[:1] in ("/", "\\") else re.split(r"[/\\]", raw)
    for k, part in enumerate(parts):
        plain = re.sub("%2e", ".", part, flags=re.I)
        last = k == len(parts) - 1
        if plain == "..":
            del out[-1:]
        if plain in (".", ".."):
            if last:
                out.append("")
        else:
            out.append(_encode(part, "\"#<>?^`{}"))
    return "/" + "/".join(out)


def parse(text: str, base: Url | None = None) -> Url | None:
    """The URL that a text names, on its own or relative to base; None if it names none with http or https."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", text)
    if m:
        scheme, rest = m[1].lower(), text[m.end() :]
        if scheme not in _PORTS:
            return None
        if not (base is not None and base.scheme == scheme and not re.match(r"[/\\]", rest)):
            return _absolute(scheme, re.sub(r"^[/\\]*", "", rest))
        text = rest
    if base is None:
        return None
    if re.match(r"[/\\]{2}", text):
        return _absolute(base.scheme, re.sub(r"^[/\\]*", "", text))
    text, hash_, fragment = text.partition("#")
    fragment = hash_ + _encode(fragment, ' "<>`') if fragment else ""
    path, mark, query = text.partition("?")
    search = mark + _encode(query, " \"#<>'") if query else ""
    if path == "":
        return base._replace(search=search if mark else base.search, fragment=fragment)
    if path[0] not in "/\\":
        path = base.path.rpartition("/")[0] + "/" + path
    return base._replace(path=_path(path), search=search, fragment=fragment)


def _absolute(scheme: str, rest: str) -> Url | None:
    end = re.search(r"[/\\?#]", rest)
    authority, tail = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    user, at, hostport = authority.rpartition("@")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", hostport)
    if not m or (host := _host(m[1])) is None:
        return None
    port = m[2] or ""
    if port:
        if int(port) > 65535:
            return None
        port = "" if str(int(port)) == _PORTS[scheme] else str(int(port))
    tail, hash_, fragment = tail.partition("#")
    path, mark, query = tail.partition("?")
    return Url(scheme, _encode(user, " \"#<>?`{}/;=@[\\]^|") if at else "", host, port, _path(path) if path else "/", mark + _encode(query, " \"#<>'") if query else "", hash_ + _encode(fragment, ' "<>`') if fragment else "")
