"""Objects of PDF files: tokens, values, cross-references, encryption, pages. Plain functions for use inside a worker."""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field
from typing import Any

from quillwork.functions.codecs import FilterError, decode, rc4


class PdfError(ValueError):
    """A file that can't be read; the message says why."""


class Name(str):
    """A name, without its slash."""


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Stream:
    entries: dict
    raw: bytes
    key: tuple[int, int] | None = None


class Word(str):
    """A keyword: an operator or a piece of file structure."""


_SPACE = b"\0\t\n\x0c\r "
_TOKEN = re.compile(rb"[\0\t\n\x0c\r ]+|%[^\r\n]*|(?P<delim><<|>>|[\[\]{}])|/(?P<name>[^\0\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<hex><[^>]*>?)|(?P<paren>\()|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[\0\t\n\x0c\r ()<>\[\]{}/%]|\Z))|(?P<word>[^\0\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<odd>[)>])")
_REFERENCE = re.compile(rb"[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![A-Za-z])")
_TRUTH = {"true": True, "false": False}
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class Scanner:
    """Values of a buffer, from a position on."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def token(self) -> Any:
        """The next token: a value, or a Word for keywords and delimiters; None at the end."""
        while m := _TOKEN.match(self.data, self.at):
            self.at = m.end()
            kind = m.lastgroup
            if kind is None:
                continue
            if kind == "name" and b"#" not in m["name"]:
                return Name(m["name"].decode("latin-1"))
            if kind == "name":
                return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m["name"]).decode("latin-1"))
            if kind == "number":
                s = m["number"]
                return float(s) if b"." in s else int(s)
            if kind == "hex":
                try:
                    return bytes.fromhex(m["hex"].strip(b"<>").decode("ascii"))
                except ValueError:
                    pass
                h = re.sub(rb"[^0-9A-Fa-f]", b"", m["hex"])
                return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
            if kind == "paren":
                return self._string()
            s = m[kind].decode("latin-1")
            return _TRUTH[s] if s in _TRUTH else Word(s)
        return None

    def _string(self) -> bytes:
        data, at, depth, out = self.data, self.at, 1, bytearray()
        while at < len(data):
            c = data[at : at + 1]
            at += 1
            if c == b"\\":
                c = data[at : at + 1]
                at += 1
                if c in _ESCAPE:
                    out += _ESCAPE[c]
                elif m := re.compile(rb"[0-7]{1,3}").match(data, at - 1):
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif c == b"\r":
                    at += data[at : at + 1] == b"\n"
                elif c != b"\n":
                    out += c
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        self.at = at
        return bytes(out)

    def value(self) -> Any:
        """The next value; arrays and dictionaries whole, two numbers and R as a reference. A Word where none begins."""
        t = self.token()
        if not isinstance(t, Word):
            if isinstance(t, int) and not isinstance(t, bool):
                back = self.at
                if m := _REFERENCE.match(self.data, back):
                    self.at = m.end()
                    return Ref(t, int(m[1]))
            return t
        if t == "[":
            out = []
            while (v := self.value()) is not None and v != "]":
                out.append(v)
            return out
        if t == "<<":
            made: dict = {}
            while isinstance(k := self.value(), Name):
                v = self.value()
                if isinstance(v, Word) and v == ">>":
                    break
                made[k] = None if isinstance(v, Word) else v
            return made
        return t


@dataclass
class File:
    """A PDF file in memory."""

    data: bytes
    password: str = ""
    places: dict[int, tuple] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    held: dict[int, Any] = field(default_factory=dict)
    packs: dict[int, dict[int, Any]] = field(default_factory=dict)
    fonts: dict[int, tuple] = field(default_factory=dict)
    secret: bytes | None = None
    aes: bool = False
    wide: bool = False

    def __post_init__(self) -> None:
        if b"%PDF" not in self.data[:1024]:
            raise PdfError("no PDF header")
        try:
            self._references()
        except (PdfError, ValueError, IndexError, struct.error, FilterError):
            self.places, self.trailer = {}, {}
        if "Root" not in self.trailer or not isinstance(self.get(self.trailer["Root"]), dict):
            self._search()
        if "Root" not in self.trailer:
            raise PdfError("no catalogue")
        if "Encrypt" in self.trailer:
            self._unlock(self.get(self.trailer["Encrypt"]))

    def _references(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise PdfError("no startxref")
        todo, seen = [Scanner(self.data, at + 9).token()], set()
        while todo:
            at = todo.pop(0)
            if not isinstance(at, int) or at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            s = Scanner(self.data, at)
            if s.token() == "xref":
                while isinstance(first := s.token(), int):
                    for number in range(first, first + s.token()):
                        place, generation, kind = s.token(), s.token(), s.token()
                        if kind == "n":
                            self.places.setdefault(number, ("at", place, generation))
                        else:
                            self.places.setdefault(number, ("free",))
                trailer = s.value()
                todo.append(trailer.get("XRefStm"))
            else:
                stream = self._object_at(at)[1]
                trailer = stream.entries
                data, w = self._decoded(stream), trailer["W"]
                index, pos = trailer.get("Index") or [0, trailer["Size"]], 0
                for first, n in zip(index[::2], index[1::2], strict=False):
                    for number in range(first, first + n):
                        f = []
                        for size in w:
                            f.append(int.from_bytes(data[pos : pos + size], "big"))
                            pos += size
                        kind = f[0] if w[0] else 1
                        self.places.setdefault(number, ("at", f[1], f[2]) if kind == 1 else ("in", f[1], f[2]) if kind == 2 else ("free",))
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo.append(trailer.get("Prev"))

    def _search(self) -> None:
        """Without usable references: every object that the file's bytes show, the last of each number."""
        self.held.clear()
        for m in re.finditer(rb"(?<!\d)(\d+)[ \t]+(\d+)[ \t]+obj\b", self.data):
            self.places[int(m[1])] = ("at", m.start(), int(m[2]))
        for m in re.finditer(rb"trailer", self.data):
            t = Scanner(self.data, m.end()).value()
            self.trailer |= t if isinstance(t, dict) else {}
        if "Root" not in self.trailer:
            for number in self.places:
                v = self.get(Ref(number, 0))
                if isinstance(v, dict) and v.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(number, 0)

    def _object_at(self, at: int) -> tuple[tuple[int, int], Any]:
        s = Scanner(self.data, at)
        number, generation, word = s.token(), s.token(), s.token()
        if word != "obj":
            raise PdfError(f"no object at {at}")
        v = s.value()
        if isinstance(v, dict):
            back = s.at
            if s.token() == "stream":
                start = s.at + (2 if self.data[s.at : s.at + 2] == b"\r\n" else 1)
                length = self.get(v.get("Length"))
                end = start + length if isinstance(length, int) else -1
                if end < start or not self.data[end : end + 20].lstrip(_SPACE).startswith(b"endstream"):
                    end = self.data.find(b"endstream", start)
                    end = len(self.data) if end < 0 else end
                    end -= self.data[start:end].endswith(b"\r\n") + self.data[start:end].endswith((b"\n", b"\r"))
                return (number, generation), Stream(v, self.data[start:end], (number, generation))
            s.at = back
        return (number, generation), v

    def get(self, v: Any) -> Any:
        """v, or what it refers to; None for what isn't there."""
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            if v.number not in self.held:
                place = self.places.get(v.number, ("free",))
                self.held[v.number] = None
                try:
                    if place[0] == "at":
                        key, found = self._object_at(place[1])
                        self.held[v.number] = self._open(found, *key) if self.secret else found
                    elif place[0] == "in":
                        self.held[v.number] = self._pack(place[1]).get(v.number)
                except (PdfError, ValueError, TypeError, IndexError):
                    pass
            v = self.held[v.number]
        return None

    def _pack(self, number: int) -> dict[int, Any]:
        if number not in self.packs:
            self.packs[number] = {}
            stream = self.get(Ref(number, 0))
            data = self._decoded(stream)
            s, head = Scanner(data), []
            for _ in range(2 * self.get(stream.entries["N"])):
                head.append(s.token())
            first = self.get(stream.entries["First"])
            self.packs[number] = {n: Scanner(data, first + off).value() for n, off in zip(head[::2], head[1::2], strict=True)}
        return self.packs[number]

    def _decoded(self, stream: Stream) -> bytes:
        as_list = lambda v: v if isinstance(v, list) else [] if v is None else [v]
        filters = [self.get(f) for f in as_list(self.get(stream.entries.get("Filter")))]
        parms = [self.get(p) for p in as_list(self.get(stream.entries.get("DecodeParms")))]
        return decode(stream.raw, filters, [{k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else None for p in parms])

    def content(self, stream: Any) -> bytes:
        """A stream's decoded bytes; what can't be decoded, as it is."""
        stream = self.get(stream)
        if not isinstance(stream, Stream):
            return b""
        try:
            return self._decoded(stream)
        except (FilterError, ValueError, TypeError, IndexError):
            return stream.raw

    # Encryption: the standard handler with RC4, AES-128 or AES-256.
    def _unlock(self, e: dict) -> None:
        e = {k: self.get(v) for k, v in e.items()}
        v, r = e.get("V", 0), e.get("R", 2)
        if e.get("Filter") != "Standard" or v not in (1, 2, 4, 5):
            raise PdfError(f"encryption version {v} isn't supported")
        if v == 5:
            from quillwork.functions.aes import file_key

            secret = file_key(e, self.password.encode("utf-8"), r)
            if secret is None:
                raise PdfError("wrong password")
            self.aes, self.wide, self.secret = True, True, secret
            self.held.clear()
            self.packs.clear()
            return
        size = 5 if v == 1 else e.get("Length", 40) // 8 if v == 2 else 16
        method = self.get(self.get(e.get("CF", {})).get(e.get("StmF"), {})).get("CFM") if v == 4 else None
        self.aes = method == "AESV2"
        ids = self.get(self.trailer.get("ID")) or [b""]

        def key(password: bytes) -> bytes:
            k = hashlib.md5((password + PADDING)[:32] + e["O"][:32] + struct.pack("<i", (e["P"] + (1 << 31)) % (1 << 32) - (1 << 31)) + ids[0] + (b"\xff" * 4 if r >= 4 and e.get("EncryptMetadata") is False else b"")).digest()
            for _ in range(50 if r >= 3 else 0):
                k = hashlib.md5(k[:size]).digest()
            return k[:size]

        def fits(k: bytes) -> bool:
            if r == 2:
                return rc4(k, PADDING) == e["U"][:32]
            u = rc4(k, hashlib.md5(PADDING + ids[0]).digest())
            for i in range(1, 20):
                u = rc4(bytes(b ^ i for b in k), u)
            return u == e["U"][:16]

        user = self.password.encode("latin-1", "replace")
        k = hashlib.md5((user + PADDING)[:32]).digest()
        for _ in range(50 if r >= 3 else 0):
            k = hashlib.md5(k).digest()
        owner = e["O"][:32]
        for i in range(19 if r >= 3 else 0, -1, -1):
            owner = rc4(bytes(b ^ i for b in k[:size]), owner)
        for password in (user, owner):
            if fits(key(password)):
                self.secret = key(password)
                self.held.clear()
                self.packs.clear()
                return
        raise PdfError("wrong password")

    def _open(self, v: Any, number: int, generation: int) -> Any:
        if isinstance(v, list):
            return [self._open(x, number, generation) for x in v]
        if isinstance(v, dict):
            return {k: self._open(x, number, generation) for k, x in v.items()}
        if isinstance(v, Stream):
            if v.entries.get("Type") == "XRef":
                return v
            return Stream(self._open(v.entries, number, generation), self._plain(v.raw, number, generation), v.key)
        return self._plain(v, number, generation) if isinstance(v, bytes) else v

    def _plain(self, data: bytes, number: int, generation: int) -> bytes:
        if self.wide:
            from quillwork.functions.aes import decrypt_cbc

            return decrypt_cbc(self.secret, data)
        key = hashlib.md5(self.secret + struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2] + (b"sAlT" if self.aes else b"")).digest()[: min(16, len(self.secret) + 5)]
        if not self.aes:
            return rc4(key, data)
        from quillwork.functions.aes import decrypt_cbc

        return decrypt_cbc(key, data)

    def pages(self) -> list[dict]:
        """The page tree's leaves in order, with what they inherit."""
        out: list[dict] = []
        root = self.get(self.get(self.trailer["Root"]).get("Pages"))
        todo, seen = [(root, {})], set()
        while todo:
            node, above = todo.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            own = above | {k: node[k] for k in ("MediaBox", "CropBox", "Resources", "Rotate") if k in node}
            if "Kids" in node:
                todo += [(self.get(k), own) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                out.append(own | node)
        return out

    def metadata(self) -> dict[str, str]:
        info = self.get(self.trailer.get("Info"))
        out = {}
        for k, v in (info or {}).items():
            v = self.get(v)
            if isinstance(v, bytes):
                out[str(k)] = text_string(v)
            elif isinstance(v, (str, int, float)):
                out[str(k)] = str(v)
        return out


def text_string(raw: bytes) -> str:
    """A string of a document's information: UTF-16 by its mark, else as Latin."""
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("cp1252", "replace").replace("\0", "")
