"""Typeset lines as PDF files, plain or compressed, with object streams or encrypted: for round trips and as a sink."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.codecs import encode_lzw, rc4
from quillwork.sources.pdf_objects import PADDING

VARIANTS = ("plain", "flate", "lzw", "objstm", "rc4")


def _content(lines: list[dict], height: float, code: dict[str, str]) -> bytes:
    """One page's operators: every character five points wide, whatever the size."""
    out = ["BT"]
    for line in lines:
        size = line["font_size"]
        show = "".join(map(code.__getitem__, line["text"]))
        out.append(f"/F{1 if line['is_bold'] else 0} {size:g} Tf {1000 / size:.10g} Tz 1 0 0 1 {line['x0']:g} {height - line['y0'] - 10:g} Tm <{show}> Tj")
    return "\n".join([*out, "ET"]).encode()


def document(lines: list[dict], variant: str = "plain", title: str = "", width: float = 612.0, height: float = 792.0) -> bytes:
    """A PDF file of lines (page_no, text, x0, y0, font_size, is_bold)."""
    pages: dict[int, list[dict]] = {}
    for line in lines:
        pages.setdefault(line["page_no"], []).append(line)
    chars = sorted(set().union(*(line["text"] for line in lines)))
    code = {c: i + 1 for i, c in enumerate(chars)}
    pairs = "".join(f"<{i:04X}> <{c.encode('utf-16-be').hex()}>\n" for c, i in code.items())
    cmap = f"1 begincodespacerange <0000> <FFFF> endcodespacerange\n{len(code)} beginbfchar\n{pairs}endbfchar".encode()
    shown = {c: f"{i:04X}" for c, i in code.items()}
    n = max(pages, default=1)
    first = 10
    kids = " ".join(f"{first + 2 * i} 0 R" for i in range(n))
    text = b"\xfe\xff" + title.encode("utf-16-be")
    objects: dict[int, tuple[bytes, bytes | None]] = {
        1: (b"<< /Type /Catalog /Pages 2 0 R >>", None),
        2: (f"<< /Type /Pages /Kids [{kids}] /Count {n} /MediaBox [0 0 {width:g} {height:g}] /Resources << /Font << /F0 3 0 R /F1 4 0 R >> >> >>".encode(), None),
        **{3 + i: (f"<< /Type /Font /Subtype /Type0 /BaseFont /Quill{name} /Encoding /Identity-H /DescendantFonts [{5 + i} 0 R] /ToUnicode 7 0 R >>".encode(), None) for i, name in enumerate(("", "-Bold"))},
        **{5 + i: (f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Quill{name} /DW 500 >>".encode(), None) for i, name in enumerate(("", "-Bold"))},
        7: (b"", cmap),
        8: (b"<< /Title <" + text.hex().encode() + b"> >>", None),
    }
    for i in range(n):
        objects[first + 2 * i] = (f"<< /Type /Page /Parent 2 0 R /Contents {first + 2 * i + 1} 0 R >>".encode(), None)
        objects[first + 2 * i + 1] = (b"", _content(pages.get(i + 1, []), height, shown))
    secret = extra = None
    if variant == "rc4":
        ident = hashlib.md5(title.encode()).digest()
        owner = rc4(hashlib.md5(PADDING).digest()[:5], PADDING)
        secret = hashlib.md5(PADDING + owner + struct.pack("<i", -4) + ident).digest()[:5]
        extra = f"/Encrypt << /Filter /Standard /V 1 /R 2 /P -4 /O <{owner.hex()}> /U <{rc4(secret, PADDING).hex()}> >> /ID [<{ident.hex()}> <{ident.hex()}>]"
        key = hashlib.md5(secret + struct.pack("<I", 8)[:3] + b"\0\0").digest()[:10]
        objects[8] = (b"<< /Title <" + rc4(key, text).hex().encode() + b"> >>", None)
    out, places = bytearray(b"%PDF-1.5\n"), {}

    def put(number: int, head: bytes, data: bytes | None) -> None:
        places[number] = len(out)
        out.extend(f"{number} 0 obj\n".encode())
        if data is None:
            out.extend(head)
        else:
            name = {"lzw": b"/LZWDecode", "flate": b"/FlateDecode", "objstm": b"/FlateDecode"}.get(variant)
            data = encode_lzw(data) if variant == "lzw" else zlib.compress(data) if name else data
            if secret:
                data = rc4(hashlib.md5(secret + struct.pack("<I", number)[:3] + b"\0\0").digest()[:10], data)
            out.extend(b"<< " + head + b"/Length " + str(len(data)).encode() + (b" /Filter " + name if name else b"") + b" >>\nstream\n" + data + b"\nendstream")
        out.extend(b"\nendobj\n")

    if variant != "objstm":
        for number, (head, data) in objects.items():
            put(number, head, data)
        size, at = max(objects) + 1, len(out)
        table = b"".join(f"{places[i]:010d} 00000 n \n".encode() if i in places else b"0000000000 65535 f \n" for i in range(size))
        out.extend(f"xref\n0 {size}\n".encode() + table + f"trailer\n<< /Size {size} /Root 1 0 R /Info 8 0 R {extra or ''} >>\nstartxref\n{at}\n%%EOF".encode())
        return bytes(out)
    packed = {k: h for k, (h, d) in objects.items() if d is None}
    for number, (head, data) in objects.items():
        if data is not None:
            put(number, head, data)
    pack, head, body = max(objects) + 1, [], b""
    for k, h in packed.items():
        head.append(f"{k} {len(body)}")
        body += h + b"\n"
    lead = (" ".join(head) + "\n").encode()
    put(pack, f"/Type /ObjStm /N {len(packed)} /First {len(lead)} ".encode(), lead + body)
    size, at, order = pack + 2, len(out), {k: i for i, k in enumerate(packed)}
    rows = b"".join(struct.pack(">BIH", 2, pack, order[i]) if i in order else struct.pack(">BIH", 1, places.get(i, at), 0) if i in places or i == pack + 1 else struct.pack(">BIH", 0, 0, 0) for i in range(size))
    put(pack + 1, f"/Type /XRef /Size {size} /W [1 4 2] /Root 1 0 R /Info 8 0 R ".encode(), rows)
    out.extend(f"startxref\n{at}\n%%EOF".encode())
    return bytes(out)


def write(lines: DataFrame, variant: str = "plain") -> DataFrame:
    """(doc_id, content): a PDF file for each document of a frame of lines."""
    if variant not in VARIANTS:
        raise ValueError(f"variants are {', '.join(VARIANTS)}")

    import pyarrow as pa

    from quillwork.functions import columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in columns.slices(batches):
            made = [document(own, variant, f"Document {d}") for d, own in zip(columns.values(b.column(0)), columns.values(b.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])

    line = F.struct("page_no", "seq", "text", "x0", "y0", "font_size", "is_bold")
    own = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(line)).alias("rows"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, content binary")
