"""Text functions on columns: escapes for markup languages, dates, keywords, scripts, code and font classes. All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that LaTeX text mode needs written otherwise.
LATEX = {
    "\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "%": r"\%", "_": r"\_",
    "^": r"\textasciicircum{}", "~": r"\textasciitilde{}", "<": r"\textless{}", ">": r"\textgreater{}",
    "\u00a0": "~", "\u2013": "--", "\u2014": "---", "\u2018": "`", "\u2019": "'", "\u201c": "``", "\u201d": "''",
    "\u2026": r"\ldots{}", "\u2022": r"\textbullet{}", "\u00b0": r"\textdegree{}", "\u00a9": r"\textcopyright{}", "\u00ae": r"\textregistered{}", "\u2122": r"\texttrademark{}",
}
# Characters that Typst markup needs escaped, and words in the names of monospaced fonts.
TYPST_MARKUP = r"\\#\*_`\$<>@\[\]~"
MONOSPACE = "courier|consolas|mono|menlo|monaco|lucidaconsole|sourcecode|firacode|inconsolata|typewriter"


def replace_all(text: Column, pairs: dict[str, str]) -> Column:
    """text with each key replaced by its value, in order: a later key also meets what an earlier one wrote."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs.items(), text)


def mapped(text: Column, table: dict[str, str]) -> Column:
    """text with single characters replaced by a table, all at once."""
    keys = "".join(table)
    # A private mark for each key keeps the replacements from meeting each other's output.
    marks = {k: chr(0xE000 + i) for i, k in enumerate(table)}
    return replace_all(F.translate(text, keys, "".join(marks.values())), {m: table[k] for k, m in marks.items()})


def without_controls(text: Column, keep: str = "\t\n") -> Column:
    return F.regexp_replace(text, "[\u0001-\u0008\u000b\u000c\u000e-\u001f]" if keep == "\t\n\r" else "[\u0001-\u0008\u000b-\u001f]", "")


def escape_xml(text: Column) -> Column:
    """For XML 1.0 text and attributes; characters that XML may not hold go."""
    legal = F.regexp_replace(text, "[\u0001-\u0008\u000b\u000c\u000e-\u001f\ufffe\uffff]", "")
    return replace_all(legal, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"})


def escape_latex(text: Column) -> Column:
    clean = F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), "[\u0001-\u0009\u000b-\u001f\u007f]", "")
    return F.replace(mapped(clean, LATEX), F.lit("\n"), F.lit(" \\\\\n"))


def escape_latex_url(url: Column) -> Column:
    return replace_all(url, {"\\": "/", "{": "%7B", "}": "%7D", "%": "\\%", "#": "\\#"})


def escape_typst(text: Column) -> Column:
    clean = F.regexp_replace(text, "[\u0001-\u0008\u000b-\u001f\u007f]", "")
    # A slash that would open a comment is set aside while the other characters get their backslashes.
    aside = F.regexp_replace(clean, r"/(?=[/*])", chr(0xE000))
    marked = F.regexp_replace(aside, f"([{TYPST_MARKUP}])", r"\\$1")
    return replace_all(marked, {chr(0xE000): "\\/", "\n": " \\\n", "\t": "  "})


def escape_typst_string(text: Column) -> Column:
    return replace_all(without_controls(text), {"\\": "\\\\", '"': '\\"', "\t": "\\t", "\n": "\\n"})


def escape_yaml(text: Column) -> Column:
    """A double-quoted YAML scalar."""
    return F.concat(F.lit('"'), replace_all(text, {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}), F.lit('"'))


def escape_cell(text: Column) -> Column:
    """A cell of a pipe table: breaks as <br>, bare pipes escaped, trimmed."""
    broken = replace_all(text, {"\r\n": "\n", "\r": "\n", "\n": "<br>"})
    return F.trim(F.regexp_replace(broken, r"(?<!\\)\|", r"\\|"))


def code_language(code: Column) -> Column:
    """python, bash, json, xml, sql, rust, c or empty, by what the first lines look like."""
    text = F.regexp_replace(code, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.get(lines, 0), F.lit(""))
    some = lambda n, pattern: F.exists(F.slice(lines, 1, n), lambda x: x.rlike(pattern))
    return (
        F.when(text == "", "").when(first.rlike(r"^(import |from |def |class |#!/usr/bin/env python)") | some(5, r"\b(def|elif|import|raise|except)\b"), "python")
        .when(first.rlike(r"^(#!/bin/bash|#!/bin/sh|\$ |> )") | some(3, r"^(?:sudo|apt|npm|pip|git|docker|cargo)\s+"), "bash")
        .when(text.rlike(r"(?s)^(\{.*\}|\[.*\])$") & text.contains(":"), "json")
        .when(text.rlike(r"(?s)^(<!DOCTYPE|<html|<.*>$)"), "xml")
        .when(some(3, r"(?i)^(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\s+"), "sql")
        .when(some(3, r"^(fn |pub fn |let mut |impl )"), "rust")
        .when(some(3, r"^(#include|int main\()"), "c").otherwise("")
    )


def code_fence(code: Column) -> Column:
    """A fenced block whose fence is longer than any run of backticks in it."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("(`+)"), 1), lambda x: F.length(x))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(fence, code_language(code), F.lit("\n"), code, F.lit("\n"), fence)


def is_monospace(font: Column) -> Column:
    return F.coalesce(F.translate(F.lower(font), "-_ ", "").rlike(MONOSPACE), F.lit(False))


def math_font(font: Column) -> Column:
    """The family of a mathematical font, or null."""
    name = F.lower(F.regexp_replace(F.trim(font), r"^[A-Za-z0-9]{6}\+", ""))
    return (
        F.when(name.contains("cmsy"), "cmsy").when(name.contains("cmmi"), "cmmi").when(name.contains("cmex"), "cmex").when(name.contains("msbm"), "msbm")
        .when(name.rlike(r"^symbol($|-|mt)|standardsyml|euclid ?symbol"), "symbol")
        .when(name.rlike(r"cambria ?math|stix|lmmath|latinmodernmath|asanamath|mathitalic|mtex|mathematicalpi"), "unicode_math")
    )


def font_style(name: Column) -> Column:
    """struct(family, bold, italic) of a font's name, without its subset prefix and style suffix."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(name, r"^[A-Za-z0-9]{6}\+", "")), r"^/+", "")
    family = F.trim(F.regexp_replace(clean, r"(?i)[-,\s]+(Regular|Bold|Italic|Oblique|BoldItalic|BoldOblique|Book|Medium|MT|PS).*$", ""))
    none = F.coalesce(name, F.lit("")) == ""
    return F.struct(
        F.when(none, "Calibri").when(family == "", clean).otherwise(family).alias("family"),
        (~none & clean.rlike("(?i)Bold|Black|Heavy|Semibold")).alias("bold"),
        (~none & clean.rlike("(?i)Italic|Oblique|Slanted")).alias("italic"),
    )


def pdf_date(raw: Column) -> Column:
    """ISO 8601 of a date such as D:20240131120000+01'00'; parts may be missing at the end, and what is no date stays as it is."""
    text = F.trim(raw)
    pattern = r"^(?:D:)?(\d{4})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2}))?)?)?)?)?(?:([Zz+-])(?:(\d{2})'?(?:(\d{2})'?)?)?)?.*$"
    y, mo, d, h, mi, s, sign, zh, zm = (F.regexp_extract(text, pattern, i) for i in range(1, 10))
    bad = lambda c, lo, hi: (c != "") & ~c.try_cast("int").between(lo, hi)
    wrong = (y == "") | bad(mo, 1, 12) | bad(d, 1, 31) | bad(h, 0, 23) | bad(mi, 0, 59) | bad(s, 0, 59)
    or_00 = lambda c: F.when(c == "", "00").otherwise(c)
    date = F.concat(y, F.when(mo != "", F.concat(F.lit("-"), mo)).otherwise(""), F.when(d != "", F.concat(F.lit("-"), d)).otherwise(""))
    zone = F.when(F.upper(sign) == "Z", "Z").when((sign != "") & (zh != ""), F.concat(sign, zh, F.lit(":"), or_00(zm))).otherwise("")
    time = F.when(h != "", F.concat(F.lit("T"), h, F.lit(":"), or_00(mi), F.lit(":"), or_00(s), zone)).otherwise("")
    return F.when(wrong, text).otherwise(F.concat(date, time))


# Scripts by their characters, in the order that settles ties, with the code page of each.
SCRIPTS = {
    "turkish": ("[\u011e\u011f\u0130\u0131\u015e\u015f]", 1254), "cyrillic": ("[\u0400-\u052f]", 1251), "greek": ("[\u0370-\u03ff\u1f00-\u1fff]", 1253),
    "central_european": ("[\u0102-\u0107\u010c-\u0111\u0118-\u011b\u0139\u013a\u013d\u013e\u0141-\u0144\u0147\u0148\u0150\u0151\u0154\u0155\u0158-\u015b\u0160-\u0165\u016e-\u0171\u0179-\u017e]", 1250),
    "arabic": ("[\u0600-\u06ff\u0750-\u077f]", 1256), "hebrew": ("[\u0590-\u05ff]", 1255), "japanese": ("[\u3040-\u30ff\u31f0-\u31ff]", 932),
    "korean": ("[\uac00-\ud7af\u1100-\u11ff]", 949), "chinese": ("[\u4e00-\u9fff\u3400-\u4dbf]", 936),
}


def rtf_codepage(text: Column, default: int = 1252) -> Column:
    """The code page of the script that most characters beyond ASCII belong to; any kana means Japanese."""
    # Each text is searched once for each script, and only its characters beyond ASCII.
    beyond = F.regexp_replace(text, "[\u0000-\u007f]+", "")
    counts = lambda t: F.struct(*[(F.length(t) - F.length(F.regexp_replace(t, p, ""))).alias(k) for k, (p, _) in SCRIPTS.items()])

    def picked(n: Column) -> Column:
        most = F.greatest(*[n[k] for k in SCRIPTS])
        pick = F.when(F.coalesce(most, F.lit(0)) == 0, default).when(n["japanese"] > 0, SCRIPTS["japanese"][1])
        for k in SCRIPTS:
            pick = pick.when(n[k] == most, SCRIPTS[k][1])
        return pick.otherwise(default).cast("int")

    return F.get(F.transform(F.transform(F.array(beyond), counts), picked), F.lit(0))


def rtf_text(text: Column) -> Column:
    r"""7-bit RTF of a text: \uN? for each UTF-16 unit beyond ASCII."""
    plain = mapped(F.regexp_replace(text, "[\u0001-\u0008\u000b-\u001f\u007f]", ""), {"\\": "\\\\", "{": "\\{", "}": "\\}", "\n": "\\line ", "\t": "\\tab "})

    def unit(c: Column) -> Column:
        code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long")
        signed = lambda n: F.when(n > 32767, n - 65536).otherwise(n).cast("string")
        wide = F.concat(F.lit("\\u"), signed(F.shiftright(code, 16)), F.lit("?\\u"), signed(code.bitwiseAND(F.lit(0xFFFF).cast("long"))), F.lit("?"))
        return F.when(code > 65535, wide).otherwise(F.concat(F.lit("\\u"), signed(code), F.lit("?")))

    # A stretch of ASCII is one piece; only other characters are looked at one by one.
    pieces = F.regexp_extract_all(plain, F.lit("[\u0001-\u007f]+|(?s:.)"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda c: F.when(F.ascii(c).between(1, 127), c).otherwise(unit(c))), "")


def table_delimiter(width: Column, alignment: Column) -> Column:
    """The cell below a pipe table's header: at least three wide, with colons for the alignment."""
    w = F.greatest(width, F.lit(3))
    return F.when(alignment == "center", F.concat(F.lit(":"), F.repeat(F.lit("-"), w - 2), F.lit(":"))).when(alignment == "right", F.concat(F.repeat(F.lit("-"), w - 1), F.lit(":"))).otherwise(F.concat(F.lit(":"), F.repeat(F.lit("-"), w - 1)))


def padded(text: Column, width: Column, alignment: Column) -> Column:
    space = F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(text)))
    return F.when(alignment == "right", F.concat(space, text)).otherwise(F.concat(text, space))


def external_references(html: Column) -> Column:
    """What keeps a page from standing alone: remote images, style sheets, scripts and imports, in that order."""
    q = "[\"']"
    found = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), 1)
    images = F.filter(F.transform(found(rf"(?i)<img\s[^>]*?src={q}([^\"']+){q}"), lambda x: F.trim(x)), lambda x: ~x.startswith("data:"))
    label = lambda a, name: F.transform(a, lambda x: F.concat(F.lit(name), F.trim(x)))
    return F.concat(
        label(images, "image: "),
        label(found(rf"(?i)<link\s(?=[^>]*rel={q}stylesheet{q})[^>]*?href={q}([^\"']+){q}"), "style sheet: "),
        label(found(rf"(?i)<script\s[^>]*?src={q}([^\"']+){q}"), "script: "),
        label(found(rf"(?i)@import\s+url\({q}?([^\"')]+){q}?\)"), "import: "),
    )


def embedded_images(html: Column) -> Column:
    """array<struct<mime, content>> of base64 data URIs."""
    uris = F.regexp_extract_all(html, F.lit(r"(data:image/[a-zA-Z0-9.+-]+;base64,[A-Za-z0-9+/=]+)"), 1)
    return F.transform(uris, lambda u: F.struct(F.regexp_extract(u, r"^data:([^;]+)", 1).alias("mime"), F.unbase64(F.regexp_extract(u, r"base64,(.*)$", 1)).alias("content")))


def manifest_id(raw: Column) -> Column:
    """A name that XML takes as an id: other characters become underscores, and one goes before a first that isn't a letter."""
    name = F.regexp_replace(F.trim(raw), r"[^A-Za-z0-9_.-]", "_")
    return F.when(name.rlike(r"^[A-Za-z_]"), name).otherwise(F.concat(F.lit("_"), name))


def package_path(href: Column) -> Column:
    """A path inside a package with . and .. resolved; null for one that leads out of it."""
    parts = F.filter(F.split(F.replace(href, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    bad = F.struct(F.lit(True).alias("out"), F.array().cast("array<string>").alias("p"))
    walked = F.aggregate(
        parts, F.struct(F.lit(False).alias("out"), F.array().cast("array<string>").alias("p")),
        lambda s, p: F.when(s.out | ((p == "..") & (F.size(s.p) == 0)), bad).when(p == "..", F.struct(F.lit(False).alias("out"), F.slice(s.p, F.lit(1), F.size(s.p) - 1).alias("p"))).otherwise(F.struct(F.lit(False).alias("out"), F.concat(s.p, F.array(p)).alias("p"))),
    )
    return F.when(~walked.out, F.array_join(walked.p, "/"))
