"""Mathematics in text: symbols to LaTeX and Typst commands, glyphs of symbol fonts to characters, scripts and runs in formulas."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

# Symbols with their LaTeX and Typst names; Greek letters follow from their Unicode names.
SYMBOLS = {
    "∑": ("\\sum", "sum"), "∏": ("\\prod", "product"), "∫": ("\\int", "integral"), "∮": ("\\oint", "integral.cont"), "∂": ("\\partial", "diff"), "∇": ("\\nabla", "nabla"),
    "∞": ("\\infty", "infinity"), "√": ("\\surd", "sqrt"), "±": ("\\pm", "plus.minus"), "∓": ("\\mp", "minus.plus"), "×": ("\\times", "times"), "÷": ("\\div", "div"), "·": ("\\cdot", "dot.c"),
    "≤": ("\\leq", "lt.eq"), "≥": ("\\geq", "gt.eq"), "≠": ("\\neq", "eq.not"), "≈": ("\\approx", "approx"), "≡": ("\\equiv", "equiv"), "∼": ("\\sim", "tilde.op"), "∝": ("\\propto", "prop"),
    "∈": ("\\in", "in"), "∉": ("\\notin", "in.not"), "⊂": ("\\subset", "subset"), "⊆": ("\\subseteq", "subset.eq"), "⊃": ("\\supset", "supset"), "⊇": ("\\supseteq", "supset.eq"),
    "∪": ("\\cup", "union"), "∩": ("\\cap", "sect"), "∅": ("\\emptyset", "emptyset"), "∀": ("\\forall", "forall"), "∃": ("\\exists", "exists"), "¬": ("\\neg", "not"), "∧": ("\\wedge", "and"), "∨": ("\\vee", "or"),
    "→": ("\\rightarrow", "arrow.r"), "←": ("\\leftarrow", "arrow.l"), "↔": ("\\leftrightarrow", "arrow.l.r"), "⇒": ("\\Rightarrow", "arrow.r.double"), "⇐": ("\\Leftarrow", "arrow.l.double"), "⇔": ("\\Leftrightarrow", "arrow.l.r.double"), "↦": ("\\mapsto", "arrow.r.bar"),
    "⊕": ("\\oplus", "plus.circle"), "⊗": ("\\otimes", "times.circle"), "⊥": ("\\perp", "perp"), "∥": ("\\parallel", "parallel"), "∠": ("\\angle", "angle"), "⟨": ("\\langle", "angle.l"), "⟩": ("\\rangle", "angle.r"),
    "ℝ": ("\\mathbb{R}", "RR"), "ℂ": ("\\mathbb{C}", "CC"), "ℕ": ("\\mathbb{N}", "NN"), "ℤ": ("\\mathbb{Z}", "ZZ"), "ℚ": ("\\mathbb{Q}", "QQ"), "ℏ": ("\\hbar", "planck.reduce"), "ℓ": ("\\ell", "ell"),
    "…": ("\\ldots", "dots.h"), "⋯": ("\\cdots", "dots.h.c"), "∘": ("\\circ", "compose"), "†": ("\\dagger", "dagger"), "−": ("-", "-"), "′": ("'", "'"), "∗": ("*", "*"),
}
# Greek letters that LaTeX sets as Latin capitals.
LATIN_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΧο", "ABEZHIKMNOPTXo", strict=True))
# Places of a Symbol font's letters, in the order of its codes a to z and A to Z.
SYMBOL_LOWER, SYMBOL_UPPER = "αβχδεφγηιϕκλμνοπθρστυϖωξψζ", "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ"
# The first letters of a mathematical italic font by code.
CM_ITALIC = dict(zip(range(0x0B, 0x28), "αβγδεζηθικλμνξπρστυφχψωεϑϖϱςϕ", strict=True))
SYMBOL_FONT, ITALIC_FONT = re.compile("symbol", re.I), re.compile("cmmi|lmmi|cmmib", re.I)
SUPERSCRIPTS = {c: str(i) for i, c in enumerate("⁰¹²³⁴⁵⁶⁷⁸⁹")} | dict(zip("⁺⁻⁼⁽⁾ⁿⁱ", "+-=()ni", strict=True))
SUBSCRIPTS = {chr(0x2080 + i): c for i, c in enumerate("0123456789+-=()")}


def _greek(c: str) -> tuple[str, str] | None:
    if not "Ͱ" <= c <= "Ͽ":
        return None
    m = re.fullmatch(r"GREEK (SMALL|CAPITAL) LETTER (?:FINAL )?([A-Z]+)|GREEK (THETA|PHI|PI|RHO|KAPPA|LUNATE EPSILON) SYMBOL", unicodedata.name(c, ""))
    if not m:
        return None
    name = (m[2] or m[3]).lower().replace("lamda", "lambda").replace("lunate epsilon", "epsilon")
    if m[3]:
        return f"\\var{name}", f"{name}.alt"
    if m[1] == "CAPITAL":
        return LATIN_GREEK.get(c) or f"\\{name.capitalize()}", name.capitalize()
    return LATIN_GREEK.get(c) or f"\\{name}", name


def command(c: str) -> tuple[str, str] | None:
    """A symbol's LaTeX and Typst commands; None for what is no mathematics."""
    return SYMBOLS.get(c) or _greek(c)


def has_math(text: str) -> bool:
    return not text.isascii() and _has_math(text)


@lru_cache(1 << 14)
def _has_math(text: str) -> bool:
    return any(command(c) is not None and c not in "·×…−†" or c in SUPERSCRIPTS and c not in "¹²³" or c in SUBSCRIPTS for c in text)


def from_font(text: str, font: str) -> str:
    """Texts of symbol fonts without a map to Unicode: Greek by the letters and codes that stand for it."""
    if SYMBOL_FONT.search(font):
        return "".join(SYMBOL_LOWER[ord(c) - 97] if "a" <= c <= "z" else SYMBOL_UPPER[ord(c) - 65] if "A" <= c <= "Z" else c for c in text)
    if ITALIC_FONT.search(font):
        return "".join(CM_ITALIC.get(ord(c), c) for c in text)
    return text


def translated(text: str, font: str = "", language: str = "latex") -> str:
    """A formula's text in LaTeX or Typst: commands parted from what follows, scripts in braces or brackets."""
    which, out = 0 if language == "latex" else 1, []
    text = from_font(text, font)
    i = 0
    while i < len(text):
        for table, mark in ((SUPERSCRIPTS, "^"), (SUBSCRIPTS, "_")):
            j = i
            while j < len(text) and text[j] in table:
                j += 1
            if j > i:
                inner = "".join(table[c] for c in text[i:j])
                out.append(f"{mark}{{{inner}}}" if not which else f"{mark}({inner})")
                break
        if j > i:
            i = j
            continue
        known = command(text[i])
        if known:
            word = known[which]
            if which and out and out[-1][-1:].isalnum():
                out.append(" ")
            after = text[i + 1 : i + 2]
            out.append(word + (" " if word[-1].isalpha() and (after.isalnum() or after and command(after)) else ""))
        elif which and text[i].isalpha() and out and out[-1][-1:].isalpha():
            out.append(" " + text[i])  # letters side by side are a name in Typst
        else:
            out.append({"#": "\\#", "%": "\\%", "&": "\\&", "$": "\\$"}.get(text[i], text[i]))
        i += 1
    return "".join(out).rstrip()


def script_kind(run: dict, base: dict | None) -> str | None:
    """sup or sub for a run that is smaller than its base and stands above or below its line; a run's own mark comes first."""
    if run.get("script"):
        return run["script"]
    if not base or run.get("baseline") is None or base.get("baseline") is None or run["size"] > 0.85 * base["size"]:
        return None
    rise = base["baseline"] - run["baseline"]
    return "sup" if rise > 0.15 * base["size"] else "sub" if rise < -0.08 * base["size"] else None


def math_runs(runs: list[dict], plain: Callable[[dict], str], is_math_font: Callable[[str], bool], language: str = "latex") -> tuple[str, bool]:
    """(text, whether it holds a formula): neighbouring runs in mathematics between dollar signs, scripts as such; other runs as plain() gives them."""
    out, formula, found = [], [], False

    def close() -> None:
        if formula:
            out.append("$" + "".join(formula).strip() + "$")
            formula.clear()

    base = None
    for r in runs:
        math = is_math_font(r["font"] or "") or has_math(r["text"])
        kind = script_kind(r, base) if formula or math else None
        if math or kind and formula:
            found = True
            inner = translated(r["text"].strip(), r["font"] or "", language)
            mark = {"sup": "^", "sub": "_"}.get(kind or "")
            formula.append((f"{mark}{{{inner}}}" if language == "latex" else f"{mark}({inner})") if mark else (" " if formula else "") + inner)
            if not mark:
                base = r
            if r["text"][-1:].isspace():
                formula.append(" ")
        else:
            trail = bool(formula and formula[-1] == " ")
            close()
            out.append((" " if trail else "") + plain(r))
            base = r
    close()
    return "".join(out), found
