"""Archived HTML to reading-order text cells, and the amounts inside them.

All of it is column expressions over the whole page text: no parser runs per
page and no page leaves the JVM.
"""

from __future__ import annotations

from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SKIPPED = ("script", "style", "noscript", "svg", "template", "head")
BLOCKS = (
    "p", "div", "li", "td", "th", "tr", "br", "h1", "h2", "h3", "h4", "h5",
    "h6", "span", "a", "button", "section", "article", "dt", "dd", "label",
    "strong", "b", "em", "small", "sup", "sub", "table", "ul", "ol",
)
MONEY = r"\$\s?(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)"
# ---------------------------------------------------------------------------

# a quote opens a value only right after an equals sign; elsewhere it is a character like any other
_ATTRIBUTES = r"""(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+"""
_RAW = ("script", "style")  # what they hold is never markup
_NESTED = tuple(t for t in SKIPPED if t not in _RAW)
_REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
CELL, _CUT, _OPEN, _CLOSE = "\u0001", "\u0004", "\u0002", "\u0003"


@cache
def _names() -> tuple[dict[str, str], str]:
    """The standard's named references, and a pattern of those that may lack their semicolon."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return dict(html5), "|".join(bare)


def _code_point(code: Column) -> Column:
    """The character of a numeric reference; the old Windows letters stand for 128 to 159, as browsers read them."""
    windows = {}
    for b in range(0x80, 0xA0):
        try:
            windows[b] = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            windows[b] = chr(b)
    remapped = F.get(F.array(*[F.lit(windows[b]) for b in sorted(windows)]), (code - 0x80).cast("int"))
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (
        code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE
    )
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
        .when(code.between(0x80, 0x9F), remapped).when(control, "").otherwise(character)
    )


def _read_reference(ref: Column) -> Column:
    """What stands for one reference, given without its ampersand; unknown names stay as they are."""
    names, bare = _names()
    table = F.map_from_arrays(F.lit(list(names)), F.lit(list(names.values())))
    digits = F.regexp_extract(ref, r"^#[xX]?([0-9a-fA-F]+);?$", 1)
    # more digits than any character has would not fit a number
    short = F.when(F.length(F.ltrim(F.lit("0"), digits)) <= 8, digits)
    code = F.when(F.lower(ref).startswith("#x"), F.conv(short, 16, 10)).otherwise(short).cast("long")
    prefix = F.regexp_extract(ref, f"^({bare})", 1)
    named = F.coalesce(
        F.try_element_at(table, ref),
        F.when(prefix != "", F.concat(F.try_element_at(table, prefix), F.substr(ref, F.length(prefix) + 1))),
        F.concat(F.lit("&"), ref),
    )
    return F.when(ref.startswith("#"), _code_point(code)).otherwise(named)


def unescape(text: Column) -> Column:
    """Named and numeric character references, each read once, with or without a semicolon."""
    parts, refs = F.split(text, _REFERENCE), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1))
    read = F.zip_with(parts, refs, lambda part, ref: F.concat(part, F.when(ref.isNull(), "").otherwise(_read_reference(ref))))
    return F.when(text.contains("&"), F.array_join(read, "")).otherwise(text)


def _visible(html: Column) -> Column:
    """A page without comments and without what stands inside skipped elements, nested ones included.

    Comments and raw elements are cut in document order, whichever opens first. The other
    skipped elements are counted in and out; what is never closed hides the rest.
    """
    raw = "|".join(_RAW)
    out = F.regexp_replace(html, "[\u0001-\u0004]", " ")
    out = F.regexp_replace(
        out, rf"(?is)(?=<)(?:<!--.*?(?:-->|\z)|<({raw})(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?(?:</\1\s*+(?:>|[^>]++>)|\z))", ""
    )
    nested = "|".join(_NESTED)
    out = F.regexp_replace(out, rf"(?i)<(?:{nested})(?=[\s/>]){_ATTRIBUTES}(?<!/)>", _CUT + _OPEN)
    out = F.regexp_replace(out, rf"(?i)</(?:{nested})(?=[\s/>])[^>]*+>", _CUT + _CLOSE)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(at: Column, piece: Column) -> Column:
        mark = F.substring(piece, 1, 1)
        depth = (
            F.when(mark == _OPEN, at["depth"] + 1).when(mark == _CLOSE, F.greatest(at["depth"] - 1, F.lit(0))).otherwise(at["depth"])
        )
        text = F.when(mark.isin(_OPEN, _CLOSE), F.substring(piece, 2, 2_147_483_647)).otherwise(piece)
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.concat(at["kept"], text)).otherwise(at["kept"]).alias("kept"))

    # bound once: the replacements above run once for each page, however often their result is used
    fold = lambda x: F.when(x.contains(_CUT), F.aggregate(F.split(x, _CUT), start, step)["kept"]).otherwise(x)
    return F.get(F.transform(F.array(out), fold), F.lit(0))


def cells(html: str | Column) -> Column:
    """Text cells of a page as a reader meets them: one for each run between block tags, spaces folded, none empty."""
    out = _visible(F.col(html) if isinstance(html, str) else html)
    out = F.regexp_replace(out, rf"(?i)</?(?:{_by_letter(BLOCKS)})(?=[\s/>]){_ATTRIBUTES}>", CELL)
    out = F.regexp_replace(out, rf"<[!?/a-zA-Z]{_ATTRIBUTES}>", "")
    # spaces are folded in the whole page at once, which is bound first; references may stand for further ones
    read = lambda c: F.when(c.contains("&"), folded(unescape(c))).otherwise(c)
    page = F.get(F.transform(F.array(out), folded), F.lit(0))
    parts = F.transform(F.split(page, CELL), lambda c: F.trim(read(c)))
    return F.filter(parts, lambda c: c != "")


def folded(text: Column) -> Column:
    """Every run of white space as one space; single spaces, which most are, are left as they stand."""
    odd = text.contains("  ") | text.rlike("[^\u0001 -~]")  # no other text has anything to fold
    return F.when(odd, F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*+| \s++", " ")).otherwise(text)


def _by_letter(words: tuple[str, ...]) -> str:
    """A pattern of the words with those of the same first letter put together, so that few are tried in vain."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in tails.items())


def amounts(text: str | Column) -> Column:
    """Every dollar amount in a text, commas removed."""
    col = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(col, F.lit(MONEY), F.lit(1))
    return F.transform(found, lambda a: F.replace(a, F.lit(","), F.lit("")).cast("double"))


def first_amount(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.replace(F.nullif(F.regexp_extract(col, MONEY, 1), F.lit("")), F.lit(","), F.lit("")).cast("double")


def inline_scripts(html: str | Column) -> Column:
    """Bodies of the page's script blocks, unescaped."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    return F.transform(bodies, unescape)
