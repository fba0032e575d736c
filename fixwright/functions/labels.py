"""Reading a venue's free-text label: contract, tokens, form factor, fabric."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

# every character a label may use where another writes a space
SEPARATORS = "-_\t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def _token(text: str) -> str:
    return " ".join(text.lower().replace("-", " ").replace("_", " ").split())


def words(label: str | Column) -> Column:
    """Lower-cased words of a label, hyphens and underscores read as spaces."""
    spaced = F.translate(F.lower(label), SEPARATORS, " " * len(SEPARATORS))
    return F.split(F.trim(F.regexp_replace(spaced, " +", " ")), " ")


def contract_code(w: Column) -> Column:
    """Index code the words of a label name, or null.

    An alias matches a whole label or its leading words, so the longest match
    is the longest run of leading words found in one literal map. That is a
    handful of hash look-ups per row and needs no join.
    """
    aliases: dict[str, str] = {}
    for code, contract in rules.CONTRACTS.items():
        for alias in contract["aliases"]:
            aliases.setdefault(_token(alias), code)
    table = rules.literal(aliases)
    longest = max(len(a.split()) for a in aliases)
    known = F.get(w, F.lit(0)).isin(*sorted({a.split()[0] for a in aliases}))
    leading = [
        F.when(F.size(w) >= n, F.element_at(table, F.array_join(F.slice(w, 1, n), " "))) for n in range(longest, 0, -1)
    ]
    return F.when(known, F.coalesce(*leading))


def _blob(*texts: str | Column) -> Column:
    """Non-blank texts joined with a space, lower-cased."""
    cols = [F.when(F.col(t) != "", F.col(t)) if isinstance(t, str) else F.when(t != "", t) for t in texts]
    return F.lower(F.concat_ws(" ", *cols))


def form_factor(*texts: str | Column) -> Column:
    b = _blob(*texts)
    return (
        F.when(b.rlike("sxm|oam"), "sxm").when(b.rlike("pcie|pci-e|nvl"), "pcie").otherwise("unknown")
    )


def interconnect(*texts: str | Column) -> Column:
    b = _blob(*texts)
    return (
        F.when(b.rlike("nvl|sxm"), "nvlink")
        .when(b.contains("infiniband") | (F.trim(b) == "ib"), "infiniband")
        .when(b.rlike("ethernet|roce"), "ethernet")
        .when(b.contains("pcie"), "none")
        .otherwise("unknown")
    )


def venue(source: str | Column = "source") -> Column:
    """The route a quote arrived by: the part of the source before the colon."""
    return F.split(source, ":").getItem(0)
