"""Region screens. NULL means undisclosed and always passes; '' differs by version."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import literal

# --- fixed values -----------------------------------------------------------
US_TOKENS = (
    "us", "usa", "united states", "america", "virginia", "texas", "iowa",
    "kansas", "utah", "oregon", "california", "arizona", "georgia", "ohio",
    "nevada", "washington", "illinois", "colorado", "carolina", "york",
    "chicago", "dallas", "denver", "atlanta", "phoenix", "seattle", "ashburn",
    "santa clara", "los angeles", "san jose", "des moines", "kansas city",
    "north carolina", "new york", "salt lake",
)
US_COUNTRY_NAMES = ("us", "usa", "u.s.", "u.s.a.", "united states", "united states of america")
US_PLACES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado",
    "connecticut", "delaware", "florida", "hawaii", "idaho", "illinois",
    "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland",
    "massachusetts", "michigan", "minnesota", "mississippi", "missouri",
    "montana", "nebraska", "nevada", "new hampshire", "new jersey",
    "new mexico", "new york", "north carolina", "north dakota", "ohio",
    "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina",
    "south dakota", "tennessee", "texas", "utah", "vermont", "virginia",
    "washington", "west virginia", "wisconsin", "wyoming", "district of columbia",
    "ashburn", "atlanta", "chicago", "dallas", "denver", "des moines",
    "kansas city", "los angeles", "phoenix", "salt lake city", "san jose",
    "santa clara", "seattle", "silicon valley",
)
US_CLOUD_REGION = r"(east|west|central|north|south|northcentral|southcentral|westcentral)us\d*"
# ---------------------------------------------------------------------------


def passes_substring(region: str | Column = "region") -> Column:
    """The rule of 1.0.0 and 1.1.0: any token anywhere in the text."""
    col = F.col(region) if isinstance(region, str) else region
    blob = F.lower(F.regexp_replace(col, "[_/-]", " "))
    return col.isNull() | blob.rlike("|".join(US_TOKENS))


def names_us(region: str | Column = "region") -> Column:
    """Whether a disclosed region names the United States, reading whole parts only."""
    col = F.col(region) if isinstance(region, str) else region
    parts = F.transform(F.split(F.lower(col), ","), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))

    def is_us(part: Column) -> Column:
        text = F.trim(F.regexp_replace(part, r"(?U)[\s_\-/.]+", " "))
        return (
            F.array_contains(literal(US_COUNTRY_NAMES), part)
            | text.rlike(r"^(us|usa)( |$)")
            | text.rlike(rf"(^| ){US_CLOUD_REGION}( |$)")
            | F.array_contains(literal(US_PLACES), text)
        )

    return F.exists(parts, is_us)


def passes_exact(region: str | Column = "region") -> Column:
    """The rule of 1.2.0: undisclosed or blank passes, otherwise it must name the US."""
    col = F.col(region) if isinstance(region, str) else region
    return col.isNull() | (F.trim(F.regexp_replace(col, r"(?U)\s+", " ")) == "") | names_us(col)


def us_or_unknown(region: str | Column = "region") -> Column:
    """True or false for a disclosed region, null when there is none to read."""
    col = F.col(region) if isinstance(region, str) else region
    return F.when(F.trim(col) != "", names_us(col))
