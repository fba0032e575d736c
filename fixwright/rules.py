"""Contracts and versioned rule sets, held as data and turned into Spark literals.

Everything here has a fixed, small size (five contracts, three versions), so it
enters a plan as a literal map or struct. Catalyst folds the look-ups away when
the version is a constant, and no join or broadcast is needed when it is not.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# index code: (display name, aliases, vram GB, conforming fabric)
CONTRACTS: dict[str, dict] = {
    "H100": {
        "display_name": "H100 SXM rental price",
        "aliases": [
            "H100", "H100 SXM", "H100 SXM5", "H100_SXM5", "H100 80GB",
            "NVIDIA H100 80GB HBM3", "H100 PCIE", "H100_nvl", "H100 NVL",
            "NVIDIA H100 PCIe", "H100_PCIE_80G",
        ],
        "vram_gb": 80,
        "interconnect": "nvlink",
    },
    "H200": {
        "display_name": "H200 SXM rental price",
        "aliases": ["H200", "H200 SXM", "H200_sxm5", "NVIDIA H200", "H200 NVL"],
        "vram_gb": 141,
        "interconnect": "nvlink",
    },
    "A100": {
        "display_name": "A100 SXM 80GB rental price",
        "aliases": [
            "A100", "A100_80G", "A100 SXM", "A100 SXM4", "A100-SXM4-80GB",
            "NVIDIA A100-SXM4-80GB", "NVIDIA A100 80GB PCIe", "A100 PCIe",
            "A100_PCIE_80G", "A100X",
        ],
        "vram_gb": 80,
        "interconnect": "nvlink",
    },
    "B200": {
        "display_name": "B200 SXM rental price",
        "aliases": ["B200", "B200 SXM", "NVIDIA B200", "B200_sxm6", "B200 SXM6"],
        "vram_gb": 180,
        "interconnect": "nvlink",
    },
    "MI300X": {
        "display_name": "MI300X rental price",
        "aliases": ["MI300X", "AMD Instinct MI300X OAM", "MI300X OAM", "MI300"],
        "vram_gb": 192,
        "interconnect": "infiniband",
    },
}
BACK_SERIES_CODES = ("H100", "H200", "B200", "A100")
NODE_SIZE = 8
CONTRACT_FORM = "sxm"
CONTRACT_REGION = "US"

# label token that names a different product, and why
IDENTITY_TOKENS: dict[str, tuple[str, str]] = {
    "H100": ("nvl", "a dual-slot bridged card, not the SXM good"),
    "A100": ("40gb", "the 40 GB card, a distinct product"),
}
VRAM_TOLERANCE = 0.10
BOOK_SOURCES = ("vastai",)

FORM_FACTORS = {"sxm": 1.00, "pcie": 1.18, "unknown": 1.09}
INTERCONNECTS = {
    "nvlink": 1.00, "infiniband": 1.00, "ethernet": 1.12, "none": 1.15, "unknown": 1.06,
}
COMMITMENTS = {"on_demand": 1.00, "spot": 1.45, "community": 1.30, "reserved": 1.25}
NODE_CURVE = ((4, 0.98), (2, 0.95), (1, 0.92))
TIER_WEIGHTS = {1: 1.00, 2: 0.60, 3: 0.25}

MAD_TO_SIGMA = 1.4826
OUTLIER_SIGMAS = 3.0
DEGENERATE_RATIO = 3.0
RATIO_EPSILON = 1e-9
MAX_TOTAL_ADJUSTMENT = 1.75
SCREEN_MIN_PROVIDERS = 4
DISPERSION_MIN_PROVIDERS = 3
VENUE_CONCENTRATION = 0.50
ADMINISTERED_CV = 0.01
ADMINISTERED_MIN_PAIRS = 5
CONFORMING_TOLERANCE = 1e-9
HEAVY_ADJUSTMENT = 1.25
PROVIDER_LEVEL_SHIFT = 0.25
CORROBORATING_MOVE = 0.10
CORROBORATIONS_REQUIRED = 2
CORROBORATION_MIN_PEERS = 3
STALE_RUNS = 3
DROPOUT_RATIO = 0.5
STALE_CAPTURE_HOURS = 6
CURATED_MAX_AGE_DAYS = 45
RELIABILITY_FLOOR = 0.95
VERIFY_TOLERANCE = 0.005
QUIET_REJECTIONS = ("unmatched_model", "region_mismatch", "product_identity")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Methodology:
    """One version of the rules. A new version is a new row, never a new code path."""

    version: str
    # gates
    min_providers: int = 4
    min_observations: int = 8
    require_tier1: bool = False
    max_dispersion: float = 0.45
    review_move: float = 0.15
    weight_cap: float = 0.35
    min_book_machines: int = 0
    min_book_hosts: int = 0
    book_floor_basis: str = "book"
    # estimator
    robustness_band: float = 1.0
    sigma_floor: float = 0.03
    sigma_ceiling: float = 0.50
    # screens
    exclude_from_floor: bool = False
    product_identity: bool = False
    require_quoted_currency: bool = False
    jump_corroboration: bool = False
    exact_region: bool = False
    # adjustment schedule
    max_total_adjustment: float = MAX_TOTAL_ADJUSTMENT
    form_factors: Mapping[str, float] = field(default_factory=lambda: dict(FORM_FACTORS))
    interconnects: Mapping[str, float] = field(default_factory=lambda: dict(INTERCONNECTS))
    commitments: Mapping[str, float] = field(default_factory=lambda: dict(COMMITMENTS))
    node_curve: tuple[tuple[int, float], ...] = NODE_CURVE
    tier_weights: Mapping[int, float] = field(default_factory=lambda: dict(TIER_WEIGHTS))

    def revised(self, version: str, **changes) -> Methodology:
        """The same rules under another name with some dials moved (a what-if)."""
        return replace(self, version=version, **changes)


Registry = Mapping[str, Methodology]

_V110 = Methodology(
    "1.1.0",
    min_book_machines=4,
    min_book_hosts=3,
    exclude_from_floor=True,
    product_identity=True,
    require_quoted_currency=True,
    jump_corroboration=True,
)
METHODOLOGIES: dict[str, Methodology] = {
    "1.0.0": Methodology("1.0.0"),
    "1.1.0": _V110,
    "1.2.0": _V110.revised("1.2.0", book_floor_basis="priced", exact_region=True),
}
CURRENT = "1.2.0"
BACK_SERIES_VERSION = "1.1.0"


def registry(*versions: str) -> dict[str, Methodology]:
    return {v: METHODOLOGIES[v] for v in (versions or METHODOLOGIES)}


def sql_literal(value) -> str:
    """Python constants as Spark SQL literal text, so a table is one parsed expression."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, Mapping):
        return "map(" + ", ".join(sql_literal(x) for pair in value.items() for x in pair) + ")"
    if isinstance(value, tuple | list):
        return "array(" + ", ".join(sql_literal(x) for x in value) + ")"
    return "null" if value is None else str(value)


def literal(value) -> Column:
    return F.expr(sql_literal(value))


def _rules_sql(m: Methodology) -> str:
    parts = []
    for f in fields(m):
        value = getattr(m, f.name)
        if f.name == "node_curve":
            steps = [f"named_struct('gpus', {n}, 'factor', {x!r}D)" for n, x in value]
            parts.append(f"'{f.name}', array({', '.join(steps)})")
        else:
            parts.append(f"'{f.name}', {sql_literal(value)}")
    return f"named_struct({', '.join(parts)})"


def rules_of(versions: Registry, version: str = "methodology_version") -> Column:
    """The rule struct for a version column; null where the version is not registered."""
    table = ", ".join(f"{sql_literal(v)}, {_rules_sql(m)}" for v, m in versions.items())
    return F.expr(f"element_at(map({table}), {version})")


class ByOrdinal:
    """Rule fields looked up by a version's position in the registry.

    Each field is a literal array indexed by a small integer, so a row carries
    one integer and not a copy of the rules it is read under.
    """

    def __init__(self, versions: Registry, ordinal: str = "version_no"):
        self._rules, self._ordinal = list(versions.values()), ordinal

    def __getitem__(self, name: str) -> Column:
        values = [getattr(m, name) for m in self._rules]
        if name == "node_curve":
            texts = ["array(" + ", ".join(f"named_struct('gpus', {n}, 'factor', {x!r}D)" for n, x in v) + ")" for v in values]
        else:
            texts = [sql_literal(v) for v in values]
        return F.expr(f"get(array({', '.join(texts)}), {self._ordinal})")


def each_version(versions: Registry) -> Column:
    """One row per registered version, to be used in a select as ``version_no``."""
    return F.expr(f"explode(array({', '.join(str(i) for i in range(len(versions)))}))")


def contract_of(index_code: str = "index_code") -> Column:
    """The standard good an index prices, as a struct."""
    table = ", ".join(
        f"'{code}', named_struct('display_name', '{c['display_name']}', 'vram_gb', {c['vram_gb']}, "
        f"'node_size', {NODE_SIZE}, 'interconnect', '{c['interconnect']}', 'form_factor', '{CONTRACT_FORM}')"
        for code, c in CONTRACTS.items()
    )
    return F.expr(f"element_at(map({table}), {index_code})")


def contracts_frame(spark):
    """The contract dimension as a table."""
    rows = [
        (code, c["display_name"], c["vram_gb"], NODE_SIZE, CONTRACT_FORM, c["interconnect"],
         "on_demand", CONTRACT_REGION, list(c["aliases"]))
        for code, c in CONTRACTS.items()
    ]
    return spark.createDataFrame(
        rows,
        "index_code string, display_name string, vram_gb int, node_size int, form_factor string, "
        "interconnect string, commitment string, region string, aliases array<string>",
    )


def methodology_frame(spark, versions: Registry | None = None):
    """The rule registry as a table, one row per version."""
    versions = versions or METHODOLOGIES
    rows = spark.range(1).select(F.explode(literal(list(versions))).alias("methodology_version"))
    return rows.select(rules_of(versions).alias("m")).select("m.*")
