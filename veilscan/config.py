"""Tunable numbers of the engine, as one immutable value handed to the operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from veilscan import fixed_values as fv


@dataclass(frozen=True)
class Settings:
    """Every threshold, weight and list the operators read.

    The defaults are the published ones; use :meth:`with_` to derive a variant.
    """

    # ingestion
    max_text_length: int | None = None  # whole texts; a limit cuts what is looked at and sets ``truncated``
    max_table_rows: int | None = None  # all rows
    extensions: tuple[str, ...] = fv.EXTENSIONS
    excluded_names: tuple[str, ...] = fv.EXCLUDED_NAMES
    # detection
    min_score: float = 0.5
    snippet_chars: int = 1_500
    entities: tuple[str, ...] = fv.ENTITIES
    context_boost: float = 0.0
    # risk
    weights: dict[str, int] = field(default_factory=lambda: dict(fv.WEIGHTS))
    unscored: tuple[str, ...] = fv.UNSCORED
    high: int = 40
    medium: int = 15
    max_score: int = 100
    sensitive_weight: int = 6
    bonus_tiers: tuple[tuple[int, int], ...] = fv.BONUS_TIERS
    identity_types: tuple[str, ...] = fv.IDENTITY_TYPES
    sensitive_types: tuple[str, ...] = fv.SENSITIVE_TYPES
    # compliance
    identifier_types: tuple[str, ...] = fv.IDENTIFIER_TYPES
    dpdp_cap_crore: int = 250
    gdpr_fixed_cap_eur: int = 20_000_000
    gdpr_turnover_pct: int = 4
    turnover_eur: int = 500_000_000
    eur_to_inr: int = 90
    exposure_people: int = 100_000
    exposure_scale: int = 60
    exposure_severity: int = 40
    retention_years: int = 3
    top_redacted: int = 10
    # evaluation
    evaluated: tuple[str, ...] = fv.EVALUATED

    def __post_init__(self) -> None:
        if not 0 <= self.min_score <= 1:
            raise ValueError("min_score must lie between 0 and 1")

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULT = Settings()
