"""Domains and numeric settings; everything the pipeline uses by default can be replaced."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values of the analysis --------------------------------------------------------------------------------
MIN_COSINES = (0.55, 0.525, 0.5, 0.475, 0.45, 0.425, 0.4, 0.375, 0.35)
REMOVED_TAGS = ("NNP", "CD", "FW", "NFP", "NNPS")
# ------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    min_total: int = 500  # a candidate's total count is over this
    popular_share: float = 1 / 300
    emerged_from: int = 2011
    tag_sample: int = 100
    sparse_count: int = 5
    sparse_steps: int = 3
    min_rho: float = 0.5
    token_min: int = 2
    token_max: int = 50
    contexts_historical: int = 250
    contexts_modern: int = 500
    match_length: int = 2
    match_rank: float = 0.01
    match_cosine: float = 0.4
    span_limit: int = 512
    seed: str = "1234"
    min_cosines: tuple[float, ...] = MIN_COSINES
    removed_tags: tuple[str, ...] = REMOVED_TAGS


@dataclass(frozen=True)
class Domain:
    """A corpus domain: its time steps in order and the first modern one."""

    name: str
    historical: tuple[str, ...]
    modern: tuple[str, ...]
    settings: Settings = field(default_factory=Settings)

    @property
    def steps(self) -> tuple[str, ...]:
        return self.historical + self.modern


PUBLISHED = Domain("published_writing", tuple(f"{y}s" for y in range(1810, 1990, 10)), ("modern",))
TWITTER = Domain("twitter", tuple(str(y) for y in range(2007, 2011)), tuple(str(y) for y in range(2011, 2022)))
DOMAINS = {d.name: d for d in (PUBLISHED, TWITTER)}
