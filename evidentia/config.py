"""Settings of the operators, checked once on the driver."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults every result depends on.
CHUNK_CHARACTERS = 1_200
OVERLAP_CHARACTERS = 150
NATIVE_TEXT_MINIMUM = 40
BM25_K = 1.2
BM25_B = 0.75
MESSAGE_CODE_POINTS = 600
HISTORY_PAIRS = 10
BODY_BYTES = 32 * 1024
EVENT_BYTES = 64 * 1024
STREAM_BYTES = 1024 * 1024
OUTPUT_CODE_POINTS = 8_192
LINE_CHARS = 4_096              # of a provider stream, as the next one
COMPLETION_EVENT_CHARS = 8_192
LABEL_CODE_POINTS = 1_024
MAX_SOURCES = 8
SENTINEL_CODE_POINTS = 80

# Ordered enumerations.
INTENTS = (
    "overview",
    "problem",
    "research",
    "solution",
    "architecture",
    "interaction",
    "technology",
    "form",
    "value",
    "comparison",
    "contribution",
)
PROVENANCES = (
    "document_fact",
    "document_synthesis",
    "owner_statement",
    "candidate_contribution",
)
DENSITIES = ("low", "medium", "high")


@dataclass(frozen=True)
class ChunkingConfig:
    size: int = CHUNK_CHARACTERS
    overlap: int = OVERLAP_CHARACTERS

    def __post_init__(self) -> None:
        if self.size < 1 or not 0 <= self.overlap < self.size:
            raise ValueError("chunk size must be positive and larger than the overlap")


@dataclass(frozen=True)
class RetrievalConfig:
    minimum_score: float = 2.5
    max_results: int = 8
    max_per_source: int = 3

    def __post_init__(self) -> None:
        if not 0 <= self.minimum_score < float("inf"):
            raise ValueError("minimum_score must be a finite non-negative number")
        for name in ("max_results", "max_per_source"):
            value = getattr(self, name)
            if not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a positive integer")

    def limit(self, requested: int | None) -> int:
        """A caller limit can lower the configured ceiling, never raise it."""
        if requested is None:
            return self.max_results
        if not isinstance(requested, int) or isinstance(requested, bool) or requested < 0:
            raise ValueError("limit must be a finite non-negative integer")
        return min(self.max_results, requested)


@dataclass(frozen=True)
class AdmissionPolicy:
    cooldown_ms: int = 3_000
    window_ms: int = 60_000
    window_limit: int = 6
    visitor_day_limit: int = 30
    site_day_limit: int = 300

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if not isinstance(value, int) or isinstance(value, bool) or value < 0:
                raise ValueError(f"{name} must be a non-negative integer")
        if 0 in (self.window_ms, self.window_limit, self.visitor_day_limit, self.site_day_limit):
            raise ValueError("windows and limits must be positive")

    def require_ordered(self) -> "AdmissionPolicy":
        """Deployment rule: window limit <= visitor-day limit <= site-day limit."""
        if not self.window_limit <= self.visitor_day_limit <= self.site_day_limit:
            raise ValueError("limits must grow from window to visitor day to site day")
        return self

    @property
    def memory_ms(self) -> int:
        """How far back an admitted request can still influence a later one."""
        return max(self.cooldown_ms, self.window_ms)
