"""Settings of analyses and exports, checked where they are made."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields

#: Comparisons that a run of the reference's size refuses to go over; here a bound that callers may ask for.
LARGEST_COMPARISON = 2_000_000


@dataclass(frozen=True)
class ReviewSettings:
    """Thresholds of an analysis and how near copies are compared. Values out of range raise ValueError."""

    min_width: int = 320
    min_height: int = 240
    min_sharpness: float = 80.0
    max_underexposed_ratio: float = 0.35
    max_overexposed_ratio: float = 0.35
    max_low_information: float = 0.72
    phash_distance: int = 8
    ssim_threshold: float = 0.94
    similarity_scope: str = "source"
    video_time_window_ms: int = 30_000

    def __post_init__(self) -> None:
        shares = (self.max_underexposed_ratio, self.max_overexposed_ratio, self.max_low_information, self.ssim_threshold)
        if self.min_width <= 0 or self.min_height <= 0 or not math.isfinite(self.min_sharpness):
            raise ValueError("sizes must be positive and the sharpness finite")
        if not all(0.0 <= s <= 1.0 for s in shares):
            raise ValueError("ratios and the similarity threshold must be in [0, 1]")
        if not 0 <= self.phash_distance <= 64 or self.video_time_window_ms < 0:
            raise ValueError("the distance must be from 0 to 64 and the window not negative")
        if self.similarity_scope not in ("source", "source_group", "project"):
            raise ValueError("an unknown scope")


@dataclass(frozen=True)
class ExportSettings:
    """What an export takes where its request doesn't say."""

    source_scope: str = "current"
    content: str = "tiles"
    review_scope: str = "eligible"
    conflict: str = "sequence"
    excluded_tiles: tuple = ()

    def __post_init__(self) -> None:
        known = {"source_scope": ("current", "group"), "content": ("tiles", "frames"), "review_scope": ("eligible", "all"), "conflict": ("sequence", "hash", "skip", "fail")}
        for name, values in known.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {values}")


def settings_of(kind: type, request: dict):
    """Settings out of a request: missing fields get their defaults, unknown ones raise ValueError."""
    names = {f.name for f in fields(kind)}
    if unknown := set(request) - names:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return kind(**request)


def request_of(settings) -> dict:
    """Settings as a request that gives them back."""
    return asdict(settings)
