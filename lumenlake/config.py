"""Settings that change results, with their defaults and bounds."""

from __future__ import annotations

from dataclasses import dataclass

_BOUNDS = {
    "event_gap_hours": (0, 168), "burst_gap_seconds": (1, 3600), "gps_cluster_km": (0, 1000), "trip_home_radius_km": (0, 200),
    "trip_min_distance_km": (0, 20000), "trip_max_days": (1, 90), "trip_context_days": (30, 365), "max_analysis_attempts": (1, 100),
}


@dataclass(frozen=True)
class Settings:
    scan_max_files: int = 0  # 0: no limit
    max_analysis_attempts: int = 3
    max_file_mb: int = 250
    max_image_megapixels: int = 100
    thumb_size: int = 360
    preview_size: int = 1600
    jpeg_quality: int = 84
    event_gap_hours: float = 8.0
    burst_gap_seconds: int = 45
    gps_cluster_km: float = 25.0
    trip_home_radius_km: float = 30.0
    trip_min_distance_km: float = 100.0
    trip_max_days: int = 30
    trip_context_days: int = 90
    # Folders that are never photos, and the supported suffixes.
    skip_directories: tuple[str, ...] = ("@eaDir", "#recycle", ".snapshot", ".thumbnails")
    supported_extensions: tuple[str, ...] = (".jpg", ".jpeg", ".jpe", ".png", ".webp", ".heic", ".heif", ".tif", ".tiff", ".bmp", ".gif")
    analysis_version: int = 1
    collection_version: int = 2

    def __post_init__(self) -> None:
        for name, (low, high) in _BOUNDS.items():
            value = getattr(self, name)
            if not low <= value <= high or (low == 0 and value == 0):
                raise ValueError(f"{name} must be within {low} and {high}")

    @property
    def suffixes(self) -> frozenset[str]:
        """Lower-cased suffixes with their dot."""
        return frozenset(e.lower() if e.startswith(".") else f".{e.lower()}" for e in self.supported_extensions)

    @property
    def skipped(self) -> frozenset[str]:
        return frozenset(d.casefold() for d in self.skip_directories)
