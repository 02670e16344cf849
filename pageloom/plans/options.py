"""Options of an ingest run."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class IngestOptions:
    parse_mode: str = "auto"
    force_native_text: bool = False
    force_ocr: bool = False
    enable_complex_table_parsing: bool = False
    enable_safety_filtering: bool = False
    enable_ocr_repair: bool = False
    repair_on_scan_or_low_text: bool = False
    repair_on_structural_hole: bool = False
    ocr_repair_profile: str = "quality"
    max_ocr_pages: int | None = None
    dpi_primary: int | None = None
    dpi_fallback: int | None = None

    def __post_init__(self) -> None:
        if self.max_ocr_pages is not None and (isinstance(self.max_ocr_pages, bool) or not isinstance(self.max_ocr_pages, int)):
            raise ValueError(f"max_ocr_pages is no whole number: {self.max_ocr_pages!r}")

    @property
    def profile(self) -> str:
        return "dev" if self.ocr_repair_profile == "dev" else "quality"

    @property
    def max_pages(self) -> int | None:
        """Pages of a document that repair takes; None: all. 0 or less means all, unset depends on the profile."""
        if self.max_ocr_pages is not None:
            return self.max_ocr_pages if self.max_ocr_pages > 0 else None
        return 2 if self.profile == "dev" else None

    @property
    def dpi(self) -> tuple[int, int]:
        first, second = (100, 150) if self.profile == "dev" else (150, 220)
        return self.dpi_primary or first, self.dpi_fallback or second


def parse_options(text: str | None) -> IngestOptions:
    """Options from JSON with camel-case names; broken JSON and unknown names count as not given."""
    try:
        given = json.loads(text or "{}")
    except ValueError:
        given = {}
    names = {"".join(w.capitalize() if i else w for i, w in enumerate(f.name.split("_"))): f.name for f in fields(IngestOptions)}
    return IngestOptions(**{names[k]: v for k, v in given.items() if k in names and v is not None} if isinstance(given, dict) else {})
