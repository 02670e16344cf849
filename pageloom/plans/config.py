"""Settings from files and the environment, and which model files a run would use."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pageloom.plans.options import IngestOptions


def parse_settings(text: str, given: Mapping[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines as a dictionary: comments, blank lines and bad keys left out, one pair of quotes removed. What is in `given` stays."""
    out = dict(given or {})
    for line in map(str.strip, text.splitlines()):
        key, sign, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if line.startswith("#") or not sign or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key) or key in out:
            continue
        out[key] = value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0] else value
    return out


def _whole(settings: Mapping[str, str], name: str) -> int | None:
    text = settings.get(name, "").strip()
    if not text:
        return None
    if not re.fullmatch(r"-?\d+", text):
        raise ValueError(f"{name} is no whole number: {text!r}")
    return int(text)


def with_settings(options: IngestOptions, settings: Mapping[str, str], *, profile_given: bool = False) -> IngestOptions:
    """Options completed from settings: profile (unless given), resolutions and page cap. Options that are set win."""
    profile = options.ocr_repair_profile if profile_given else settings.get("OCR_MODEL_PROFILE", options.ocr_repair_profile)
    cap = options.max_ocr_pages if options.max_ocr_pages is not None else _whole(settings, "OCR_REPAIR_MAX_PAGES")
    return replace(options, ocr_repair_profile=profile, max_ocr_pages=cap, dpi_primary=options.dpi_primary or _whole(settings, "OCR_RASTER_DPI_PRIMARY"), dpi_fallback=options.dpi_fallback or _whole(settings, "OCR_RASTER_DPI_FALLBACK"))


@dataclass(frozen=True)
class Models:
    detector: str
    recogniser: str
    words: str
    fallback_recogniser: str | None = None

    def label(self, library: str, fallback: bool = False) -> str:
        name = self.fallback_recogniser if fallback and self.fallback_recogniser else self.recogniser
        return f"{library};det={os.path.basename(self.detector)};rec={os.path.basename(name)}"


def resolve_models(folder: str, candidates: Mapping[str, Sequence[str]], settings: Mapping[str, str] | None = None) -> Models | None:
    """The first file there is for each role (detector, recogniser, words; fallback_recogniser if any), None if one of the three is missing.

    settings may name a file for a role as ROLE_FILE (upper case), which goes before the candidates.
    """
    found: dict[str, str | None] = {}
    for role in ("detector", "recogniser", "words", "fallback_recogniser"):
        named = (settings or {}).get(f"{role.upper()}_FILE", "").strip()
        paths = [named] if named else [os.path.join(folder, x) for x in candidates.get(role, ())]
        found[role] = next((p for p in paths if os.path.isfile(p)), None)
    return Models(**found) if all(found[x] for x in ("detector", "recogniser", "words")) else None
