import pytest

from pageloom.plans.config import parse_settings, resolve_models, with_settings
from pageloom.plans.options import IngestOptions


def test_settings():
    text = "# note\nA = 'x y'\n\nB=\"1\nC=a=b\n=none\n1D=2\nE\nA=again\nG=kept"
    assert parse_settings(text, {"G": "before"}) == {"A": "x y", "B": '"1', "C": "a=b", "G": "before"}


def test_options_from_settings():
    s = {"OCR_MODEL_PROFILE": "dev", "OCR_REPAIR_MAX_PAGES": "3", "OCR_RASTER_DPI_PRIMARY": "90"}
    got = with_settings(IngestOptions(), s)
    assert (got.profile, got.max_pages, got.dpi) == ("dev", 3, (90, 150))
    assert with_settings(IngestOptions(max_ocr_pages=0), s).max_pages is None
    assert with_settings(IngestOptions(), {"OCR_REPAIR_MAX_PAGES": "-1"}).max_pages is None
    assert with_settings(IngestOptions(), s, profile_given=True).profile == "quality"
    with pytest.raises(ValueError):
        with_settings(IngestOptions(), {"OCR_REPAIR_MAX_PAGES": "abc"})


def test_models(tmp_path):
    names = {"detector": ["d1", "d2"], "recogniser": ["r"], "words": ["w"], "fallback_recogniser": ["f"]}
    assert resolve_models(str(tmp_path), names) is None
    for x in ("d2", "r", "w"):
        (tmp_path / x).write_text("")
    got = resolve_models(str(tmp_path), names)
    assert got.label("lib-1") == "lib-1;det=d2;rec=r" == got.label("lib-1", fallback=True)
    (tmp_path / "f").write_text("")
    assert resolve_models(str(tmp_path), names).label("lib-1", fallback=True).endswith("rec=f")
    assert resolve_models(str(tmp_path), names, {"DETECTOR_FILE": str(tmp_path / "no")}) is None
