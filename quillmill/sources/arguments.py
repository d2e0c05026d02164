"""Checks of what a run is asked for: lists of what is wrong, empty if nothing is."""

from __future__ import annotations

import os

from quillmill.functions import text as T
from quillmill.operators.bibliography import MODES

#: Options that only an OCR service knows, and what they are when they are off.
SERVICE_ONLY = {"table_format": "none", "extract_header": False, "extract_footer": False, "include_blocks": False, "confidence_scores": None, "save_ocr_json": False, "include_images": False}


def dedupe_modes(given: str) -> tuple[list[str], list[str]]:
    """(modes, what is wrong) of a list such as `key, DOI`."""
    modes = [m for m in (x.strip().casefold() for x in given.split(",")) if m]
    wrong = sorted(set(modes) - set(MODES))
    return modes, ([f"unknown modes: {', '.join(wrong)}"] if wrong else []) + ([] if modes else ["no mode is given"])


def merge_inputs(*paths: str) -> list[str]:
    return [f"{p} isn't there" if not os.path.exists(p) else f"{p} isn't a file" for p in paths if not os.path.isfile(p)]


def pdf_run(path: str, pages: str | None = None, output: str | None = None) -> list[str]:
    """A PDF or a folder of them; pages can be chosen of one file only, and a folder's output is a folder."""
    if not os.path.exists(path):
        return [f"{path} isn't there"]
    if os.path.isdir(path):
        return ["pages can be chosen of a single file only"] * bool(pages) + ["the output of a folder must be a folder"] * bool(output and os.path.isfile(output))
    return [] if path.lower().endswith(".pdf") else [f"{path} isn't a PDF"]


def ocr_options(local: bool, options: dict) -> tuple[dict, list[str]]:
    """(options, names of those ignored): a local model knows none of the service's."""
    ignored = [k for k, off in SERVICE_ONLY.items() if local and options.get(k, off) != off]
    return options | {k: SERVICE_ONLY[k] for k in ignored}, ignored


def narration(path: str, chunk_chars: int, batch_size: int) -> list[str]:
    wrong = ["a chunk has 200 characters at least"] * (chunk_chars < 200) + ["a batch has 1 chunk at least"] * (batch_size < 1)
    if not os.path.exists(path):
        return [*wrong, f"{path} isn't there"]
    return wrong + ["a Markdown file is expected"] * (os.path.splitext(path)[1].lower() not in (".md", ".markdown"))


def image_input(path: str) -> list[str]:
    if not os.path.exists(path):
        return [f"{path} isn't there"]
    suffix = os.path.splitext(path)[1].lower()
    return [f"not supported: {suffix}"] if os.path.isfile(path) and suffix not in T.IMAGE_SUFFIXES else []
