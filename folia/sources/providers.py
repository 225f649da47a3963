"""Transcription providers: a registry of names, the deterministic stub, and which credentials are there.

A provider turns a page image and its line boxes into one text a line.  Only the
stub is built in; others register a factory under their name.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from folia.operators.rows import binarize

# Fixed values. The stub's words and its row threshold.
STUB_WORD, STUB_SCALE = "نمونہ متن", 0.35


class Provider(Protocol):
    model_id: str

    def transcribe(self, gray: np.ndarray, lines: list[str]) -> list[tuple[str, str]]:
        """(line id, text) for each line; without ids, for each row that is found."""
        ...


def stub_rows(gray: np.ndarray, min_gap: int = 3) -> list[tuple[int, int]]:
    """(first, last) of bands of rows with at least a share of the mean ink of all rows."""
    ink = binarize(gray).sum(axis=1).astype(float)
    dark = np.flatnonzero(ink >= max(1.0, ink.mean() * STUB_SCALE))
    if not len(dark):
        return []
    cuts = np.flatnonzero(np.diff(dark) > min_gap)
    return [(int(a), int(b)) for a, b in zip(dark[np.append(0, cuts + 1)], dark[np.append(cuts, len(dark) - 1)], strict=True)]


class Stub:
    """Filler text, the same for the same page."""

    model_id = "stub"

    def transcribe(self, gray: np.ndarray, lines: list[str]) -> list[tuple[str, str]]:
        ids = lines or [f"l{i:03d}" for i in range(len(stub_rows(gray)))]
        return [(line, f"{STUB_WORD} {i}") for i, line in enumerate(ids)]


REGISTRY: dict[str, Callable[[str], Provider]] = {"stub": lambda _: Stub()}


def provider(spec: str) -> Provider:
    """``name`` or ``name:model``; an unknown name is an error that lists the known ones."""
    name, _, model = spec.partition(":")
    if name not in REGISTRY:
        raise KeyError(f"no provider {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](model)


def transcribe(pages: DataFrame, spec: str = "stub") -> DataFrame:
    """(doc_id, page_no, position, line_id, text) of gray pages (doc_id, page_no, width, height, pixels, line_ids)."""
    kinds = dict(pages.dtypes)

    def run(batches):
        client = provider(spec)
        for b in batches:
            out = []
            for doc, page, width, height, raw, ids in zip(b.doc_id, b.page_no, b.width, b.height, b.pixels, b.line_ids, strict=True):
                gray = np.frombuffer(raw, dtype=np.uint8).reshape(height, width)
                out += [(doc, page, i, line, text) for i, (line, text) in enumerate(client.transcribe(gray, list(ids) if ids is not None else []))]
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "position", "line_id", "text"])

    return pages.mapInPandas(run, f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, position int, line_id string, text string")


def credentials(wanted: dict[str, tuple[str, ...]], profiles: dict[str, str] | None = None) -> dict[str, str | None]:
    """For each provider the first of its variables that is set, ``profile`` if its profile file or folder is there, or nothing."""
    out: dict[str, str | None] = {}
    for name, variables in wanted.items():
        there = Path((profiles or {}).get(name, "/nowhere")).expanduser().exists()
        out[name] = next((v for v in variables if os.environ.get(v)), "profile" if there else None)
    return out
