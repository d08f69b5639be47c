"""Seeded corruption of letter planes for training: masked spans, words, parts of words, single letters, wrong letters,
and gaps of open width. A row's noise depends on its key and the seed alone, so a retried task repeats it."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids of a masked letter and of "no letter here", the label of a letter that is not asked.
LETTERS, MASK, BLANK, UNASKED = 24, 24, 25, -100
PATTERNS = ("span", "word", "elastic", "iid", "halfword", "substitute")


@dataclass(frozen=True)
class Noise:
    """Weights of the patterns, the Beta distribution of the noised share and its bounds, lengths of spans,
    surplus of elastic gaps, anchors of parts of words, and how often a plane is wholly known or unknown."""

    weights: tuple[float, ...] = (0.15, 0.20, 0.15, 0.15, 0.20, 0.15)
    beta: tuple[float, float] = (2.0, 4.0)
    share: tuple[float, float] = (0.05, 0.95)
    span_mean: float = 3.5
    span_max: int = 20
    surplus: float = 0.3
    surplus_least: int = 2
    anchors: tuple[float, float, float] = (0.5, 0.3, 0.2)
    known: tuple[tuple[float, float], ...] = ((0.5, 0.3), (0.3, 0.5), (0.3, 0.5))


def generator(key, seed: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "big"))


def _word_spans(boundary: np.ndarray) -> list[tuple[int, int]]:
    ends = np.flatnonzero(boundary > 0) + 1
    return list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if len(ends) else [(0, len(boundary))]


def _part_of(s: int, e: int, cfg: Noise, rng: np.random.Generator) -> tuple[int, int]:
    """A stretch of a word at its end, its beginning, or touching neither."""
    n, anchor = e - s, rng.choice(3, p=np.array(cfg.anchors) / sum(cfg.anchors))
    if n <= 1:
        return s, e
    k = int(rng.integers(1, n + 1))
    if anchor < 2:
        return (e - k, e) if anchor == 0 else (s, s + k)
    if n == 2:
        return s, e
    k = min(k, n - 2)
    at = s + int(rng.integers(1, n - k))
    return at, at + k


def _targets(pattern: str, boundary: np.ndarray, lost: np.ndarray, share: float, cfg: Noise, rng: np.random.Generator) -> list[tuple[int, int]]:
    """Stretches without lost letters and without overlap, until the share is reached or the tries run out."""
    n, spans, words, used = len(boundary), [], _word_spans(boundary), lost.copy()
    for _ in range(4 * len(words) + 8):
        if sum(e - s for s, e in spans) >= int(share * n):
            break
        if pattern == "span":
            s = int(rng.integers(0, max(n - 1, 1)))
            s, e = s, min(n, s + min(int(rng.geometric(1 / cfg.span_mean)), cfg.span_max))
        else:
            s, e = words[rng.integers(len(words))]
            if pattern == "halfword":
                s, e = _part_of(s, e, cfg, rng)
        if s < e and not used[s:e].any():
            used[s:e] = True
            spans.append((s, e))
    return sorted(spans)


def corrupt(chars: np.ndarray, boundary: np.ndarray, rng: np.random.Generator, cfg: Noise = Noise(), lost: np.ndarray | None = None, pattern: str | None = None) -> dict:
    """pattern, share, input, labels, boundary, weight, and for boundaries, marks and stops which are shown. Lost letters
    are never chosen and never asked. An elastic gap is wider than what it hides; its surplus asks for BLANK."""
    chars, boundary = np.asarray(chars, np.int64), np.asarray(boundary, np.int64)
    lost = np.zeros(len(chars), bool) if lost is None else np.asarray(lost, bool)
    share = float(np.clip(rng.beta(*cfg.beta), *cfg.share))
    pattern = pattern or str(rng.choice(PATTERNS, p=np.array(cfg.weights) / sum(cfg.weights)))
    if pattern in ("iid", "substitute"):
        asked = (rng.random(len(chars)) < share) & ~lost
        new = (chars + rng.integers(1, LETTERS, len(chars))) % LETTERS if pattern == "substitute" else np.full(len(chars), MASK)
        pieces = [(np.where(asked, new, chars), np.where(asked, chars, UNASKED), boundary)]
    else:
        pieces, at = [], 0
        for s, e in [*_targets(pattern, boundary, lost, share, cfg, rng), (len(chars), len(chars))]:
            pieces.append((chars[at:s], np.full(s - at, UNASKED), boundary[at:s]))
            wide = cfg.surplus_least + int(rng.integers(0, int(cfg.surplus * (e - s)) + 1)) if pattern == "elastic" and e > s else 0
            edge = boundary[s:e] if pattern != "elastic" else np.append(np.zeros(max(e - s - 1, 0), np.int64), boundary[e - 1 : e] if e > s else [])
            pieces.append((np.full(e - s + wide, MASK), np.append(chars[s:e], np.full(wide, BLANK)), np.append(edge, np.zeros(wide, np.int64))))
            at = e
    given, labels, edges = (np.concatenate(x).astype(np.int64) for x in zip(*pieces, strict=True))
    out = {"pattern": pattern, "share": share, "input": given, "labels": labels, "boundary": edges, "weight": 1 / max(share, 0.05)}
    for name, (full, none) in zip(("boundary", "marks", "stops"), cfg.known, strict=True):
        u = rng.random()
        out[f"show_{name}"] = np.full(len(given), u < full) if u < full + none else rng.random(len(given)) < rng.random()
    return out


_NOISED = "pattern string, share double, input array<int>, labels array<int>, boundary array<int>, weight double, show_boundary array<boolean>, show_marks array<boolean>, show_stops array<boolean>"


def noised(seed: int = 0, cfg: Noise = Noise()):
    """A pandas UDF of (key string, chars, boundary, lost or null)."""

    @F.pandas_udf(_NOISED)
    def run(key: pd.Series, chars: pd.Series, boundary: pd.Series, lost: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([corrupt(c, b, generator(k, seed), cfg, x) if c is not None and len(c) else dict.fromkeys(x.split()[0] for x in _NOISED.split(", ")) for k, c, b, x in zip(key, chars, boundary, lost, strict=True)])

    return run


def uniform(key: Column, seed: int, name: str) -> Column:
    """A number in [0, 1) from a key, that any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(name), F.lit(seed))), 1, 8), 16, 10).cast("double") / 4294967296.0


def drop_metadata(docs: DataFrame, key: str, columns: dict[str, tuple[float, object]], seed: int = 0) -> DataFrame:
    """Each column, apart from the others, becomes its unknown value in a share of the rows."""
    return docs.withColumns({c: F.when(uniform(F.col(key), seed, c) < share, F.lit(unknown)).otherwise(F.col(c)) for c, (share, unknown) in columns.items()})


def word_window(chars: np.ndarray, boundary: np.ndarray, width: int, rng: np.random.Generator) -> tuple[int, int]:
    """[start, end) of at most `width` letters that begins behind a word's end and ends with one; the whole if it fits."""
    n, boundary = len(chars), np.asarray(boundary)
    if n <= width:
        return 0, n
    ends = np.flatnonzero(boundary > 0) + 1
    start = max(ends[ends <= rng.integers(0, n - width)].tolist(), default=0)
    inside = ends[(ends > start) & (ends <= start + width)]
    return int(start), int(inside[-1]) if len(inside) else min(start + width, n)


def windows(width: int, seed: int = 0):
    """A pandas UDF of (key string, boundary): start and end of a window."""

    @F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    def run(key: pd.Series, boundary: pd.Series) -> pd.DataFrame:
        found = [word_window(b, b, width, generator(k, seed)) if b is not None else (None, None) for k, b in zip(key, boundary, strict=True)]
        return pd.DataFrame(found, columns=["start", "end"])

    return run
