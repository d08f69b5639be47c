"""Metres as automata over heavy and light syllables, and the best reading of a verse under them.

A metre is a row of places, each a choice of syllable strings. Compiled, its arcs are arrays, and a verse is read by
dynamic programming over all states at once: each letter either ends no syllable or takes one arc.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .marks import HEAVY, LIGHT, NONE, VERSE

#: The places of each metre, choices parted by a bar.
_HALF = "H H|LL H H|LL H"
_IAMB = "H|L|LL H|LL L H|LL"
METRES = {
    "hex": " ".join(["H H|LL"] * 5) + " H H|L",
    "penta": f"{_HALF} H L L H L L H|L",
    "ia6": f"{_IAMB} {_IAMB} H|L|LL H|LL L H|L",
    "ia6c": f"{_IAMB.replace(' L ', ' L|LL ')} {_IAMB.replace(' L ', ' L|LL ')} H|L|LL H|LL L|LL H|L",
    "troch_tet": " ".join(["H|LL L H|LL H|L|LL"] * 3) + " H|LL L H|L",
    "anap_tet": " ".join(["LLH|HH|HLL"] * 7) + " H|L",
    "chol": f"{_IAMB} {_IAMB} H|L|LL H|LL H H|L",
}
#: Names of metres in corpora.
NAMES = {
    "dactylic hexameter": "hex", "hexameter": "hex", "dactylic pentameter": "penta", "pentameter": "penta", "iambic trimeter (tragic)": "ia6",
    "iambic trimeter (anapaestic)": "ia6c", "ia6": "ia6", "ia6g": "ia6", "tr7": "troch_tet", "!_tr7": "troch_tet", "an4": "anap_tet", "an4cat": "anap_tet", "choliambic": "chol",
}


@dataclass(frozen=True)
class Automaton:
    """Arcs sorted by target; the state of no syllable yet is 0, the accepting one the last."""

    source: np.ndarray
    target: np.ndarray
    label: np.ndarray
    starts: np.ndarray
    size: int


@functools.cache
def compiled(metre: str) -> Automaton:
    places = METRES[metre].split() if metre in METRES else metre.split()
    arcs, inner = [], len(places) + 1
    for p, place in enumerate(places):
        for choice in place.split("|"):
            path = [p, *range(inner, inner + len(choice) - 1), p + 1]
            inner += len(choice) - 1
            arcs += [(a, b, HEAVY if c == "H" else LIGHT) for a, b, c in zip(path[:-1], path[1:], choice, strict=True)]
    end = len(places)
    # every state may also wait; syllables into the end are the verse's last
    arcs = [(a, b, VERSE if b == end else c) for a, b, c in arcs] + [(s, s, NONE) for s in range(inner)]
    source, target, label = np.array(sorted(arcs, key=lambda x: (x[1], x[2] != NONE, x[0])), np.int64).T
    return Automaton(source, target, label, np.searchsorted(target, np.arange(inner)), end)


def read_verse(logp: np.ndarray, metre: str) -> tuple[np.ndarray | None, float]:
    """Labels of the letters (rows of log probabilities of the four classes) that make the likeliest verse of a metre,
    and their sum; None and -inf if no verse of it fits."""
    a = compiled(metre)
    score = np.full(len(a.starts), -np.inf)
    score[0] = 0.0
    took = np.empty((len(logp), len(a.starts)), np.int64)
    for i, row in enumerate(np.asarray(logp, float)):
        each = score[a.source] + row[a.label]
        score = np.maximum.reduceat(each, a.starts)
        best = np.flatnonzero(each == score[a.target])
        took[i, a.target[best[::-1]]] = best[::-1]  # the first of equals
    if score[a.size] == -np.inf:
        return None, -np.inf
    labels, state = np.zeros(len(logp), np.int64), a.size
    for i in range(len(logp) - 1, -1, -1):
        arc = took[i, state]
        labels[i], state = a.label[arc], a.source[arc]
    return labels, float(score[a.size])


def best_metre(logp: np.ndarray, metres: tuple[str, ...] = tuple(METRES)) -> tuple[str | None, np.ndarray | None, float]:
    """The metre of the likeliest reading, its labels, and its mean log probability a letter."""
    found = [(m, *read_verse(logp, m)) for m in metres]
    found = [x for x in found if x[1] is not None]
    if not found:
        return None, None, -np.inf
    m, labels, total = max(found, key=lambda x: x[2])
    return m, labels, total / len(logp)


def gated(logp: np.ndarray, metre: str | None = None, theta: float = 0.1) -> tuple[str | None, np.ndarray, bool]:
    """(metre, labels, applied): the reading under a metre (None: the best one), unless it costs more than theta a
    letter against taking each letter's likeliest class, which is then the answer."""
    logp = np.asarray(logp, float)
    name, labels, mean = best_metre(logp) if metre is None else best_metre(logp, (NAMES.get(metre, metre),))
    if labels is not None and logp.max(axis=1).mean() - mean <= theta:
        return name, labels, True
    return name or metre, logp.argmax(axis=1), False


def gated_readings(theta: float = 0.1):
    """A pandas UDF of (logp array<array<double>>, metre or null)."""

    @F.pandas_udf(T.StructType([T.StructField("metre", T.StringType()), T.StructField("labels", T.ArrayType(T.IntegerType())), T.StructField("applied", T.BooleanType())]))
    def run(logp: pd.Series, metre: pd.Series) -> pd.DataFrame:
        found = [gated(np.stack([np.asarray(r, float) for r in x]), m, theta) if x is not None and len(x) else (m, np.empty(0, np.int64), False) for x, m in zip(logp, metre, strict=True)]
        return pd.DataFrame({"metre": [x[0] for x in found], "labels": [x[1].tolist() for x in found], "applied": [bool(x[2]) for x in found]})

    return run
