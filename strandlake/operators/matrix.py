"""Small dense work on whole matrices, on the driver: checks, scaling, ordering, text form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

MOST = 20_000


def dense(matrix: DataFrame) -> tuple[list[str], np.ndarray]:
    """Labels and the symmetric matrix of (a, b, value) with a <= b; a kernel of at most MOST samples."""
    rows = matrix.select("a", "b", "value").limit(MOST * MOST).collect()
    labels = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    if len(labels) > MOST:
        raise ValueError("too many samples for one machine")
    at = {s: i for i, s in enumerate(labels)}
    m = np.zeros((len(labels), len(labels)))
    for r in rows:
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["value"]
    return labels, m


def is_positive_semidefinite(m: np.ndarray, slack: float = 1e-5) -> bool:
    return bool(len(m) == 0 or np.linalg.eigvalsh(m).min() > -slack)


def classical_scaling(d: np.ndarray, dims: int = 2) -> np.ndarray:
    n = len(d)
    centre = np.eye(n) - 1 / n
    value, vector = np.linalg.eigh(-0.5 * centre @ (d * d) @ centre)
    top = np.argsort(-value)[:dims]
    return vector[:, top] * np.sqrt(np.maximum(value[top], 0))


def complete_linkage(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, height); clusters n, n + 1, ... are the merged ones in order."""
    live = {i: [i] for i in range(len(d))}
    merges = []
    while len(live) > 1:
        keys = sorted(live)
        h, a, b = min((d[np.ix_(live[a], live[b])].max(), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
        merges.append((a, b, float(h)))
        live[len(d) + len(merges) - 1] = live.pop(a) + live.pop(b)
    return merges


def leaf_order(d: np.ndarray) -> list[int]:
    members: dict[int, list[int]] = {i: [i] for i in range(len(d))}
    for n, (a, b, _) in enumerate(complete_linkage(d)):
        members[len(d) + n] = members[a] + members[b]
    return members[max(members)] if members else []


def to_text(labels: list[str], m: np.ndarray) -> str:
    lines = ["\t" + "\t".join(labels)] + ["\t".join([s, *(f"{v:g}" for v in row)]) for s, row in zip(labels, m, strict=True)]
    return "\n".join(lines) + "\n"


def from_text(text: str) -> tuple[list[str], np.ndarray]:
    lines = [x for x in text.splitlines() if x]
    n = len(lines[0].split("\t")) - 1
    rows = [x.split("\t") for x in lines[1 : n + 1]]
    return [r[0] for r in rows], np.array([[float(v) for v in r[1 : n + 1]] for r in rows])
