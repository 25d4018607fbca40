"""Chooses toxicity's settings by three-fold cross-validation among learning rows alone: python tests/llm/choose_toxicity.py SF_DIR.

Held-out rows (crc32 of the id leaves 1 modulo 3) are never read. One setting is varied at a time, from the ones in use.
"""

import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from quillspark.llm import toxicity as T

GRID = {"Z_MIN": (2.0, 3.0, 4.0), "PRIOR": (1_000.0, 5_000.0, 20_000.0), "DRIFT": (0.02, 0.05, 0.1), "MIN_DOCS": (2, 3, 5), "ECHO": (10, 50, 200), "PREFIXES": ((), (5,), (4, 5, 6))}


def rows(folder):
    text = dict(zip(*(pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    labels = pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist()
    return [(r["doc_id"], text[r["doc_id"]], r["toxic"]) for r in labels if r["toxic"] in (0, 1) and r["doc_id"] in text and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]


def learn(some):
    """toxicity.learn without Spark."""
    n, d, words = (Counter(), Counter()), Counter(), [0, 0]
    for _, text, y in some:
        counts = Counter(T.heard(text))
        words[y] += sum(counts.values())
        own = Counter()
        for w, c in counts.items():
            for t in T.tokens(w):
                own[t] += c
        n[y].update(own)
        if y:
            d.update(own.keys())
    weights, p, s = {}, [], []
    for t, docs in d.items():
        if docs < T.MIN_DOCS:
            continue
        share = (n[0][t] + n[1][t]) / sum(words)
        a1, b1 = n[1][t] + T.PRIOR * share, words[1] - n[1][t] + T.PRIOR * (1 - share) + 1
        a0, b0 = n[0][t] + T.PRIOR * share, words[0] - n[0][t] + T.PRIOR * (1 - share) + 1
        odds = math.log(a1 / b1) - math.log(a0 / b0)
        if odds / math.sqrt(1 / a1 + 1 / a0) >= T.Z_MIN:
            weights[t] = odds
            if not t.endswith("~"):
                p.append((n[0][t] + 0.5) / words[0])
                s.append(odds)
    model = T.Model(weights)
    if weights and p:
        model.lam, model.log_k = T.extreme(np.array(p), np.array(s))
        cache = {}
        x = np.array([T.evidence(text, model, cache)[:2] for _, text, _ in some])
        model.fit = T.logistic(x, np.array([y for *_, y in some]))
    return model


def score(some):
    """F1 at the threshold over three folds, and wrong verdicts."""
    tp = wrong = positive = called = 0
    for k in range(3):
        fold = lambda r, k=k: zlib.crc32(f"fold {r[0]}".encode()) % 3 == k
        model = learn([r for r in some if not fold(r)])
        cache = {}
        for _, text, y in filter(fold, some):
            best, total = T.evidence(text, model, cache)[:2]
            hit = T.probability(model, best, total) >= T.THRESHOLD
            tp += hit and y
            wrong += hit != bool(y)
            positive += y
            called += hit
    return 2 * tp / max(1, positive + called), wrong


if __name__ == "__main__":
    some = rows(sys.argv[1])
    print(len(some), "rows,", sum(y for *_, y in some), "toxic; as is:", score(some), flush=True)
    for name, values in GRID.items():
        now = getattr(T, name)
        for v in values:
            if v != now:
                setattr(T, name, v)
                print(name, v, score(some), flush=True)
        setattr(T, name, now)
