"""The order-dependent folds: near-duplicate lines, member-id merging and box suppression.

Near-duplicate lines and boxes are folds of built-in functions. Member ids go through applyInPandas by document, each of
which is one small group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMILAR = 0.85


def is_similar(a: Column, b: Column) -> Column:
    """Whether an edit distance in lower case over the longer length leaves SIMILAR; lengths that rule it out go uncompared."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    share = lambda d: 1 - d / longer
    gap = F.abs(F.char_length(F.lower(a)) - F.char_length(F.lower(b)))
    return F.when(longer == 0, True).when(share(gap) < SIMILAR, False).otherwise(share(F.levenshtein(F.lower(a), F.lower(b))) >= SIMILAR)


def without_near_duplicates(lines: Column) -> Column:
    """Lines in order, each dropped if a kept one is SIMILAR to it; a longer one takes the kept one's place."""
    clean = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\s;:)(.,-]+", ""), r"\s+", " "))), lambda x: (x != "") & ~F.lower(x).rlike(r"^page \d+ of \d+$"))

    def step(kept: Column, x: Column) -> Column:
        close = lambda k: is_similar(k, x)
        longer = F.transform(kept, lambda k: F.when(close(k) & (F.char_length(x) > F.char_length(k)), x).otherwise(k))
        return F.when(F.exists(kept, close), longer).otherwise(F.array_append(kept, x))

    return F.aggregate(clean, F.array().cast("array<string>"), step)


def near_dup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and its lines without near-duplicates, over all lines of the document."""
    return docs.select("doc_id", without_near_duplicates(F.split(F.col(text), "\n")).alias("lines"))


def distance(a: str, b: str) -> int | None:
    """Substitutions between strings of equal length, or of one that has a character more; None if more than two."""
    if len(a) == len(b):
        d = sum(x != y for x, y in zip(a, b, strict=True))
    elif abs(len(a) - len(b)) == 1:
        long, short = (a, b) if len(a) > len(b) else (b, a)
        d = 1 + min(sum(x != y for x, y in zip(long[:i] + long[i + 1 :], short, strict=True)) for i in range(len(long)))
    else:
        return None
    return d if d <= 2 else None


def consensus(members: list[tuple[str, float]]) -> str:
    """The string over the members' characters at each place that is nearest to all: least largest distance, then least
    weighted sum, then the first in order.

    Only places where members differ are searched, depth first. A branch ends once its distances so far can't give a better
    string, so the search is whole at any number of places; its first descent takes each place's heaviest character.
    """
    size = len(members[0][0])
    same = [(v, s + 1) for v, s in members if len(v) == size]
    open_ = [i for i in range(size) if len({v[i] for v, _ in same}) > 1]
    cost = lambda c, i: tuple(int(v[i] != c) for v, _ in same)
    weighed = lambda d: sum(x * w for x, (_, w) in zip(d, same, strict=True))
    choices = [sorted({v[i] for v, _ in same}, key=lambda c, i=i: (weighed(cost(c, i)), c)) for i in open_]
    # The least weighted sum that the places from k on can add.
    rest = [0.0] * (len(open_) + 1)
    for k in range(len(open_) - 1, -1, -1):
        rest[k] = rest[k + 1] + min(weighed(cost(c, open_[k])) for c in choices[k])
    best: list = [None]

    def search(k: int, apart: tuple[int, ...], chosen: tuple[str, ...]) -> None:
        top, total = max(apart, default=0), weighed(apart)
        if best[0] is not None and (top, total + rest[k]) > best[0][:2]:
            return
        if k == len(open_):
            whole = list(members[0][0])
            for i, c in zip(open_, chosen, strict=True):
                whole[i] = c
            found = (top, total, "".join(whole))
            best[0] = found if best[0] is None else min(best[0], found)
            return
        for c in choices[k]:
            search(k + 1, tuple(a + b for a, b in zip(apart, cost(c, open_[k]), strict=True)), (*chosen, c))

    search(0, (0,) * len(same), ())
    return best[0][2]


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(zip(group["value"], group["score"], group["n"], strict=True), key=lambda r: (-r[1], r[0]))
    out, left = [], rows
    while left:
        head = left[0]
        own = [r for r in left if r is head or distance(r[0], head[0]) is not None]
        left = [r for r in left if r not in own]
        out.append((group["doc_id"].iloc[0], consensus([(r[0], r[1]) for r in own]), sum(r[1] for r in own), sum(int(r[2]) for r in own), len(own)))
    return pd.DataFrame(out, columns=["doc_id", "value", "score", "n", "members"])


def merge_member_ids(candidates: DataFrame) -> DataFrame:
    """Clusters a document's (value, score, n) greedily from the best score; each cluster becomes its consensus."""
    rows = candidates.select("doc_id", "value", F.col("score").cast("double").alias("score"), F.col("n").cast("long").alias("n"))
    return rows.groupBy("doc_id").applyInPandas(_merge, "doc_id long, value string, score double, n long, members long")


def iou(a: tuple, b: tuple) -> float:
    """Overlap of boxes (x, y, width, height) over their union."""
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0


BOXES = "doc_id long, page int, box int, x double, y double, w double, h double, conf double, text string"


def overlaps(a: Column, b: Column) -> Column:
    """Whether iou of two boxes is above 0.6, in the same steps; boxes with an unknown side overlap nothing."""
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    common = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    union = a.w * a.h + b.w * b.h - common
    sides = a.x + a.y + a.w + a.h + b.x + b.y + b.w + b.h
    return F.when(sides.isNull() | F.isnan(sides) | (union <= 0), False).otherwise(common / union > 0.6)


def suppress_boxes(boxes: DataFrame) -> DataFrame:
    """Of boxes of a page that overlap by more than 0.6 the one of higher confidence, then of the lower number.

    A fold of built-in functions over a page's boxes in that order; unknown confidences and numbers come last.
    """
    cast = [F.col(c).cast(kind).alias(c) for c, kind in (f.split() for f in BOXES.split(", "))]
    unknown = F.col("conf").isNull() | F.isnan("conf")
    place = [unknown.alias("_unsure"), F.when(~unknown, -F.col("conf")).alias("_rank"), F.col("box").isNull().alias("_unnumbered")]
    held = F.struct(*place, "box", "x", "y", "w", "h", "text", "conf")
    pages = boxes.select(*cast).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(held)).alias("_boxes"))
    keep = lambda kept, b: F.when(F.exists(kept, lambda k: overlaps(k, b)), kept).otherwise(F.array_append(kept, b))
    kept = F.aggregate("_boxes", F.slice("_boxes", 1, 0), keep)
    return pages.select("doc_id", "page", F.inline(kept)).select(*[f.split()[0] for f in BOXES.split(", ")])
