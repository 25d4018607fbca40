"""Patterns matched by RE2, as in DuckDB, over whole columns of texts.

A pattern takes RE2 some two CPU seconds a gigabyte whether it matches or not, and Java far more. So texts are looked through here
first, in one pass of Arrow batches: what no text can hold is not handed on, and whether a text has a pattern is known at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Batches = Iterator[pa.RecordBatch]


def spelled(literal: str) -> str:
    """A pattern of all texts whose upper or lower case, with runs of blanks as one, holds an ASCII literal."""
    words = ["".join("[iIİı]" if c in "iI" else re.escape(c) for c in w) for w in literal.split(" ")]
    return "(?i:" + r"[\s\x0B]+".join(words) + ")"


def has(x: pa.Array, p: str) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(x, p), False)


def some(x: pa.Array, ps: tuple[str, ...]) -> pa.Array:
    return has(x, "|".join(f"(?:{p})" for p in ps))


def held(pages: DataFrame, ps: tuple[str, ...]) -> DataFrame:
    """The rows of pages whose text has one of the patterns."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            yield b.filter(some(b["text"], ps))

    return pages.mapInArrow(run, pages.schema)


def blanked(pages: DataFrame, ps: tuple[str, ...]) -> DataFrame:
    """All rows of pages, with a null for a text that has none of the patterns."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            text = pc.if_else(some(b["text"], ps), b["text"], pa.scalar(None, b["text"].type))
            yield pa.RecordBatch.from_arrays([text if n == "text" else b[n] for n in b.schema.names], names=b.schema.names)

    return pages.mapInArrow(run, pages.schema)


def several(x: pa.Array, ps: list[str], signs: list[str]) -> list[np.ndarray]:
    """The masks of each pattern. Patterns are looked for together, then half of them each in the texts that have any: few texts do.

    signs: what a text with the pattern has as well, and what joins with others better; else the pattern itself."""
    at = np.flatnonzero(mask(x, *signs))
    found = [np.zeros(len(x), bool) for _ in ps]
    if len(at):
        few, half = x if len(at) == len(x) else x.take(pa.array(at)), len(ps) // 2
        if half:
            hits = several(few, ps[:half], signs[:half]) + several(few, ps[half:], signs[half:])
        else:
            hits = [np.ones(len(at), bool) if ps == signs else mask(few, ps[0])]
        for f, hit in zip(found, hits):
            f[at] = hit
    return found


def flagged(pages: DataFrame, flags: dict[str, str], words: dict[str, list[str]], gate: tuple[str, ...] | None = None, keep: tuple[str, ...] = ("doc_id",), signs: dict[str, str] | None = None) -> DataFrame:
    """Columns of pages, whether their text has each of the patterns flags, and whether its capitals hold one of the words.

    gate: only rows that have one of these patterns, if given. signs: as in several, by flag."""
    fields = [next(f for f in pages.schema.fields if f.name == k) for k in keep]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + [f"{k} boolean" for k in [*flags, *words]])
    ps, first = list(flags.values()), [(signs or {}).get(k, p) for k, p in flags.items()]

    def run(batches: Batches) -> Batches:
        for b in batches:
            b = b if gate is None else b.filter(some(b["text"], gate))
            x = pc.fill_null(b["text"], "")
            columns = [x if k == "text" else b[k] for k in keep] + [pa.array(m) for m in (several(x, ps, first) if ps else [])]
            high = pc.utf8_upper(x) if words else x
            for ws in words.values():
                columns.append(has(high, "|".join(map(re.escape, ws))))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *flags, *words])

    return pages.mapInArrow(run, schema)


# Lines


def split_lines(x: pa.Array) -> pa.ListArray:
    """The lines of texts as functions.text.normalized leaves them: runs of blanks as one, trimmed."""
    x = pc.replace_substring_regex(pc.fill_null(x, ""), "[ \t]{2,}|\t", " ")
    return pc.split_pattern_regex(pc.utf8_trim(x, " \t\r\n"), r"\r?\n")


def moved(hit: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The lines k below (above, if k is negative) a hit of the same text."""
    out = np.zeros_like(hit)
    if 0 < k < len(hit):
        out[k:] = hit[:-k] & (own[k:] == own[:-k])
    elif 0 < -k < len(hit):
        out[:k] = hit[-k:] & (own[:k] == own[-k:])
    return out


def mask(x: pa.Array, *ps: str) -> np.ndarray:
    return some(x, ps).to_numpy(zero_copy_only=False)


#: Of lines and their numbers the hits, and the lines that are wanted by themselves; both as masks.
Choice = Callable[[pa.Array, np.ndarray], tuple[np.ndarray, np.ndarray]]


def picked(pages: DataFrame, choice: Choice, around: tuple[int, ...]) -> DataFrame:
    """doc_id, page, line and text of the lines that choice wants, of its hits, and of the lines so many below a hit.

    So a window over these rows that looks from one of them as far as around tells is the window over all lines."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            lists = split_lines(b["text"])
            text, own = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            starts = np.cumsum([0, *lists.value_lengths().to_numpy(zero_copy_only=False)])
            line = (np.arange(len(own)) - starts[own]).astype(np.int32)
            hit, wanted = choice(text, line)
            for k in around:
                wanted = wanted | moved(hit, own, k)
            at = np.flatnonzero(hit | wanted)
            rows = pa.array(own[at])
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(rows), b["page"].take(rows), pa.array(line[at]), text.take(pa.array(at))], names=["doc_id", "page", "line", "text"])

    return pages.mapInArrow(run, "doc_id long, page int, line int, text string")


def having(*ps: str) -> Choice:
    """The lines that have one of the patterns."""

    def choice(text: pa.Array, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = mask(text, *ps)
        return hit, np.zeros_like(hit)

    return choice
