"""Evaluation texts inside training text: one automaton over the passages' word windows, one scan of each document."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engrava.llm.kit import WORD, words

WINDOW = 13
#: Windows that one automaton holds (about 100 MB of it), and automata that one scan of the documents holds; more passages
#: mean more scans.
MAX_PATTERNS, TOGETHER = 200_000, 4

_built: dict = {}


def passage_blocks(passages: DataFrame, key: str, text: str, window: int, most: int = MAX_PATTERNS):
    """The passages' distinct word windows with their keys, in blocks of at most about ``most`` windows."""
    block: dict[str, set] = {}
    for k, t in passages.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).toLocalIterator():
        w = words(t)
        for i in range(len(w) - window + 1):
            block.setdefault(f" {' '.join(w[i : i + window])} ", set()).add(k)
        if len(block) >= most:
            yield block
            block = {}
    if block:
        yield block


def _automaton(tag: str, block: dict):
    if tag not in _built:
        import ahocorasick

        a = ahocorasick.Automaton()
        for pattern, keys in block.items():
            a.add_word(pattern, (pattern.count(" ") - 1, tuple(sorted(keys))))
        a.make_automaton()
        while len(_built) >= TOGETHER:
            del _built[next(iter(_built))]
        _built[tag] = a
    return _built[tag]


def word_offsets(text: str) -> tuple[list[int], list[int]]:
    """Where each normalised word starts and ends in the text as given (lower-casing may change lengths)."""
    low = text.lower()
    at = None
    if len(low) != len(text):
        at = [i for i, c in enumerate(text) for _ in c.lower()]
        if len(at) != len(low):  # a final sigma and the like: fall back to the shorter of both
            at = (at + [len(text)] * len(low))[: len(low)]
    spans = [m.span() for m in WORD.finditer(low)]
    if at is None:
        return [s for s, _ in spans], [e for _, e in spans]
    return [at[s] for s, _ in spans], [at[e - 1] + 1 for _, e in spans]


def _scan(batches, blocks: list[tuple], spans: bool):
    automata = [_automaton(tag, block.value) for tag, block in blocks]
    for b in batches:
        ids, out = b.column(0), ([], [], [], [])
        for row, text in enumerate(b.column(1).to_pylist()):
            if not text:
                continue
            found: dict = {}
            w = WORD.findall(text.lower())
            norm = f" {' '.join(w)} "
            for a in automata:
                for end, (n, keys) in a.iter(norm):
                    for k in keys:
                        found.setdefault(k, []).append((end, n))
            if not found:
                continue
            if not spans:
                for k in sorted(found):
                    out[0].append(row), out[1].append(k)
                continue
            starts, ends = word_offsets(text)
            ending = []  # the normalised text's index of the blank after each word
            at = 0
            for x in w:
                at += len(x) + 1
                ending.append(at)
            for k, hits in sorted(found.items()):
                merged: list[list[int]] = []
                for end, n in sorted(hits):
                    last = bisect_right(ending, end) - 1
                    s, e = last - n + 1, last + 1
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                for s, e in merged:
                    out[0].append(row), out[1].append(k), out[2].append(starts[s]), out[3].append(ends[e - 1])
        if out[0]:
            cols = [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1])]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())] if spans else []), names=["doc", "key", "start_at", "end_at"][: 4 if spans else 2])


def leaked(documents: DataFrame, doc: str, text: str, passages: DataFrame, key: str, passage: str, window: int = WINDOW, spans: bool = False, most: int = MAX_PATTERNS) -> DataFrame:
    """(doc, key) for each document that has ``window`` consecutive words of a passage; with ``spans`` also where.

    Case, punctuation and spacing don't count, an underscore separates words. ``start_at`` and ``end_at`` are
    positions in the document as given; overlapping windows of one passage are one span. Null and blank texts match
    nothing, nor do passages shorter than the window; repeated documents each report; repeated keys are one key.
    Nothing is shuffled: the passages are the stated query set, sent in blocks of bounded size, several of which
    are looked for in one scan.
    """
    spark = documents.sparkSession
    kind = {k: t for k, t in passages.dtypes}[key]
    schema = f"doc {dict(documents.dtypes)[doc]}, key {kind}" + ", start_at int, end_at int" * spans
    blocks = [(uuid4().hex, spark.sparkContext.broadcast(block)) for block in passage_blocks(passages, key, passage, window, most)]
    scan = lambda some: documents.select(doc, text).mapInArrow(lambda it: _scan(it, some, spans), schema)
    parts = [scan(blocks[i : i + TOGETHER]) for i in range(0, len(blocks), TOGETHER)]
    if not parts:
        return spark.createDataFrame([], schema)
    out = reduce(DataFrame.union, parts)
    return out.distinct() if len(parts) > 1 and not spans else out
