"""Long exact spans shared between texts: super-k-mers travel to their minimiser's bucket and are sorted there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engrava.llm.kit import batch_of, code_points, collected, mix, pairs_within, rolling, runs, sliding_min, whole_groups
from engrava.operators.skew import lookup_join
from engrava.storage import materialize

SPAN = 300
#: Characters of a minimiser. Long ones are shared by chance only rarely, so little that is not shared travels.
MINIMISER = 96
#: Texts in a bucket from which its rows are dealt to pairs of blocks, each compared by its own task.
BLOCK = 2_000
#: Copies of one text up to which every pair of copies is a row; larger groups are stars around the least id.
EXPAND = 100
_CHARS = 2_000_000


def _text_groups(batches, id_at: int, text_at: int, span: int):
    """(ids, texts) of about _CHARS characters, without texts shorter than span."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(id_at).to_pylist(), b.column(text_at).to_pylist()):
            if t is None or i is None or len(t) < span:
                continue
            ids.append(i), texts.append(t)
            size += len(t)
            if size >= _CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _super_kmers(batches, span: int, m: int):
    for ids, texts in _text_groups(batches, 0, 1, span):
        points, start = code_points(texts)
        least = sliding_min(mix(rolling(points, m).view(np.int64), 7), span - m + 1)  # of each window
        owner = np.repeat(np.arange(len(texts)), np.diff(start))[: len(least)]
        inside = np.arange(len(least)) + span <= start[1:][owner]
        at = np.flatnonzero(inside)
        low, own = least[at], owner[at]
        cut = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (own[1:] != own[:-1])]))
        count = np.diff(np.concatenate([cut, [len(at)]]))
        first, own = at[cut], own[cut]
        yield batch_of(bucket=low[cut].view(np.int64), doc=np.asarray(ids, np.int64)[own], at=(first - start[own]).astype(np.int32), size=(count - 1 + span).astype(np.int32))


def _cut_strings(batches):
    for b in batches:
        docs, texts, cuts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
        out = [(c["bucket"], c["n"], d, c["at"], t[c["at"] : c["at"] + c["size"]]) for d, t, cs in zip(docs, texts, cuts) for c in cs]
        if out:
            k, n, d, a, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(a, pa.int32()), pa.array(s, pa.string())], names=["bucket", "n", "doc", "at", "s"])


def _compare(batches, span: int, pairs: bool):
    """Sorts the windows of each bucket; yields pairs of texts that share one, or the shared stretches of each text."""
    for table in whole_groups(batches, 0, 4096):
        table = table.combine_chunks()
        key, doc = table.column(0).to_numpy(), table.column(1).to_numpy()
        at, side = table.column(2).to_numpy(), table.column(3).to_numpy()
        strings = table.column(4).to_pylist()
        edges, step = runs(key), 0
        while step < len(edges) - 1:  # buckets together up to a size
            size, stop = 0, step
            while stop < len(edges) - 1 and (stop == step or size < _CHARS):
                size += sum(map(len, strings[edges[stop] : edges[stop + 1]]))
                stop += 1
            lo, hi = edges[step], edges[stop]
            yield from _windows(key[lo:hi], doc[lo:hi], at[lo:hi], side[lo:hi], strings[lo:hi], span, pairs)
            step = stop


def _hashes(window: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Hashes of windows (by their polynomial) in their buckets."""
    with np.errstate(over="ignore"):
        return mix((window + mix(key, 3)).view(np.int64), 1)


def _windows(key, doc, at, side, strings, span, pairs):
    points, start = code_points(strings)
    own = np.repeat(np.arange(len(strings)), np.maximum(np.diff(start) - span + 1, 0))
    pos = np.concatenate([np.arange(s, e - span + 1) for s, e in zip(start[:-1], start[1:])]) if len(strings) else np.empty(0, np.int64)
    h = _hashes(rolling(points, span)[pos], key[own])
    order = np.lexsort((doc[own], h))
    h, own, pos = h[order], own[order], pos[order]
    d = doc[own]
    bounds = runs(h)
    many = np.maximum.reduceat(d, bounds[:-1]) != np.minimum.reduceat(d, bounds[:-1])
    shared = np.repeat(many, np.diff(bounds))
    h, own, pos, d = h[shared], own[shared], pos[shared], d[shared]
    if not len(h):
        return
    bounds = runs(h)
    head = np.repeat(bounds[:-1], np.diff(bounds))
    same = np.empty(len(h), bool)  # equal hashes are held against the text itself
    for i in range(0, len(h), 1 << 14):
        j = slice(i, i + (1 << 14))
        same[j] = (points[pos[j][:, None] + np.arange(span)] == points[pos[head[j]][:, None] + np.arange(span)]).all(axis=1)
    if not same.all():  # different windows with one hash: groups by the text itself
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.int64)
        names: dict[tuple, int] = {}
        for r in np.flatnonzero(np.isin(group, group[~same])):
            group[r] = names.setdefault((group[r], points[pos[r] : pos[r] + span].tobytes()), len(bounds) + len(names))
        order = np.lexsort((d, group))
        h, own, pos, d = group[order], own[order], pos[order], d[order]
        bounds = runs(h)
        shared = np.repeat(np.maximum.reduceat(d, bounds[:-1]) != np.minimum.reduceat(d, bounds[:-1]), np.diff(bounds))
        h, own, pos, d = h[shared], own[shared], pos[shared], d[shared]
        if not len(h):
            return
    if not pairs:
        o = np.lexsort((pos - start[own] + at[own], d))
        dd, p = d[o], (pos - start[own] + at[own])[o]
        cut = np.concatenate([[True], (dd[1:] != dd[:-1]) | (p[1:] > p[:-1] + 1)])
        first = np.flatnonzero(cut)
        last = np.concatenate([first[1:], [len(p)]]) - 1
        yield batch_of(doc=dd[first], a=p[first].astype(np.int32), b=(p[last] + span).astype(np.int32))
        return
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])  # a text once in each group
    h, d, own = h[fresh], d[fresh], own[fresh]
    bounds = runs(h)
    with np.errstate(over="ignore"):
        members = np.add.reduceat(mix((mix(d, 5) + mix(side[own], 6)).view(np.int64), 8), bounds[:-1])
    _, one = np.unique(members, return_index=True)  # groups of the same texts and sides give the same pairs
    take = np.zeros(len(bounds) - 1, bool)
    take[one] = True
    rows = np.repeat(take, np.diff(bounds))
    h, d, s = h[rows], d[rows], side[own][rows]

    def close():
        for i, j in pairs_within(runs(h)):
            use = ((s[i] < 0) | (s[i] != s[j])) & (d[i] != d[j])
            yield np.stack([np.minimum(d[i], d[j])[use], np.maximum(d[i], d[j])[use]], axis=1)

    for p in collected(close()):
        yield batch_of(a=p[:, 0], b=p[:, 1])


class SharedSpans:
    """Texts of a table that have a stretch of ``span`` characters in common, exactly.

    Each text is cut where its windows' minimiser changes; a run of windows with one minimiser is one packed string.
    First only (minimiser, text, place) is shuffled; strings of minimisers that occur in one text only stay where
    they are, the others travel to their bucket, where their windows are sorted by a hash and held against each other
    character by character. Equal texts are one text here (their least id), and rejoined at the end. A bucket of more
    than BLOCK texts is dealt to pairs of blocks.

    Null ids, null texts and texts shorter than the span share nothing. An id that occurs twice counts as one text.
    """

    def __init__(self, table: DataFrame, key: str, text: str, span: int = SPAN, minimiser: int = MINIMISER, block: int = BLOCK):
        self.span, self.block = span, block
        m = min(minimiser, max(1, span // 2))
        self.texts = table.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= span))
        print_ = self.texts.select("doc", F.unhex(F.md5("text")).alias("print"), F.length("text").alias("size"))
        classes = print_.groupBy("print", "size").agg(F.min("doc").alias("rep"), F.countDistinct("doc").alias("n")).where("n > 1")
        self.copies = materialize(lookup_join(print_, classes, ["print", "size"], "inner").select("doc", "rep", "n").distinct(), "copies")
        others = self.copies.where("doc <> rep").select("doc")
        self.pieces = materialize(self.texts.mapInArrow(lambda it: _super_kmers(it, span, m), "bucket long, doc long, at int, size int").join(others, "doc", "left_anti"), "pieces")

    def _strings(self) -> DataFrame:
        shared = self.pieces.groupBy("bucket").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "n")
        kept = lookup_join(self.pieces, shared, ["bucket"], "inner")
        cuts = kept.groupBy("doc").agg(F.collect_list(F.struct("bucket", "n", "at", "size")).alias("cuts"))
        return self.texts.dropDuplicates(["doc"]).join(cuts, "doc").select("doc", "text", "cuts").mapInArrow(_cut_strings, "bucket long, n long, doc long, at int, s string")

    def _compared(self, pairs: bool, schema: str) -> DataFrame:
        span, block = self.span, self.block
        blocks = F.ceil(F.col("n") / block).cast("int")
        mine = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
        rows = self._strings().withColumn("blocks", blocks).withColumn("mine", mine)
        dealt = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.xxhash64("bucket", F.least("mine", o), F.greatest("mine", o)).alias("key"), F.when(o == F.col("mine"), F.lit(-1)).when(F.col("mine") < o, F.lit(0)).otherwise(F.lit(1)).alias("side")))
        rows = rows.withColumn("to", F.explode(dealt)).select("to.key", "doc", "at", F.col("to.side").alias("side"), "s")
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _compare(it, span, pairs), schema)

    def pairs(self, expand: int = EXPAND) -> DataFrame:
        """(a, b), a < b: pairs of different ids that share a span.

        Copies are expanded into all their pairs up to ``expand`` copies of one text; beyond, each copy is paired with
        the least id of its group, which alone stands for the group in pairs with other texts.
        """
        between = self._compared(True, "a long, b long").distinct()
        small = self.copies.where(F.col("n") <= expand).select("doc", "rep")
        large = self.copies.where((F.col("n") > expand) & (F.col("doc") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("doc").alias("b"))
        own = lambda side: small.groupBy(F.col("rep").alias(side)).agg(F.collect_list("doc").alias(f"{side}s"))
        wide = between.join(own("a"), "a", "left").join(own("b"), "b", "left")
        wide = wide.select(F.explode(F.coalesce("as", F.array("a"))).alias("a"), "b", "bs").select("a", F.explode(F.coalesce("bs", F.array("b"))).alias("b"))
        within = small.alias("x").join(small.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.doc") < F.col("y.doc"))).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
        return wide.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(within).union(large)

    def classes(self) -> DataFrame:
        """(doc, rep, n): texts that occur more than once: the least id with the same text, and how many have it. In
        ``pairs`` a class of more than ``expand`` texts is a star around its rep."""
        return self.copies.select("doc", "rep", "n")

    def shared_parts(self) -> DataFrame:
        """(doc, n_chars, n_shared, share, copies): how much of each text also stands in another."""
        found = self._compared(False, "doc long, a int, b int").groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("parts"))
        step = lambda acc, p: F.struct((acc["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(p["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], p["b"]).alias("end"))
        covered = found.select(F.col("doc").alias("rep"), F.aggregate("parts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"].alias("n_found"))
        sizes = self.texts.select("doc", F.length("text").alias("n_chars")).groupBy("doc").agg(F.max("n_chars").alias("n_chars"))
        out = sizes.join(self.copies, "doc", "left").join(covered.withColumnRenamed("rep", "doc"), "doc", "left")
        shared = F.when(F.col("n").isNotNull(), F.col("n_chars")).otherwise(F.coalesce("n_found", F.lit(0)))
        return out.select("doc", "n_chars", shared.alias("n_shared"), F.round(shared / F.col("n_chars"), 6).alias("share"), F.coalesce("n", F.lit(1)).alias("copies"))
