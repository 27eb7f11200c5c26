"""Near-duplicate texts with small edits: pigeonring filtering over rings of word segments, then the exact measure."""

from __future__ import annotations

import functools
import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engrava.llm.kit import batch_of, collected, deal, hot_blocks, mix, pairs_within, runs, spread, whole_groups, words
from engrava.operators.components import connected_components
from engrava.operators.skew import lookup_join
from engrava.storage import materialize

#: Rows that an index key should have at most, on average. A chain of segments becomes a key once its words carry enough
#: bits for that; CHAIN segments always do.
KEY_ROWS, CHAIN = 4_000, 3
#: Words in more than one of 2**TOP_BITS texts are counted (at most 2**TOP_BITS times the words of a mean text); others
#: are taken to carry TOP_BITS bits. Bits are whole numbers of 1/16, so that sums are the same in any order.
TOP_BITS, UNIT = 10, 16
#: Rows of one index key from which they are dealt to pairs of blocks; one node in PROBE is looked at to find such keys.
BLOCK, PROBE = 1 << 14, 32
_POP = np.bitwise_count
_U = np.uint64


_known: dict[str, int] = {}


def _word_hash(word: str) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(word)
    if len(_known) < 500_000:
        _known[word] = h
    return h


def _word_sets(batches, least: int):
    for b in batches:
        ids, sets = [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i is None or not t:
                continue
            w = set(words(t))
            if len(w) >= least:
                ids.append(i), sets.append(w)
        if not ids:
            continue
        n = np.array([len(w) for w in sets])
        flat = np.array([_known.get(x) or _word_hash(x) for w in sets for x in w], np.uint64).view(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        flat = flat[np.lexsort((flat, owner))]
        starts = np.concatenate([[0], np.cumsum(n)])
        with np.errstate(over="ignore"):
            s1, s2 = (np.add.reduceat(mix(flat, k), starts[:-1]).view(np.int64) for k in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat)), pa.array(s1), pa.array(s2)], names=["id", "n", "tokens", "s1", "s2"])


def budget(total, share: float):
    """The most words in which two sets of ``total`` words together may differ: |A xor B| at Jaccard >= share."""
    return np.floor(total * (1 - 2 * share / (1 + share)) + 1e-9).astype(np.int64)


def rings(least: int, largest: int, share: float) -> list[tuple[int, int, int]]:
    """(lowest, highest joint size, segments) of each index: joint sizes in steps that grow by 1/share."""
    out, lo = [], 2 * least
    while lo <= 2 * largest:
        hi = max(lo, int(lo / share))
        out.append((lo, hi, int(budget(np.array(hi), share)) + 1))
        lo = hi + 1
    return out


def _places(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word's place on the ring, as a fraction of 2**32, and its arc of 64."""
    place = (word & _U(0xFFFFFFFF)).astype(np.int64)
    return place, place >> 26


def _segments(place: np.ndarray, m: int) -> np.ndarray:
    """Segment of each word: whole arcs where there are no more segments than arcs, else a part of one."""
    return (place >> 26) * m >> 6 if m <= 64 else place * m >> 32


def _starts(rows: np.ndarray, segments: np.ndarray, n: int, m: int) -> np.ndarray:
    """Where the words of each (row, segment) start, in words sorted by them; one more entry for the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(rows * m + segments, minlength=n * m))])


def _without(first: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """All choices of ``size`` of the words first..first+count-1 of each row: the row, and the chosen words."""
    row, chosen, free = np.arange(len(first)), [], first.copy()
    for _ in range(size):
        n = np.maximum(first[row] + count[row] - free, 0)
        at = np.repeat(np.arange(len(row)), n)
        word = free[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        row, chosen, free = row[at], [c[at] for c in chosen] + [word], word + 1
    return row, chosen


def _chain_keys(word, weight, row, segment, n: int, m: int, salt: int, need: int):
    """(key, row, start, levels, removed): the index keys of each row's chains.

    A chain starts at each segment. Its first l segments may differ in l - 1 words between two sets that share a key,
    so each further segment comes whole and with up to as many words removed as are left of that: what two sets have
    in common is a key of both, if the words that they removed together are no more. The chain ends once the words of
    the key carry ``need``, which only depends on the words that both have.
    """
    order = np.argsort(row * m + segment, kind="stable")
    word, weight, starts = word[order], weight[order], _starts(row, segment, n, m)
    sums = np.concatenate([[0], np.cumsum(weight)])
    heavy = sums[starts[1:]] - sums[starts[:-1]]
    with np.errstate(over="ignore"):
        mixed = mix(word.view(np.int64), 4)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mixed, dtype=_U)])
        content = total[starts[1:]] - total[starts[:-1]]
        cell = np.arange(n * m)
        r, k = cell // m, cell % m
        key, load, gone = mix((content + mix(k + 4096 * salt, 11)).view(np.int64), 12), heavy, np.zeros(n * m, np.int64)
        for level in range(1, CHAIN + 1):
            done = (load >= need) | (level == min(CHAIN, m))
            yield key[done], r[done], k[done], np.full(int(done.sum()), level), gone[done]
            key, load, gone, r, k = (x[~done] for x in (key, load, gone, r, k))
            if not len(key):
                return
            parts = []
            c = r * m + (k + level) % m
            for less in range(level + 1):
                at = np.flatnonzero(gone + less <= level)
                i, chosen = _without(starts[c[at]], starts[c[at] + 1] - starts[c[at]], less)
                i = at[i]
                rest, light = content[c[i]], heavy[c[i]]
                for w in chosen:
                    rest, light = rest - mixed[w], light - weight[w]
                parts.append((mix((key[i] + mix(rest.view(np.int64), 13 + level)).view(np.int64), 14), load[i] + light, gone[i] + less, r[i], k[i]))
            key, load, gone, r, k = (np.concatenate(x) for x in zip(*parts))


def _index_rows(batches, least: int, largest: int, share: float, common: dict[int, int], need: int, hot: dict[int, int]):
    """Rows (key, id, sketch, tag, side) under which a set is found; tag packs its size, ring, segment, levels and words removed."""
    names = np.array(sorted(common), np.int64)
    bits = np.array([common[int(x)] for x in names], np.int64)
    specs = rings(least, largest, share)
    for b in batches:
        if not b.num_rows:
            continue
        ids, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
        tokens = b.column(2).flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(ids)), n)
        mixed = mix(tokens, 9)
        place, arc = _places(mixed)
        sketch = np.zeros(len(ids), _U)
        np.bitwise_or.at(sketch, owner, _U(1) << arc.astype(_U))
        at = np.minimum(np.searchsorted(names, tokens), max(len(names) - 1, 0))
        info = np.where(names[at] == tokens, bits[at], TOP_BITS * UNIT) if len(names) else np.full(len(tokens), TOP_BITS * UNIT)
        for ring, (lo, hi, m) in enumerate(specs):
            use = (np.ceil(n * share) + n <= hi) & (np.floor(n / share) + n >= lo)
            if not use.any():
                continue
            rows = np.flatnonzero(use)
            local = np.full(len(ids), -1)
            local[rows] = np.arange(len(rows))
            mine = use[owner]
            for key, i, k, level, gone in _chain_keys(mixed[mine], info[mine], local[owner[mine]], _segments(place[mine], m), len(rows), m, ring, need):
                i = rows[i]
                key, at, side = deal(key.view(np.int64), np.arange(len(key)), ids[i], hot)
                i, tag = i[at], ((n[i] << 40) | (ring << 32) | (k << 8) | (level << 4) | gone)[at]
                yield batch_of(key=key, id=ids[i], sketch=sketch[i].view(np.int64), tag=tag, side=side.astype(np.int8))


@functools.lru_cache(maxsize=64)
def _chains(m: int) -> tuple[np.ndarray, np.ndarray]:
    """(masks, lengths), a row for each start of a chain: the arcs that lie wholly within chains of these lengths."""
    if m <= 64:
        arcs = np.arange(64) * m >> 6
        of = [sum(1 << int(p) for p in np.flatnonzero(arcs == s)) for s in range(m)]
        masks = [list(accumulate((of[(s + j) % m] for j in range(m)), int.__or__)) for s in range(m)]
        return np.array(masks, _U), np.tile(np.arange(1, m + 1), (m, 1))
    masks, lengths = [], []
    for s in range(m):
        first = -(-64 * s // m)  # the first arc that begins in the chain
        ends = [-(-(first + j) * m // 64) - s for j in range(1, 64)]
        ways = list(accumulate((1 << ((first + j) % 64) for j in range(63)), int.__or__))
        last = max(j for j in range(63) if ends[j] <= m)
        masks.append([ways[min(j, last)] for j in range(63)]), lengths.append([ends[min(j, last)] for j in range(63)])
    return np.array(masks, _U), np.array(lengths)


def _candidates(batches, least: int, largest: int, share: float):
    widest = np.array([m - 1 for _, _, m in rings(least, largest, share)])
    for table in whole_groups(batches):
        table = table.combine_chunks()
        key, ident, sketch, tag, side = (table.column(c).to_numpy() for c in range(5))
        sketch, n, ring, start, level, gone = sketch.view(_U), tag >> 40, tag >> 32 & 255, tag >> 8 & 0xFFFFFF, tag >> 4 & 15, tag & 15
        bound = np.minimum(widest[ring], 64).astype(np.uint8)

        def close():
            for i, j in pairs_within(runs(key)):
                ok = np.flatnonzero(_POP(sketch[i] ^ sketch[j]) <= bound[i])  # the cheapest test first: most pairs end here
                i, j = i[ok], j[ok]
                a, b = n[i], n[j]
                ok = (np.minimum(a, b) >= share * np.maximum(a, b) - 1e-9) & (ident[i] != ident[j]) & ((tag[i] ^ tag[j]) >> 4 & 0xFFFFFFFFF == 0) & (gone[i] + gone[j] < level[i]) & ((side[i] < 0) | (side[i] != side[j]))
                i, j, most = i[ok], j[ok], budget((a + b)[ok], share)
                apart = sketch[i] ^ sketch[j]
                ok = _POP(apart) <= most  # no more bits than words can differ
                i, j, most, apart = i[ok], j[ok], most[ok], apart[ok]
                keep = np.ones(len(i), bool)
                for r in np.unique(ring[i]):  # the chain that the key began keeps to its budgets
                    x, m = np.flatnonzero(ring[i] == r), int(widest[r]) + 1
                    masks, lengths = _chains(m)
                    for step in range(masks.shape[1]):
                        s = start[i[x]]
                        x = x[_POP(apart[x] & masks[s, step]) <= lengths[s, step] * most[x] // m]
                    keep[ring[i] == r] = False
                    keep[x] = True
                yield np.stack([np.minimum(ident[i], ident[j])[keep], np.maximum(ident[i], ident[j])[keep]], axis=1)

        for p in collected(close()):
            yield batch_of(a=p[:, 0], b=p[:, 1])


class NearTexts:
    """Groups of texts that share at least ``share`` of their distinct words (Jaccard), joined directly or through others.

    Sets of words are points, their distance is the number of words that only one has. Two sets of a and b words that
    share enough differ by at most tau(a + b) words. For each range of joint sizes the words are dealt to m = tau + 1
    segments of a ring: by the pigeonring principle some segment starts a chain in which every prefix of l segments
    differs by at most l * tau / m words, that is by at most l - 1. The first segment is equal; its words are the index key
    if they are rare enough for a key of about KEY_ROWS rows, else the key goes on with the next one or two segments and
    comes with up to as many words removed as may differ there (``_chain_keys``). The chain is tested on a 64-bit
    sketch whose bits never differ more than the words do, at every size of the ring; pairs that pass are held
    against the whole sketch, then against the word sets themselves. No link is lost. Keys that have many rows all the same are
    dealt to pairs of blocks: the 10,000 largest, so that any other has at most one in 10,000 index rows.

    Null ids, null or blank texts and texts of fewer than ``least`` distinct words take no part. Texts of equal word
    sets are one node. An id that occurs twice with different texts is linked by either.
    """

    def __init__(self, table: DataFrame, key: str, text: str, share: float = 0.8, least: int = 1, block: int = BLOCK):
        self.share, self.least, self.block = share, least, block
        sets = table.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(lambda it: _word_sets(it, least), "id long, n int, tokens array<long>, s1 long, s2 long")
        self.sets = materialize(sets, "wordsets")

    def links(self) -> DataFrame:
        """(a, b): pairs of different word sets (by their least ids) whose similarity reaches the share."""
        share, least = self.share, self.least
        stats = self.sets.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(1))).first()
        rows, largest = int(stats[0]), int(stats[1])
        counts = self.sets.select(F.explode("tokens").alias("w")).groupBy("w").count().where(F.col("count") >= rows / 2**TOP_BITS)
        common = {int(w): int(-UNIT * math.log2(min(1.0, c / rows))) for w, c in counts.collect()} if rows else {}
        need = int(UNIT * max(0.0, math.log2(max(rows, 1) / KEY_ROWS)))
        schema = "key long, id long, sketch long, tag long, side byte"
        nodes, block = self._nodes(), self.block
        probe = nodes.where(F.pmod(F.xxhash64("id"), F.lit(PROBE)) == 0).mapInArrow(lambda it: _index_rows(it, least, largest, share, common, need, {}), schema)
        hot = hot_blocks(probe, PROBE, block)
        index = nodes.mapInArrow(lambda it: _index_rows(it, least, largest, share, common, need, hot), schema)
        pairs = spread(index, probe.count() * PROBE).sortWithinPartitions("key").mapInArrow(lambda it: _candidates(it, least, largest, share), "a long, b long").distinct()
        t = self.sets.select("id", "tokens")
        both = pairs.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b")
        shared = F.size(F.array_intersect("ta", "tb"))
        return both.where(shared >= F.lit(share) * (F.size("ta") + F.size("tb") - shared) - F.lit(1e-9)).select("a", "b").distinct()

    def _nodes(self) -> DataFrame:
        return self.sets.join(self._copies().where("id != rep").select("id"), "id", "left_anti").select("id", "n", "tokens")

    def _copies(self) -> DataFrame:
        """(id, rep): texts of equal word sets, and the least id among them."""
        first = self.sets.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
        return lookup_join(self.sets.select("s1", "s2", "n", "id"), first, ["s1", "s2", "n"], "inner").select("id", "rep")

    def groups(self) -> DataFrame:
        """(id, component, n_links) of every text that is in a group of two or more: the least id of the group, and the
        number of other texts that it is linked to itself - by its word set, and one for each copy of that."""
        links, copies = materialize(self.links(), "links"), materialize(self._copies(), "copies")
        edges = links.toDF("x", "y").union(copies.where("id != rep"))
        found = connected_components(edges, "x", "y").select(F.col("node").alias("id"), "component")
        # a text's links are those of its set: to the copies of each linked set, and to the other copies of its own
        size = copies.groupBy(F.col("rep").alias("set")).agg(F.count("*").alias("n"))
        ends = links.toDF("set", "other").union(links.select("b", "a"))
        linked = ends.join(size.toDF("other", "n_other"), "other", "left").groupBy("set").agg(F.sum(F.coalesce("n_other", F.lit(1))).alias("n_linked"))
        rows = found.join(copies.withColumnRenamed("rep", "set"), "id", "left").withColumn("set", F.coalesce("set", "id"))
        rows = lookup_join(materialize(rows, "groups"), size.join(linked, "set", "full"), ["set"], "left")
        return rows.select("id", "component", (F.coalesce("n_linked", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links"))

    def pairs(self) -> DataFrame:
        """(a, b), a < b: all pairs of texts of one group. A large group is dealt to pairs of blocks of its texts."""
        links = self.links().toDF("x", "y").union(self._copies().where("id != rep"))
        g = materialize(connected_components(links, "x", "y").toDF("id", "c"), "groups")
        g = lookup_join(g, g.groupBy("c").agg(F.ceil(F.count("*") / self.block).cast("int").alias("blocks")), ["c"], "inner")
        g = g.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        left = g.select(F.col("id").alias("a"), "c", F.col("mine").alias("p"), F.explode(F.expr("sequence(mine, blocks - 1)")).alias("q"))
        right = g.select(F.col("id").alias("b"), "c", F.col("mine").alias("q"), F.explode(F.expr("sequence(0, mine)")).alias("p"))
        met = left.join(right, ["c", "p", "q"]).where("p < q or a < b")
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
