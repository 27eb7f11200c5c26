"""Texts into containers of a fixed number of tokens: a configuration program over the length histogram, rounded."""

from __future__ import annotations

import base64
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from engrava.llm.kit import batch_of
from engrava.storage import materialize

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation of the byte-level BPE vocabularies (the usual published pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rounds of the multiplicative weights, their rate, the share of a length's items that a configuration covers in a round,
#: and how much less than the best a configuration may be worth to be used.
ROUNDS, RATE, STEP, SLACK = 200, 0.5, 0.1, 0.02
#: Ranks of equal lengths are counted in independent parts: so many, or more so that a part has about RANKED items.
SALTS, RANKED = 64, 500_000

_encoders: dict = {}


def encoder(path: str):
    """The vocabulary at the path; on an executor that doesn't have it there, the copy that the driver sent."""
    if path not in _encoders:
        import tiktoken
        from pyspark import SparkFiles

        where = path if Path(path).exists() else SparkFiles.get(Path(path).name)

        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in Path(where).read_bytes().splitlines() if line)}
        _encoders[path] = tiktoken.Encoding(re.sub(r"\W", "_", path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _sizes(batches, path: str):
    e = encoder(path)
    for b in batches:
        n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["id", "n"])


def price(value: np.ndarray, sizes: np.ndarray, capacity: int, slack: float = 0.0) -> list[dict[int, int]]:
    """Configurations of greatest value, and those worth up to ``slack`` of it less: an unbounded knapsack over the
    sizes, by dynamic programming. One pass gives the best configuration around each size, the best of all first."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], value[order]
    upto = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            total = best[c - s[:n]] + v[:n]
            i = int(total.argmax())
            if total[i] > best[c]:
                best[c], choice[c] = total[i], i
    last, names = choice.tolist(), s.tolist()
    for c in range(1, capacity + 1):  # where the best of c tokens leaves some free, it is that of fewer
        if last[c] < 0:
            names_at = last[c - 1]
            last[c] = names_at if names_at < -1 else -(c - 1) - 2 if names_at >= 0 else -1
    around = v + best[capacity - s]
    out: dict[tuple, dict[int, int]] = {}
    for i in np.argsort(-around, kind="stable"):
        if around[i] < best[capacity] * (1 - slack) - 1e-12:
            break
        config, c = {names[i]: 1}, capacity - names[i]
        while c > 0 and last[c] != -1:
            if last[c] < -1:
                c = -last[c] - 2
                continue
            size = names[last[c]]
            config[size] = config.get(size, 0) + 1
            c -= size
        out.setdefault(tuple(sorted(config.items())), config)
    return list(out.values())


def configurations(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """A fractional cover of the histogram by configurations, and how often each is used.

    Every length has a weight that falls as its items get covered; each round prices the configurations by these
    weights (the knapsack), uses those that are worth nearly as much as the best, each for a small share of its scarcest
    length, and updates the weights. The result is scaled to the tokens there are.
    """
    if rounds < 1:
        return []
    sizes = np.array(sorted(histogram))
    need = np.array([histogram[int(s)] for s in sizes], float)
    covered, used = np.zeros(len(sizes)), {}
    at = {int(s): i for i, s in enumerate(sizes)}
    for _ in range(rounds):
        level = covered / need
        for config in price(np.exp(-RATE * (level - level.min())) * sizes / capacity, sizes, capacity, SLACK):
            step = STEP * min(need[at[s]] / k for s, k in config.items())
            for s, k in config.items():
                covered[at[s]] += step * k
            key = tuple(sorted(config.items()))
            used[key] = used.get(key, 0.0) + step
    scale = float(sizes @ need) / float(sizes @ covered)
    return [(dict(k), x * scale) for k, x in used.items()]


def plan(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations and how many containers have each; every item of the histogram is placed exactly once.

    The fractional cover is rounded down, never beyond the items there are. What is left is placed by patterns: the
    largest length that is left, filled up by the largest that fit, repeated as long as its items last.
    """
    left = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    out: list[tuple[dict[int, int], int]] = []
    if left:
        for config, x in sorted(configurations(left, capacity, rounds), key=lambda c: -c[1]):
            n = min(int(x), *(left.get(s, 0) // k for s, k in config.items()))
            if n > 0:
                out.append((config, n))
                for s, k in config.items():
                    left[s] -= n * k
    while left := {s: n for s, n in left.items() if n > 0}:
        free, config = capacity, {}
        for s in sorted(left, reverse=True):
            if k := min(left[s], free // s):
                config[s] = k
                free -= s * k
            if not free:
                break
        n = min(left[s] // k for s, k in config.items())
        out.append((config, n))
        for s, k in config.items():
            left[s] -= n * k
    return out


class Packing:
    """Texts of a table in containers of ``capacity`` tokens of a public tokenizer.

    A text longer than a container is cut into full containers and one rest; no other text is split. The histogram of
    lengths has at most ``capacity`` entries and is all that the driver sees; so is the plan bounded, whatever the
    number of texts. Texts get their container from their rank among texts of equal length, counted in salted parts.

    Texts of no token (null or empty) are rows of 0 tokens in container 0. Repeated ids are items of their own. An
    empty table gives no rows. Columns other than the two named are not read.
    """

    def __init__(self, table: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, rounds: int = ROUNDS):
        self.capacity = capacity
        kind = dict(table.dtypes)[key]
        table.sparkSession.sparkContext.addFile(tokenizer)
        sizes = table.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(lambda it: _sizes(it, tokenizer), f"id {kind}, n int")
        parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1))
        items = sizes.select("id", "n", F.explode(parts).alias("part")).select("id", "part", (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).alias("n"))
        self.items = materialize(items, "items")
        self.histogram = {r.n: r["count"] for r in self.items.where("n > 0").groupBy("n").count().collect()}
        self.salts = max(SALTS, -(-max(self.histogram.values(), default=0) // RANKED))
        self.plan = plan(self.histogram, capacity, rounds)

    def placed(self) -> DataFrame:
        """(id, part, start, n, container)."""
        where: dict[int, list] = {}
        at, ranks = 0, {}
        for config, n in self.plan:
            for s, k in config.items():
                where.setdefault(s, []).append((ranks.get(s, 0), at, k))
                ranks[s] = ranks.get(s, 0) + n * k
            at += n
        size, rank, first, each = (np.array(x, np.int64) for x in zip(*[(s, *x) for s in sorted(where) for x in where[s]])) if where else (np.empty(0, np.int64),) * 4
        base = int(max(self.histogram.values(), default=0)) + 1
        starts = size * base + rank

        def containers(batches):
            for b in batches:
                n, r = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy()
                i = np.maximum(np.searchsorted(starts, n * base + r, "right") - 1, 0)
                c = first[i] + (r - rank[i]) // each[i] if len(n) else n
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(c)], names=["id", "part", "start", "n", "container"])

        items = self.items.where("n > 0").withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.lit(self.salts)).cast("int"))
        counts = items.groupBy("n", "salt").agg(F.count("*").alias("c"))
        offsets = counts.select("n", "salt", (F.sum("c").over(W.partitionBy("n").orderBy("salt")) - F.col("c")).alias("before"))  # at most capacity * salts rows
        ranked = items.withColumn("r", F.row_number().over(W.partitionBy("n", "salt").orderBy("id", "part", "start")) - 1).join(F.broadcast(offsets), ["n", "salt"])
        kind = dict(self.items.dtypes)["id"]
        some = ranked.select("id", "part", "start", "n", (F.col("r") + F.col("before")).alias("r")).mapInArrow(containers, f"id {kind}, part int, start int, n int, container long")
        return some.union(self.items.where("n = 0").select("id", "part", "start", "n", F.lit(0).cast("long")))  # not ranked: they may be many
