"""The text and vector operators against brute force, on small tables with everything that may be wrong with rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engrava.llm.clusters import LINK, LOOSE, MinHashClusters, _band_tokens, _planes, band_rows
from engrava.llm.conversations import Conversations
from engrava.llm.leaks import leaked
from engrava.llm.near import NearTexts, _chains, _segments, budget, rings
from engrava.llm.packing import CAPACITY, Packing, encoder, plan, price, TOKENIZER
from engrava.llm.pii import Finder, Names, PersonalData, permute, permuted, permuted_date, placeholder, redacted, restored, with_dates
from engrava.llm.similar import GROUP, LOAD, SimilarVectors, index_plan
from engrava.llm.spans import SharedSpans
from engrava.operators.components import connected_components

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(3, 9))) for _ in range(300)]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


# ---- near-duplicate texts


def near_truth(rows, share, least):
    sets = {i: frozenset(re.findall(r"[^\W_]+", t.lower())) for i, t in rows if i is not None and t}
    ids = sorted(i for i, s in sets.items() if len(s) >= least)
    group = {i: i for i in ids}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) - 1e-9:
                group[max(find(a), find(b))] = min(find(a), find(b))
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if find(a) == find(b)}


def near_rows():
    rows, i = [], 0
    for _ in range(60):
        words = sentence(RNG.randint(6, 60)).split()
        for _ in range(RNG.randint(1, 4)):
            edited = [w if RNG.random() > 0.08 else RNG.choice(VOCABULARY) for w in words]
            RNG.shuffle(edited)
            i += 1
            rows.append((i, " ".join(edited)))
    rows += [(900, None), (901, ""), (902, "  "), (None, sentence(20)), (903, sentence(4000)), (904, rows[0][1].upper()), (905, rows[0][1] + "!"), (906, "one two")]
    return rows


@pytest.mark.parametrize(("share", "least"), [(0.7, 14), (0.8, 1)])
def test_near_texts_equal_brute_force(spark, share, least):
    rows = near_rows()
    table = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "id long, text string, n long, tokens string").repartition(3)
    got = {tuple(r) for r in NearTexts(table, "id", "text", share, least).pairs().collect()}
    assert got == near_truth(rows, share, least)
    assert {tuple(r) for r in NearTexts(table, "id", "text", share, least, block=8).pairs().collect()} == got  # keys dealt to blocks


@pytest.mark.parametrize("key_rows", [1, 30])
def test_near_texts_with_longer_chains(spark, monkeypatch, key_rows):
    """Keys of up to three segments: few words, all of them common, so that many segments are empty or say little."""
    import engrava.llm.near as near

    monkeypatch.setattr(near, "KEY_ROWS", key_rows)
    rng = random.Random(3)
    rows = []
    for i in range(0, 400, 2):
        w = rng.sample(VOCABULARY[:60], rng.randint(14, 30))
        v = [x for x in w if rng.random() > 0.09] + rng.sample(VOCABULARY[:60], rng.randint(0, 3))
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
    table = spark.createDataFrame(rows, "id long, text string").repartition(3)
    assert {tuple(r) for r in NearTexts(table, "id", "text", 0.7, 10).pairs().collect()} == near_truth(rows, 0.7, 10)


def test_near_groups_count_links(spark):
    a, b, c = "a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h k l"  # b is linked to a and c, these not
    rows = [(1, a), (2, b), (3, c), (4, b + "."), (5, b.upper()), (6, "x y z u v w q r s t"), (7, "m n o")]
    got = {tuple(r) for r in NearTexts(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0.8, 5).groups().collect()}
    assert got == {(1, 1, 3), (2, 1, 4), (3, 1, 3), (4, 1, 4), (5, 1, 4)}


def test_chain_masks_lie_within_their_chains():
    for m in (1, 5, 63, 64, 65, 100, 333):
        masks, lengths = _chains(m)
        place = np.arange(0, 1 << 32, (1 << 32) // 9973)
        segment, arc = _segments(place, m), place >> 26
        for start in {0, 1 % m, m // 2, m - 1}:
            for mask, length in zip(masks[start], lengths[start]):
                inside = (np.uint64(mask) >> arc.astype(np.uint64)) & np.uint64(1) == 1
                assert 1 <= length <= m and ((segment[inside] - start) % m < length).all()


def test_near_texts_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert NearTexts(empty, "id", "text").pairs().count() == 0
    assert NearTexts(spark.createDataFrame([(1, None), (2, "a b c")], "id long, text string"), "id", "text").pairs().count() == 0


def test_budget_and_rings():
    for a in range(14, 60):
        for b in range(14, a + 1):
            least_shared = -(-0.7 * (a + b) // 1.7)
            assert budget(np.array(a + b), 0.7) >= a + b - 2 * least_shared
    for lo, hi, m in rings(14, 60, 0.7):
        assert m == budget(np.array(hi), 0.7) + 1 and lo <= hi


# ---- similar vectors


def test_similar_vectors_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x = np.repeat(base, 6, axis=0) + rng.standard_normal((1800, 64)) * 0.025
    x[7] = x[6] * 3  # equal directions
    rows = [(int(i), v.astype(np.float32).tolist(), "u") for i, v in enumerate(x)]
    rows += [(5000, None, ""), (5001, [0.0] * 64, ""), (5002, [float("nan")] * 64, ""), (5003, [1.0] * 63, ""), (5004, [None] + [1.0] * 63, ""), (None, rows[0][1], "")]
    table = spark.createDataFrame(rows, "id long, v array<float>, u string")
    got = {tuple(r) for r in SimilarVectors(table, "id", "v", k=5, least=0.9).pairs().collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(len(x)) for j in np.argsort(-cos[i], kind="stable")[:5] if cos[i, j] >= 0.9}
    assert len(got & want) / len(want) >= 0.97 and len(got - want) <= 0.01 * len(want)


@pytest.mark.parametrize("rows", [1 << 10, 20_000, 190_000, 50_000_000, 1 << 28, 1 << 34])
def test_index_plan_keeps_buckets_small_at_any_size(rows):
    flip = np.arccos(0.9) / np.pi
    p = index_plan(rows, flip)
    assert rows / 2**p.length <= LOAD and rows / 2**p.prefix <= GROUP and p.meets(flip) >= 0.99
    before = index_plan(rows // 16, flip)
    assert p.tables <= before.tables * 16**0.45  # the index itself grows by well under the square


def test_similar_vectors_recall_by_cosine(spark):
    rng, n = np.random.default_rng(8), 3000
    base = rng.standard_normal((n, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((n, 64))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = np.linspace(0.9005, 0.98, n)[:, None]
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id long, v array<float>")
    got = {tuple(r) for r in SimilarVectors(table, "id", "v", k=5, least=0.9).pairs().collect()}
    found = np.array([(i, i + n) in got for i in range(n)])
    band = cos[:, 0] < 0.92
    assert found[band].mean() >= 0.97 and found[~band].mean() >= 0.99


def test_dealt_keys_lose_no_pair(spark, monkeypatch):
    import engrava.llm.similar as similar

    rng = np.random.default_rng(9)
    x = rng.standard_normal(64) + rng.standard_normal((700, 64)) * 0.2  # nearly all meet everywhere
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id long, v array<float>")
    whole = {tuple(r) for r in SimilarVectors(table, "id", "v").pairs().collect()}
    monkeypatch.setattr(similar, "PROBE", 1)
    assert {tuple(r) for r in SimilarVectors(table, "id", "v", block=60).pairs().collect()} == whole


def test_many_equal_vectors_are_not_all_pairs(spark):
    v = np.random.default_rng(1).standard_normal(64).astype(np.float32).tolist()
    table = spark.createDataFrame([(i, v) for i in range(400)], "id long, v array<float>")
    got = {tuple(r) for r in SimilarVectors(table, "id", "v", k=5).pairs().collect()}
    want = {(min(i, j), max(i, j)) for i in range(400) for j in [x for x in range(6) if x != i][:5]}
    assert got == want
    assert SimilarVectors(table.limit(0), "id", "v").pairs().count() == 0


# ---- clusters


def test_clusters_find_planted_directions(spark):
    rng = np.random.default_rng(2)
    centres = np.linalg.qr(rng.standard_normal((64, 6)))[0].T
    label = rng.choice(6, 1500, p=[0.35, 0.25, 0.15, 0.1, 0.1, 0.05])
    noise = rng.standard_normal((1500, 64))
    x = centres[label] * 0.73 + noise / np.linalg.norm(noise, axis=1, keepdims=True) * 0.68
    rows = [(i, v.astype(np.float32).tolist(), "c") for i, v in enumerate(x)] + [(9000, None, "c"), (9001, [0.0] * 64, None), (9002, [1.0], "c")]
    c = MinHashClusters(spark.createDataFrame(rows, "id long, v array<float>, cluster_name string"), "id", "v", 6, extra=["cluster_name"])
    got = {r.id: r.cluster for r in c.assigned().collect()}
    by = {}
    for i, k in got.items():
        by.setdefault(k, []).append(label[i])
    assert len(by) == 6 and all(len(set(v)) == 1 for v in by.values()) and len(got) == 1500
    d = {r.cluster: r for r in c.described(3).collect()}
    assert sum(r.n_members for r in d.values()) == 1500 and all(len(r.typical) == 3 for r in d.values())


@pytest.mark.parametrize("block", [4000, 40])
def test_cluster_links_are_all_pairs_of_a_bucket_that_are_similar(spark, monkeypatch, block):
    import engrava.llm.clusters as clusters

    monkeypatch.setattr(clusters, "PROBE", 1)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((5, 64))[rng.integers(0, 5, 600)] + rng.standard_normal((600, 64)) * 0.45
    x = x.astype(np.float32).astype(float)
    bits = x / np.linalg.norm(x, axis=1, keepdims=True) @ _planes(64, 17) >= 0
    keys = _band_tokens(bits, 18, band_rows(600))
    meet = (keys[:, None, :] == keys[None, :, :]).any(axis=2)
    shared = (bits[:, None, :] == bits[None, :, :]).sum(axis=2)
    a, b = np.nonzero(np.triu(meet & (shared / (512 - shared) >= LINK), 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {tuple(r) for r in MinHashClusters(table, "id", "v", 5, block=block).links().collect()}
    assert got == set(zip(a.tolist(), b.tolist())) and len(got) > 5_000


@pytest.mark.parametrize("fewest", [4096, 150])
def test_cluster_links_are_all_pairs_that_are_similar(spark, monkeypatch, fewest):
    """Pairs about LINK, some of which share no bucket; opposite vectors differ in all 256 bits."""
    import engrava.llm.clusters as clusters

    monkeypatch.setattr(clusters, "FEWEST", fewest)
    rng = np.random.default_rng(8)
    one, other = rng.standard_normal((2, 700, 64))
    other -= one * ((other * one).sum(axis=1) / (one * one).sum(axis=1))[:, None]
    one, other = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (one, other))
    crowd = rng.standard_normal(64) + rng.standard_normal((120, 64)) * 0.6
    x = np.concatenate([one, one * np.cos(0.72) + other * np.sin(0.72), crowd, -crowd[:20]]).astype(np.float32).astype(float)
    bits = x / np.linalg.norm(x, axis=1, keepdims=True) @ _planes(64, 17) >= 0
    shared = (bits[:, None, :] == bits[None, :, :]).sum(axis=2)
    similar = np.triu(shared / (512 - shared) >= LINK, 1)
    want = set(zip(*(z.tolist() for z in np.nonzero(similar)), strict=True))
    keys = _band_tokens(bits, 18, band_rows(len(x)))
    assert len(want) > 500 and not (keys[:, None, :] == keys[None, :, :]).any(axis=2)[similar].all()
    c = MinHashClusters(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", 5)
    assert {r.id for r in c.groups().select("id").collect()} == {i for pair in want for i in pair}
    assert [tuple(r) for r in c.links_whole().orderBy("a", "b").collect()] == sorted(want)
    degree = (similar | similar.T).sum(axis=1)
    got = c._compared(c.codes, clusters._stars, "id long, root long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    assert {r.id: r.n for r in got} == {i: n for i, n in enumerate(degree.tolist()) if n}
    nodes = c.codes.join(spark.createDataFrame(list(enumerate(degree.tolist())), "id long, degree long"), "id")
    top = c._compared(nodes, clusters._highest, "id long, of_other long, other long").groupBy("id").agg(F.max(F.struct("of_other", (-F.col("other")).alias("i"))).alias("m")).collect()
    assert {r.id: tuple(r.m) for r in top} == {i: max((degree[j], -j) for j in np.flatnonzero(similar[i] | similar[:, i]).tolist()) for i in range(len(x)) if degree[i]}


@pytest.mark.parametrize("cut", [0, 1700])
@pytest.mark.parametrize("kind", ["clusters", "none", "equal", "opposite"])
def test_close_codes_are_all_found_while_far_groups_are_passed_over(monkeypatch, kind, cut):
    """Codes of a cluster differ in a quarter of their bits; pairs at, just within and just beyond MOST are planted across clusters."""
    import engrava.llm.clusters as clusters

    rng = np.random.default_rng(13)
    n, most = 3400, clusters.MOST
    heart = rng.random((1 if kind == "equal" else 12, 256)) < 0.5
    label = rng.integers(0, len(heart), n)
    bits = heart[label] ^ (rng.random((n, 256)) < {"clusters": 0.15, "none": 0.5, "equal": 0, "opposite": 0.02}[kind])
    if kind == "opposite":
        bits[::2] = ~bits[1::2]
    if kind in ("clusters", "none"):
        for i, apart in enumerate([0, most - 1, most, most + 1] * 100):
            bits[3000 + i] = bits[i] ^ (rng.permutation(256) < apart)
    word = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    sign = bits.astype(np.float32) * 2 - 1
    near = np.triu((256 - sign @ sign.T) / 2 <= most, 1)
    if cut:
        near[cut:], near[:, :cut] = False, False
    counted, count = [0], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x, *a, **k: (counted.__setitem__(0, counted[0] + x.size), count(x, *a, **k))[1])
    found = [np.minimum(a, b) * n + np.maximum(a, b) for a, b in clusters._hits([np.ascontiguousarray(word[:, w]) for w in range(4)], cut)]
    assert np.array_equal(np.sort(np.concatenate(found)), np.flatnonzero(near)) and near.sum() > 100
    if kind == "clusters":  # words looked at, of 4 a pair
        assert counted[0] < 0.5 * 4 * (cut * (n - cut) if cut else n * (n - 1) // 2)


def test_loose_components_are_split_around_medoids(spark):
    """A bridge of vectors turned step by step from one direction to another joins two clusters to one component."""
    rng = np.random.default_rng(6)
    axes = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    turn = np.linspace(0, np.radians(150), 25)[:, None]
    bridge = np.cos(turn) * axes[0] + np.sin(turn) * axes[1]
    ends = np.concatenate([bridge[i] + rng.standard_normal((150, 64)) * 0.05 for i in (0, -1)])
    x = np.concatenate([ends, bridge])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id long, v array<float>")
    c = MinHashClusters(table, "id", "v", 2)
    assert len({r.component for r in connected_components(c.links(), "a", "b").collect()}) == 1
    group = {r.id: r.grp for r in c.groups().collect()}
    assert len({group[i] for i in range(150)} & {group[i] for i in range(150, 300)}) == 0
    assert len(MinHashClusters(table, "id", "v", 2).directions()) == 2
    assert len(MinHashClusters(table, "id", "v", 9).directions()) == 2  # no more than there are


def test_groups_are_those_of_all_links(spark):
    """An arc that grows denser towards one end: its ids climb there, are too far from it, and are split again."""
    rng = np.random.default_rng(9)
    axes = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    turn = np.radians(170 * np.sqrt(rng.random(260)))[:, None]
    x = (np.cos(turn) * axes[0] + np.sin(turn) * axes[1] + rng.standard_normal((260, 64)) * 0.04).astype(np.float32).astype(float)
    bits = x / np.linalg.norm(x, axis=1, keepdims=True) @ _planes(64, 17) >= 0
    shared = (bits[:, None, :] == bits[None, :, :]).sum(axis=2)
    near = shared / (512 - shared)
    linked = (near >= LINK) & ~np.eye(len(x), dtype=bool)
    want, todo, rounds = {}, list(range(len(x))), 0
    while todo:
        rounds += 1
        degree = {i: (linked[i, todo].sum(), -i) for i in todo}
        up = {i: max([degree[j] for j in todo if linked[i, j]] + [degree[i]])[1] * -1 for i in todo}
        for _ in todo:
            up = {i: up[up[i]] for i in todo}
        want |= {i: up[i] for i in todo if near[i, up[i]] >= LOOSE}
        todo = [i for i in todo if near[i, up[i]] < LOOSE]
    c = MinHashClusters(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", 2)
    assert len({r.component for r in connected_components(c.links_whole(), "a", "b").collect()}) == 1 and rounds > 1
    assert {r.id: r.grp for r in c.groups().collect()} == want


def test_clusters_of_an_empty_table(spark):
    c = MinHashClusters(spark.createDataFrame([], "id long, v array<float>"), "id", "v", 3)
    assert c.assigned().count() == 0


# ---- conversations


def test_conversations(spark):
    t = lambda s: f"2025-01-01 00:00:{s:02d}"
    rows, n = [], 0

    def add(session, ts, who, spoken=True, uses=(), answers=()):
        nonlocal n
        n += 1
        rows.append((session, n, ts, who, spoken, list(uses), list(answers)))

    add("good", t(3), "assistant", answers=["x"])
    add("good", t(1), "user", uses=["x"])
    add("good", t(2), "system")
    add("no-reply", t(1), "user"), add("no-reply", t(2), "assistant"), add("no-reply", t(3), "user")
    add("one-sided", t(1), "assistant")
    add("untimed", None, "user"), add("untimed", t(2), "assistant")
    add("stranger", t(1), "user"), add("stranger", t(2), "tool"), add("stranger", t(3), "assistant")
    add("early-answer", t(1), "user"), add("early-answer", t(2), "assistant", answers=["q"]), add("early-answer", t(3), "assistant", uses=["q"])
    add("silent", t(1), "user", False), add("silent", t(2), "assistant", False)
    add(None, t(1), "user"), add(" ", t(1), "user")
    add("null-tool", t(1), "user"), add("null-tool", t(2), "assistant", answers=[None])
    for i in range(3000):  # a session of many turns, over several ranges
        add("long", f"2025-02-01 {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}", "user" if i % 2 == 0 else "assistant")
    df = spark.createDataFrame(rows, "session string, row long, ts string, speaker string, spoken boolean, uses array<string>, answers array<string>").withColumn("ts", F.to_timestamp("ts")).repartition(5)
    c = Conversations(df)
    faults = {}
    for r in c.faults().collect():
        faults.setdefault(r.session, set()).add(r.fault)
    assert set(faults) == {"no-reply", "one-sided", "untimed", "stranger", "early-answer", "silent", "null-tool"}
    assert faults["no-reply"] == {"unanswered"} and faults["early-answer"] == {"tools"} and faults["silent"] == {"one-sided"}
    turns = c.turns().collect()
    assert sorted(r.turn for r in turns if r.session == "long") == list(range(1, 3001))
    assert [r.row for r in sorted((r for r in turns if r.session == "good"), key=lambda r: r.turn)] == [2, 3, 1]
    assert Conversations(df.limit(0)).faults().count() == 0 and Conversations(df.limit(0)).turns().count() == 0


@pytest.mark.parametrize("partitions", [1, 40])
def test_unknown_speakers_are_inferred_where_alternation_decides(spark, partitions):
    rng, rows, want = random.Random(2), [], {}
    for s in range(30):
        who = [rng.choice(["user", "assistant", "user", "assistant", "tool", None, "system"]) for _ in range(rng.randint(3, 40))]
        spoken = [w != "system" and rng.random() < 0.9 for w in who]
        heard = [w if p and w in ("user", "assistant") else None for w, p in zip(who, spoken)]
        for i, (w, p) in enumerate(zip(who, spoken)):
            rows.append((f"s{s}", len(rows), f"2025-01-01 00:{i:02d}:00", w, p, [], []))
            before, after = next((x for x in reversed(heard[:i]) if x), None), next((x for x in heard[i + 1 :] if x), None)
            if p and w in ("tool", None) and before and before == after:
                want[rows[-1][1]] = "user" if before == "assistant" else "assistant"
    df = spark.createDataFrame(rows, "session string, row long, ts string, speaker string, spoken boolean, uses array<string>, answers array<string>").withColumn("ts", F.to_timestamp("ts"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.row: r.speaker for r in Conversations(df).inferred().collect()} == want and want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_sessions_are_split_where_they_rest(spark):
    minute = [i + (600 if i >= 700 else 0) for i in range(1000)]
    rows = [("a", i, f"2025-01-{1 + m // 1440:02d} {m // 60 % 24:02d}:{m % 60:02d}:00", "user" if i % 2 == 0 else "assistant", True, [], []) for i, m in enumerate(minute)]
    df = spark.createDataFrame(rows, "session string, row long, ts string, speaker string, spoken boolean, uses array<string>, answers array<string>").withColumn("ts", F.to_timestamp("ts")).repartition(6)
    turns = sorted((r.turn, r.part, r.row) for r in Conversations(df).turns().collect())
    assert turns == [(i + 1, 1 if i < 700 else 2, i) for i in range(1000)]


# ---- packing


def test_packing_is_whole_and_tight(spark):
    texts = [sentence(RNG.randint(1, 900)) for _ in range(400)] + [sentence(4000), "", None, " ", "x", "x"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, text string, n long").repartition(4)
    rows = Packing(df, "id", "text", rounds=120).placed().collect()
    e = encoder(TOKENIZER)
    size = {i: len(e.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    for i, n in size.items():
        parts = sorted((r.start, r.n) for r in rows if r.id == i)
        assert sum(k for _, k in parts) == n and [s for s, _ in parts] == list(range(0, max(n, 1), CAPACITY))
        assert len(parts) == 1 or n > CAPACITY
    load: dict = {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.n
    assert max(load.values()) <= CAPACITY and len(load) <= -(-sum(size.values()) // CAPACITY) + 2
    assert Packing(df.limit(0), "id", "text").placed().count() == 0


def test_plan_places_every_item_once():
    histogram = {2048: 3, 1025: 10, 1000: 12, 7: 5, 1: 1}
    used: dict = {}
    for config, n in plan(histogram, 2048, 50):
        assert sum(s * k for s, k in config.items()) <= 2048
        for s, k in config.items():
            used[s] = used.get(s, 0) + n * k
    assert used == histogram and plan({}, 10) == []
    assert price(np.array([1.0, 2.1]), np.array([3, 6]), 12)[0] == {6: 2}


def test_the_program_packs_what_filling_from_the_largest_down_does_not():
    histogram = {5: 600, 4: 600, 3: 600}  # 5 + 4 + 3 fills a container; largest first takes 5 + 5
    count = lambda rounds: sum(n for _, n in plan(histogram, 12, rounds))
    assert count(0) == 650 and count(200) <= 606


# ---- leaks


def test_leaks_with_offsets(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    docs = [(1, f"... ALPHA, beta_gamma; delta\nepsilon zeta eta theta iota kappa lambda mu nu!! tail", "k"), (2, passage.replace("zeta", "zet"), "k"), (3, None, "k"), (4, "", "k"), (5, "İ " * 9 + passage, "k"), (6, "x " * 200_000 + passage, "k"), (6, "x " * 200_000 + passage, "k")]
    d = spark.createDataFrame(docs, "doc long, text string, key string")
    p = spark.createDataFrame([(10, passage), (11, "too short"), (12, None), (13, passage)], "cue long, gold string")
    got = sorted(tuple(r) for r in leaked(d, "doc", "text", p, "cue", "gold").collect())
    assert got == [(1, 10), (1, 13), (5, 10), (5, 13), (6, 10), (6, 10), (6, 13), (6, 13)]
    spans = {(r.doc, r.start_at, r.end_at) for r in leaked(d, "doc", "text", p, "cue", "gold", spans=True).collect()}
    text = dict((i, t) for i, t, _ in docs)
    assert {(i, text[i][a:b].split()[0].strip(",").lower(), text[i][a:b].split()[-1].lower()) for i, a, b in spans} == {(1, "alpha", "nu"), (5, "alpha", "omicron"), (6, "alpha", "omicron")}
    assert sorted(tuple(r) for r in leaked(d, "doc", "text", p, "cue", "gold", most=1).distinct().collect()) == sorted(set(got))  # several automata
    assert leaked(d.limit(0), "doc", "text", p, "cue", "gold").count() == 0 and leaked(d, "doc", "text", p.limit(0), "cue", "gold").count() == 0


# ---- shared spans


def span_rows():
    a, b = sentence(120), sentence(90)
    rows = [(i, sentence(RNG.randint(5, 150))) for i in range(60)]
    rows += [(100, sentence(9) + a + sentence(30)), (101, sentence(50) + a), (102, a), (103, a), (104, a.upper()), (105, b[:299]), (106, sentence(7) + b[:300]), (107, b + sentence(3)), (108, sentence(3) + b[:299] + "#"), (109, "é" * 700), (110, "é" * 650 + "x"), (111, None), (112, ""), (None, a), (113, "ab" * 20_000)]
    return rows


def span_truth(rows, span):
    windows: dict = {}
    for i, t in rows:
        if i is not None and t:
            for k in range(len(t) - span + 1):
                windows.setdefault(t[k : k + span], set()).add(i)
    return {(x, y) for s in windows.values() for x in s for y in s if x < y}


@pytest.mark.parametrize("block", [2000, 2])
def test_shared_spans_equal_brute_force(spark, block):
    rows = span_rows()
    table = spark.createDataFrame([(i, t, 0, "b") for i, t in rows], "doc long, text string, n int, bucket string").repartition(4)
    s = SharedSpans(table, "doc", "text", block=block)
    want = span_truth(rows, 300)
    assert {tuple(r) for r in s.pairs().collect()} == want
    parts = {r.doc: r for r in s.shared_parts().collect()}
    in_pairs = {x for p in want for x in p}
    assert {d for d, r in parts.items() if r.n_shared > 0} == in_pairs
    text = dict(rows)
    for d, r in parts.items():
        covered = set()
        for k in range(len(text[d]) - 299):
            if any(text[d][k : k + 300] in t for i, t in rows if i is not None and i != d and t):
                covered.update(range(k, k + 300))
        assert r.n_shared == len(covered)


def test_shared_spans_when_hashes_collide(spark, monkeypatch):
    import engrava.llm.spans as spans

    monkeypatch.setattr(spans, "_hashes", lambda window, key: window & np.uint64(7))
    rows = [(d, t) for d, t in span_rows() if d is None or d < 113]
    texts = [(d, t) for d, t in rows if d is not None and t and len(t) >= 300]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(texts)), pa.array([d for d, _ in texts]), pa.array([0] * len(texts), pa.int32()), pa.array([-1] * len(texts), pa.int32()), pa.array([t for _, t in texts])], names=["bucket", "doc", "at", "side", "s"])
    got = {(a, b) for x in spans._compare(iter([batch]), 300, True) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
    assert got == span_truth(rows, 300)


def test_copies_have_a_class(spark):
    t = sentence(100)
    rows = [(i, t) for i in range(4)] + [(9, t + "x"), (10, "x"), (11, "x")]
    got = {tuple(r) for r in SharedSpans(spark.createDataFrame(rows, "doc long, text string"), "doc", "text").classes().collect()}
    assert got == {(i, 0, 4) for i in range(4)}


def test_many_copies_are_a_star(spark):
    t = sentence(100)
    got = {tuple(r) for r in SharedSpans(spark.createDataFrame([(i, t) for i in range(30)], "doc long, text string"), "doc", "text").pairs(expand=10).collect()}
    assert got == {(0, i) for i in range(1, 30)}
    assert SharedSpans(spark.createDataFrame([], "doc long, text string"), "doc", "text").pairs().count() == 0


# ---- personal data

PARTS = [(g + e, "given") for g in ("Mir", "Jun", "Tav", "Ysa") for e in ("ova", "ric", "osk")][:-1] + [(f + e, "family") for f in ("Dal", "Quel", "Brack") for e in ("holt", "stad", "mark")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail Mirova.dal+x@mail.example.com now", [("email", "Mirova.dal+x@mail.example.com")]),
        ("at a.b [at] example (dot) org, or c at example dot net.", [("email", "a.b [at] example (dot) org"), ("email", "c at example dot net")]),
        ("remote git@host.invalid:a/b.git pin x@1.2.3 ping @mirova", []),
        ("Tel +44 20 7946 0912 or (202) 555-0157, 202.555.0185 x853", [("phone", "44 20 7946 0912"), ("phone", "202) 555-0157"), ("phone", "202.555.0185 x853")]),
        ("v4.20.9 192.0.2.84 epoch 1753085442 order 5064-47 hash 646ed228f181ce76f6aa build 2192.17", []),
        ("id XX00 4695 0937 3706 74, QQ115831C, 967-06-4104, 0 00 24 22 472 885, 85414556-Z", [("id_number", "XX00 4695 0937 3706 74"), ("id_number", "QQ115831C"), ("id_number", "967-06-4104"), ("id_number", "0 00 24 22 472 885"), ("id_number", "85414556-Z")]),
        ("at Flat 26, 132 Harrow Rd, Velmouth. and calle Salt 32, 73500 Tarn; PO Box 3889, Ostrand", [("address", "Flat 26, 132 Harrow Rd, Velmouth"), ("address", "calle Salt 32, 73500 Tarn"), ("address", "PO Box 3889, Ostrand")]),
        ("street level merge, lane 57 of the recall", []),
        ("by Mirova T. Dalholt, J. Quelstad, Brackmark, Tavosk; JUNRIC DALSTAD-QUELMARK; Ysaosk Dalholt", [("person", "Mirova T. Dalholt"), ("person", "J. Quelstad"), ("person", "Brackmark, Tavosk"), ("person", "JUNRIC DALSTAD-QUELMARK"), ("person", "Ysaosk Dalholt")]),
        ("Dalholt alone, mirova alone", []),
    ],
)
def test_items_are_found(text, want):
    got = [(k, text[s:e]) for s, e, k in Finder(Names(PARTS)).spans(text)]
    assert got == want


def test_pseudonyms_keep_form_and_links():
    key = b"k"
    assert sorted(permute(i, 37, key) for i in range(37)) == list(range(37))
    a = permuted("967-06-4104", key, "id_number")
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", a) and a != "967-06-4104" and a == permuted("967-06-4104", key, "id_number") and a != permuted("967-06-4104", b"z", "id_number")
    assert re.fullmatch(r"[A-Z]{2}\d{6}[A-Z]", permuted("QQ115831C", key, "id_number"))
    assert placeholder("email", "A@x.org", key) == placeholder("email", "a [at] x (dot) org", key)
    text = "call 202.555.0185 or Mirova Dalholt"
    out = redacted(text, Finder(Names(PARTS)).spans(text), key)
    assert re.fullmatch(r"call <PHONE:\d{3}\.\d{3}\.\d{4}> or <PERSON:[0-9a-f]{8}>", out)


def test_pseudonyms_round_trip_and_keep_check_digits():
    key = b"k"
    letter = lambda n: f"{n:08}-" + "TRWAGMYFPDXBNJZSQVHLCKE"[n % 23]
    account = lambda n: next(x for x in (f"DE{c:02}{n:018}" for c in range(2, 99)) if int(x[4:] + "1314" + x[2:4]) % 97 == 1)
    thirteen = lambda n: f"{n:013}{97 - n % 97:02}"
    for make in (letter, account, thirteen):
        good = [make(n * 7919) for n in range(60)]
        new = [permuted(x, key, "id_number") for x in good]
        assert len(set(new)) == 60 and [permuted(x, key, "id_number", back=True) for x in new] == good
        for x in new:
            n = int("".join(c for c in x if c.isdigit())[: 8 if make is letter else 13]) if make is not account else int(x[4:])
            assert make(n) == x  # valid again
        bad = [x[:-1] + ("0" if x[-1] != "0" else "1") if make is not letter else x[:-1] + ("B" if x[-1] != "B" else "T") for x in good]
        back = [permuted(permuted(x, key, "id_number"), key, "id_number", back=True) for x in bad]
        assert back == bad and not set(map(lambda x: permuted(x, key, "id_number"), bad)) & set(new)
    assert permuted("ab123456c", key, "id_number") == permuted("AB123456C", key, "id_number").lower()
    assert re.fullmatch(r"\d{3}\.\d{3}\.\d{4} ext \d{3}", permuted("202.555.0185 ext 853", key, "phone"))


def test_dates_are_permuted_within_their_form():
    key, text = b"k", "born 1987-02-11, seen 11.02.1987 and 2025/13/01; at 2025-01-05T10:27:39 v1.2024-01-01 or 2024-01-05 10:27"
    out = redacted(text, with_dates(text, []), key)
    a, b = re.fullmatch(r"born <DATE:(\d{4}-\d\d-\d\d)>, seen <DATE:(\d\d\.\d\d\.\d{4})> and 2025/13/01; at 2025-01-05T10:27:39 v1.2024-01-01 or 2024-01-05 10:27", out).groups()
    assert a == "-".join(reversed(b.split("."))) != "1987-02-11" and restored(out, key) == text
    days = [f"{y}-{m:02}-28" for y in range(1900, 2100) for m in range(1, 13)]
    assert len({permuted_date(d, key) for d in days}) == len(days) and all(permuted_date(permuted_date(d, key), key, True) == d for d in days[:50])
    assert permuted_date("2023-02-30", key) == "2023-02-30"


def test_personal_data_over_tables(spark):
    names = spark.createDataFrame([*PARTS, (None, "given"), ("X", None)], "part string, kind string")
    p = PersonalData(names, "part", "kind")
    t = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x " * 100_000 + "Mirova Dalholt", "a"), (3, "Mirova Dalholt", None)], "kind long, text string, start_at string")
    got = [tuple(r) for r in p.found(t.withColumnRenamed("kind", "id"), ["id"], "text").collect()]
    assert sorted(got) == [(3, "person", 0, 14), (3, "person", 200_000, 200_014)]
    red = {(r.id, r.n_items) for r in p.redacted(t.withColumnRenamed("kind", "id"), ["id"], "text", b"k").collect()}
    assert red == {(1, 0), (2, 0), (3, 1)}
    assert p.found(t.limit(0).withColumnRenamed("kind", "id"), ["id"], "text").count() == 0
