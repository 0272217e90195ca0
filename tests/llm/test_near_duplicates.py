"""Problem 1 against brute force: random families, hot families, hot copies, edges."""

import random
import re

from pyspark.sql import functions as F

from tidelog.llm import near_duplicates as nd

SCHEMA = "entry_id bigint, message string"


def brute(rows, threshold=0.7, least=20):
    sets = {}
    for i, t in rows:
        w = frozenset(re.findall("[a-z0-9]+", t.lower())) if t is not None and i is not None else ()
        if len(w) >= least:
            sets[i] = w
    ids = sorted(sets)
    out = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both * 1000 >= round(threshold * 1000) * (len(sets[a]) + len(sets[b]) - both):
                out.add((a, b))
    return out


def found(spark, rows, least=20):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kind", F.lit("x")).withColumn("words", F.lit(1))
    texts = nd.long_texts(df, "entry", "entry_id", "message", least)
    out = [(r.id_a, r.id_b) for r in nd.similar_pairs(texts).collect()]
    assert len(out) == len(set(out))
    return set(out), texts


def words(rng, n, base="w", vocabulary=5000):
    return [f"{base}{rng.randrange(vocabulary)}" for _ in range(n)]


def test_families_and_edges(spark):
    rng = random.Random(1)
    common = [f"the{i}" for i in range(15)]
    rows, i = [], 0
    for _ in range(60):
        base = words(rng, 25) + common
        for _ in range(rng.randint(1, 4)):
            text = [w if rng.random() > 0.12 else f"n{rng.randrange(9**9)}" for w in base]
            rng.shuffle(text)
            rows.append((i, " ".join(text)))
            i += 1
    rows += [(i, rows[0][1]), (i + 1, rows[0][1].upper()), (i + 2, None), (i + 3, ""), (i + 4, "short text"), (None, rows[0][1])]
    rows += [(i + 5, "é " * 200), (i + 6, " ".join(words(rng, 30_000, "long", 10**6)))]
    got, texts = found(spark, rows)
    assert got == brute(rows) and len(got) > 40
    groups = nd.similar_groups(texts).collect()
    links = {r.id: r.n_links for r in groups}
    degree = {}
    for a, b in got:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    assert links == {k: degree.get(k, 0) for k in links}
    group = {r.id: r.group_id for r in groups}
    assert all(group[a] == group[b] for a, b in got)
    assert got and nd.similar_pairs(texts.where("false")).count() == 0


def test_hot_family_of_a_third_of_all_texts(spark, monkeypatch):
    """All of its words are frequent, so it goes through the forest of all words, in blocks."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    rng = random.Random(2)
    base = words(rng, 40)
    rows = [(k, " ".join(w if rng.random() > 0.05 else f"n{rng.randrange(9**9)}" for w in base)) for k in range(60)]
    rows += [(100 + k, " ".join(words(rng, 40, "q"))) for k in range(120)]
    got, _ = found(spark, rows)
    assert got == brute(rows)


def test_depths_reach_the_target():
    for share in range(1, 101):
        s = nd.guaranteed(share, 100, 0.7)
        d = nd.depth_for(s)
        assert d == 0 or 1 - (1 - s**d) ** nd.TREES >= nd.TARGET_RECALL
    assert nd.depth_for(0.05) == 0 and nd.depth_for(1.0) == nd.DEEPEST
    assert 0.5 < nd.partner_share(0.7) < 0.56 and nd.partner_share(0.9) < 1
    deeper, levels = nd.filed_levels({0: 5, 2: 100, 3: 1})
    assert not deeper and list(levels[3]) == [2, 3] and list(levels[2]) == [2]
    assert 1 - (1 - 0.7**nd.DEPTH_ALL) ** nd.TREES >= nd.TARGET_RECALL
