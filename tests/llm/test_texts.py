"""Problems 8, 9 and 10: token ids, containers, reading bands."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import reading as rd
import numpy as np

from tidelog.llm.packing import _pack, best_fit, fill, hilbert_keys, packed
from tidelog.llm.tokens import SPLIT, VOCABULARY, RankQueue, encoder, token_ids

needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary file")
DOCS = "doc_id bigint, text string, lang string"


def test_rank_queue_orders_ranks_and_positions():
    rng, q = random.Random(1), RankQueue(70_000)
    items = [(rng.randrange(70_000), rng.randrange(1000)) for _ in range(5000)]
    for r, p in items:
        q.push(r, p)
    out = []
    while (x := q.pop()) is not None:
        out.append(x)
    assert out == sorted(items) and q.pop() is None and not any(q.low) and not q.buckets


@needs_vocabulary
def test_ids_equal_the_public_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    e = encoder()
    public = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=e.ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", " ", "a" * 20_000, "naïve 日本語 🙂🙂 ٣٤ it's <|endoftext|>", "\r\n\t x  \n\n y", "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    texts += ["".join(rng.choice("ab \n\té日x<|>0١'s") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in texts:
        assert e.encode(t) == public.encode_ordinary(t)


@needs_vocabulary
def test_ids_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", None), (3, "hi", None), (3, "hi", None)], DOCS).withColumn("ids", F.lit("x"))
    assert sorted((r.doc_id, list(r.ids)) for r in token_ids(df).collect()) == [(1, []), (2, []), (3, [5303]), (3, [5303])]
    assert token_ids(df.where("false")).count() == 0


def test_hilbert_neighbours_touch():
    n = 4
    grid = [(x, y, z) for x in range(n) for y in range(n) for z in range(n)]
    cells = sorted(zip(hilbert_keys(np.array(grid), 2).tolist(), grid))
    assert [k for k, _ in cells] == list(range(n**3))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(cells, cells[1:]))


def test_best_fit_never_overfills():
    rng = random.Random(3)
    items = [(rng.randint(1, 100), k) for k in range(500)]
    out = best_fit(items, 100)
    assert sorted(k for _, ks in out for k in ks) == list(range(500))
    assert all(sum(items[k][0] for k in ks) + free == 100 for free, ks in out)


@needs_vocabulary
def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(("red", "blue", "nine", "house")) for _ in range(rng.randint(1, 300))), None) for i in range(800)]
    rows += [(900, None, None), (901, "", None), (902, "x y " * 3000, None), (1, rows[1][1], None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("container", F.lit(1))
    sizes = spark.createDataFrame([("s", 500), ("m", 2000), ("m", 2000), ("none", 0), ("null", None)], "size_name string, capacity_tokens int")
    out = packed(df, sizes).collect()
    e, capacity = encoder(), {"s": 500, "m": 2000}
    for name, cap in capacity.items():
        own = [r for r in out if r.size_name == name]
        used = {}
        for r in own:
            if r.container is not None:
                used[r.container] = used.get(r.container, 0) + r.n_tokens
        assert max(used.values()) <= cap and sum(used.values()) == sum(len(e.encode(t)) for _, t, _ in rows)
        assert {r.doc_id for r in own if r.container is None} == {900, 901}
        assert all(r.piece_no == 0 for r in own if len(e.encode(rows[r.doc_id][1] if r.doc_id < 800 else None)) <= cap and r.doc_id < 800)
        assert sum(r.doc_id == 902 for r in own) == -(-len(e.encode(rows[802][1])) // cap)
        assert sum(used.values()) / (len(used) * cap) > 0.97
    assert {r.size_name for r in out} == set(capacity) and fill(packed(df, sizes), sizes.distinct()).count() == 2
    assert packed(df.where("false"), sizes).count() == 0


def test_short_items_fill_their_containers():
    def containers(sizes, capacity):
        columns = {"doc_id": range(len(sizes)), "piece_no": [0] * len(sizes), "start_token": [0] * len(sizes), "size": sizes, "chunk": [3] * len(sizes)}
        table = pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})
        out = pa.Table.from_batches(_pack("x", capacity)(iter(table.to_batches(1000)))).to_pylist()
        assert sorted(r["doc_id"] for r in out) == list(range(len(sizes)))
        used = {}
        for r in out:
            used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        assert max(used.values()) <= capacity and {k >> 33 for k in used} == {3}
        return len(used)

    assert containers([1] * 30_000, 8192) == 4
    assert containers([3] * 30_000, 8192) == 11
    assert containers([1] * 9_000 + [100] * 100, 1_000_000) == 1
    rng = random.Random(9)
    mixed = [rng.choice((1, 2, 700, 1300)) for _ in range(20_000)]
    assert containers(mixed, 2048) <= len(best_fit([(n, (k,)) for k, n in enumerate(mixed)], 2048)) * 1.01 + 1


SENTENCES = {
    1: ["The {a} cat sat on the {a} mat.", "I like my {a} dog a lot.", "We put it in the {a} box and ran.", "He saw a {a} hat."],
    2: ["After I replaced the {a} filter, the window worked for several weeks again.", "My neighbour repaired a similar {a} handle, which only cost about twenty."],
    3: ["Such {a} representation necessitates institutional epistemology.", "Notwithstanding antecedent {a} methodology, heterogeneity circumscribes periodisation considerably."],
}


def post(rng, band, n=12):
    bands = [band] * (n - n // 3) + [rng.choice([b for b in (1, 2, 3) if b != band]) for _ in range(n // 3)]
    rng.shuffle(bands)
    return " ".join(rng.choice(SENTENCES[b]).format(a=rng.choice(("old", "normal", "empirical"))) for b in bands)


def test_held_out_accuracy(spark):
    rng = random.Random(5)
    docs = [(i, post(rng, 1 + i % 3), "en") for i in range(360)]
    docs += [(1000, None, "en"), (1001, "", "en"), (1002, "too short", "en"), (1003, post(rng, 1), "de"), (1004, post(rng, 1), None), (5, docs[5][1], "en")]
    labels = [(i, r, min(3, max(1, 1 + i % 3 + (rng.random() < 0.08)))) for i in range(180) for r in (1, 2)]
    documents = spark.createDataFrame(docs, DOCS).withColumn("band", F.lit(9))
    judged = spark.createDataFrame(labels, "doc_id bigint, rater int, band int")
    got = [tuple(r) for r in rd.reading_bands(documents, judged).collect()]
    assert len(got) == 361 and {i for i, _ in got} == set(range(360))
    test = [(i, b) for i, b in got if i >= 180]
    assert sum(b == 1 + i % 3 for i, b in test) / len(test) > 0.97
    assert rd.reading_bands(documents, judged.where("false")).count() == 0
    assert rd.reading_bands(documents.where("false"), judged).count() == 0


def test_graded_posts_are_read_to_their_end(spark):
    rng = random.Random(6)
    plain = " ".join(["It was as it was on that day."] * 60)
    docs = [(i, plain + " " + post(rng, 1 + i % 3, 60), "en") for i in range(90)] + [(i, post(rng, 1 + i % 3), "en") for i in range(90, 180)]
    documents = spark.createDataFrame(docs, DOCS)
    judged = spark.createDataFrame([(i, 1, 1 + i % 3) for i in range(90)], "doc_id bigint, rater int, band int")
    graded = rd.graded_texts(documents, judged)
    posts = rd.graded_posts(graded)
    assert [p.n for p in posts] == [120] * 90
    xs = rd.features(rd.sentences(rd.own_text(docs[7][1])))
    assert abs(posts[7].sums - sum(x.astype(float) for x in xs)).max() < 1e-6
    assert len(rd.drawn_sentences(graded, 1.0).x) == 90 * 120
    got = {r.doc_id: r.band for r in rd.reading_bands(documents, judged).collect()}
    assert sum(got[i] == 1 + i % 3 for i in range(90, 180)) > 85


def test_sentences_are_drawn_from_whole_posts():
    assert len(rd.chosen(5, 1000, 1.0)) == 1000
    drawn = [k for i in range(-50, 50) for k in rd.chosen(i, 1000, 0.1)]
    assert 9_000 < len(drawn) < 11_000 and all(800 < sum(k // 100 == part for k in drawn) < 1200 for part in range(10))


@pytest.mark.parametrize(
    "text, own",
    [
        ("On 06 Apr 2025, bodri wrote:\n> quoted\n>> more\n\nMine.", "Mine."),
        ("[quote=a]x [quote]y[/quote] z[/quote]\nMine.", "Mine."),
        ("<blockquote><cite>a</cite>\n[quote=b]\ncut [...]\n</blockquote>\nMine.", "Mine."),
        ("[quote=a]\n[quote=b]\ncut [...]\n[/quote]\n\nMine.", "Mine."),
        ("Mine.\n\n-- \nname | motto", "Mine."),
        ("Mine.\n____________\nname\nmotto", "Mine."),
        ("Mine.\n\nSent from my Lurvane pocket", "Mine."),
        ("Mine.\n[size=1]a ~ b[/size]", "Mine."),
        ("<b>Mi</b>ne &amp; [i]yours[/i].<br>", "Mine & yours."),
        ("Mine.\n[code]x = 1\n\tat a.b(C.java:1)[/code]", "Mine."),
        ("[quote]never closed\n\nMine.", "Mine."),
        ("", ""),
    ],
)
def test_own_text(text, own):
    assert rd.own_text(text).strip() == own
