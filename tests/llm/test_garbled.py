"""Problem 7: round trips through wrong decodings, partial and repeated ones, losses, clean text, edges."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidelog.llm import garbled
from tidelog.llm.garbled import JUDGED, SUSPECT, _judge, _suspects, learn_bigrams, learn_key, learn_weights, restored_fields, source_bucket, uncovered

CLEAN = [
    "Größe des Anhangs überschreitet Höchstmaß", "Échec de la requête : délai dépassé", "Не удалось открыть счёт, повторите позже",
    "Příliš žluťoučký kůň zablokoval frontu", "NÃO há mudanças na versão de São Brás", "ファイルの保存が完了しました", "Le café réservé par l’équipe", "12 € per crate, £ 9",
]


def wrong(text, page, times=1):
    for _ in range(times):
        text = "".join(bytes([b]).decode(page) if ok(b, page) else chr(b) for b in text.encode("utf-8"))
    return text


def ok(b, page):
    try:
        bytes([b]).decode(page)
        return True
    except UnicodeDecodeError:
        return False


def test_round_trips(spark):
    rows, want, i = [], {}, 0
    for t in CLEAN * 30:
        rows.append((i, "s", t, None))
        i += 1
    for t in CLEAN:
        for page in ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman"):
            rows.append((i, page, wrong(t, page), None))
            want[i] = (1, t)
            i += 1
    for t in CLEAN[:4]:
        rows.append((i, "twice", wrong(t, "cp1252", 2), None))
        want[i] = (1, t)
        i += 1
    rows.append((i, "r", CLEAN[2].encode("cp1251").decode("cp1252"), "x " + wrong("é à", "cp1252") + " clean é"))
    want[i] = (1, CLEAN[2])
    i += 1
    rows.append((i, "j", CLEAN[5].encode("cp932").decode("latin-1"), None))
    want[i] = (1, CLEAN[5])
    i += 1
    rows.append((i, "lost", CLEAN[0].encode("latin-1").decode("utf-8", "replace"), None))
    want[i] = (0, None)
    rows += [(900, None, None, None), (901, None, "", ""), (902, None, "ascii only", "x" * 300_000), (903, None, wrong("é", "cp1252") * 20_000, None)]
    want[903] = (1, "é" * 20_000)
    df = spark.createDataFrame(rows, "entry_id bigint, source string, message string, raw string").withColumn("text", F.lit("x"))
    found = restored_fields(df).collect()
    got = {r.entry_id: (r.restorable, r.restored if r.restorable else None) for r in found if r.field == "message"}
    assert got == want
    assert [r.restored for r in found if r.field == "raw"] == ["x é à clean é"]
    assert restored_fields(df.where("false")).count() == 0


def test_text_that_stands_only_in_raw(spark):
    shown = CLEAN[2].encode("cp1251").decode("cp1252")
    rows = [(i, "s", (None, "", "ok")[i % 3], CLEAN[2]) for i in range(60)] + [(100, "s", None, shown), (101, "s", "ok", "x " + wrong("é à la carte", "cp1252"))]
    rows += [(200 + i, "s", CLEAN[1], None) for i in range(20)]
    df = spark.createDataFrame(rows, "entry_id bigint, source string, message string, raw string")
    lm = learn_bigrams(df.select("message", "raw"))
    assert lm.score(CLEAN[2]) > lm.score(shown)
    weights = learn_weights(df.mapInArrow(_suspects(lm), SUSPECT).withColumn("key", F.lit(None).cast("string")).mapInArrow(_judge(lm), JUDGED))
    assert {s for s, _ in weights} == {source_bucket("s")}
    assert {(r.entry_id, r.field, r.restored) for r in restored_fields(df).collect()} == {(100, "raw", CLEAN[2]), (101, "raw", "x é à la carte")}


def test_raw_counts_only_beyond_the_message():
    assert [m.group() for m in uncovered("é: ü and é ö", "ü é")] == ["é", "ö"]
    assert uncovered("[x] Größe", "Größe") == [] == uncovered(None, "é") and len(uncovered("é", None)) == 1


WORDS = """přístup odepřen uživateli příliš mnoho žádostí spojení bylo ukončeno čekání na odpověď vypršelo žluťoučký kůň úpěl ďábelské ódy
nelze otevřít účet opakujte později soubor již existuje záloha databáze selhala překročen časový limit požadavku šifrování není dostupné
fronta čeká na zpracování dveře zůstaly zavřené poslední pokus o přihlášení nebyl úspěšný měření teploty řízení provozu""".split()
#: A page that no table knows: the accented letters stand for each other and for signs.
SECRET = str.maketrans("áčďéěíňóřšťúůýžÁČŘŠŽ", "¤ø®ß¿æ§þ¹ðÐ¢œ¶øł©Þµ×".replace("øł", "ħł"))


def czech(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_a_swap_that_no_table_knows(spark, monkeypatch):
    rng = random.Random(7)
    clean = [czech(rng, 6) for _ in range(400)]
    hidden = [x for x in (czech(rng, 6) for _ in range(160)) if x.translate(SECRET) != x]
    rows = [(i, f"s{i % 5}", x) for i, x in enumerate(clean)] + [(1000 + i, "odd", x.translate(SECRET)) for i, x in enumerate(hidden)]
    df = spark.createDataFrame(rows, "entry_id bigint, source string, message string").withColumn("raw", F.lit(None).cast("string"))
    got = {r.entry_id: r.restored for r in restored_fields(df).collect()}
    right = sum(got.get(1000 + i) == x for i, x in enumerate(hidden))
    assert right >= 0.9 * len(hidden) and all(i >= 1000 for i in got)
    monkeypatch.setattr(garbled, "learn_key", lambda *a: {})
    assert restored_fields(df).count() == 0  # nothing is found without the learning


def test_learning_corrects_a_table():
    rng = random.Random(8)
    counts, pairs = Counter(), Counter()
    for x in (czech(rng, 6) for _ in range(500)):
        text = f" {x} "
        for a, b in zip(text, text[1:]):
            for key in ((a, b), (a, ""), ("", "")):
                counts[garbled._bucket(*key)] += 1
        shown = text.translate(SECRET)
        pairs.update(zip(shown, shown[1:]))
    lm = garbled.Bigrams(counts)
    true = {v: chr(k) for k, v in SECRET.items() if chr(k) in "áčěéíňřšůýž"}
    wrong_start = {**true, ord("¤"): "é", ord("ø"): "ž"}
    learnt = learn_key(pairs, wrong_start, lm, [chr(c) for c in SECRET])
    assert all(learnt[k] == z for k, z in true.items())
