"""Problem 4: finds, decoys, placeholders, edges."""

import pytest
from pyspark.sql import functions as F

from tidelog.llm.personal import Finder, personal_data, redacted_entries

NAMES = [("Mattheo", "given"), ("Sunniva", "given"), ("Bramwick", "family"), ("Marlow", "family"), ("Whitlocke", "family")]
FINDER = Finder(NAMES)


@pytest.mark.parametrize(
    "text, redacted",
    [
        ("mail to a.b+c@post.example now", "mail to <EMAIL> now"),
        ("x morque4 [at] inbox [dot] invalid / y", "x <EMAIL> / y"),
        ("<mailto:a@corp.tessaly.test>", "<mailto:<EMAIL>>"),
        ("GET /x?mail=a.b%40post.example HTTP", "GET /x?mail=<EMAIL> HTTP"),
        ("kelros5 (at) corp.tessaly.test", "<EMAIL>"),
        ("https://user@host.example/x and a@b, t�@�C", "https://user@host.example/x and a@b, t�@�C"),
        ("call 07700 900 292 and +1 (212) 555-0117.", "call <PHONE> and <PHONE>."),
        ("(808) 555 0185, 808.555.0163, 0049-30-23125742, +33 1 99 00 47 33", "<PHONE>, <PHONE>, <PHONE>, <PHONE>"),
        ("10.1.19.16 2024-10-15 23:11:10.605517+01:00 0000-00-00 00:00:00 212-68280580 7-81699479 7700.313", "10.1.19.16 2024-10-15 23:11:10.605517+01:00 0000-00-00 00:00:00 212-68280580 7-81699479 7700.313"),
        ("SSN 666-13-2436, ssn=666605937", "SSN <ID_NUMBER>, ssn=<ID_NUMBER>"),
        ("passport no. XK4643194 tax number 66 841 953 859", "passport no. <ID_NUMBER> tax number <ID_NUMBER>"),
        ("driving licence NOVAK342116; ID card 78.18.24-486.49", "driving licence <ID_NUMBER>; ID card <ID_NUMBER>"),
        ("license server down, passport service 5", "license server down, passport service 5"),
        ("to 459 Old Quarry Terrace, Apt 20, Port Salvere", "to <ADDRESS>"),
        ("at 5 rue des Tilleuls, 20634 Port Salvere", "at <ADDRESS>"),
        ("at Amselstraße 137, 12352 Port Salvere is late", "at <ADDRESS> is late"),
        ("to P.O. Box 663, Neu-Brachen", "to <ADDRESS>"),
        ("Lane 7 of the Terrace pool drained", "Lane 7 of the Terrace pool drained"),
        ("assigned to Mattheo Whitlocke", "assigned to <NAME>"),
        ("by Marlow, Sunniva and M. Bramwick; SUNNIVA B. MARLOW", "by <NAME> and <NAME>; <NAME>"),
        ("my name is tobiash grimsdotter and", "my name is <NAME> and"),
        ("signed by Oskell Tindarell", "signed by <NAME>"),
        ("Bramwick Relay joined, MARLOW GATEWAY IS DRAINING, test.marlow.Job marlow-1.test", "Bramwick Relay joined, MARLOW GATEWAY IS DRAINING, test.marlow.Job marlow-1.test"),
        ("Null customer reference in TokenClient", "Null customer reference in TokenClient"),
        ("sunniva.marlow@mail.test", "<EMAIL>"),
        ("bob[@]example.com, jörg@web.de, user@münchen.de", "<EMAIL>, <EMAIL>, <EMAIL>"),
        ("call 020 7946 0958 or tel 01 44 55 66 77", "call <PHONE> or tel <PHONE>"),
        ("passport QQ 12 34 56 C, then", "passport <ID_NUMBER>, then"),
        ("in Calle Mayor 5, 28013 Madrid", "in <ADDRESS>"),
        ("assigned to Zoltan Kovacs; refund for Ada Byron", "assigned to <NAME>; refund for <NAME>"),
        ("GET /health?name=Verrine+Thackerby HTTP", "GET /health?name=<NAME> HTTP"),
        ("moved to Kelvar Gateway, sent by CartClient", "moved to Kelvar Gateway, sent by CartClient"),
        ("", ""),
    ],
)
def test_redaction(text, redacted):
    assert FINDER.redact(text) == redacted


def test_operator_and_edges(spark):
    names = spark.createDataFrame(NAMES + [(None, "given"), ("", None)], "name_part string, name_kind string")
    rows = [
        (1, "a@b.example", None, {"x": None, "agent": "Oskell Tindarell", "y": "call +14155550187"}),
        (1, "a@b.example", None, None),
        (2, None, "", {}),
        (3, "z" * 500_000, "a@b.example " * 5_000, None),
    ]
    df = spark.createDataFrame(rows, "entry_id bigint, message string, raw string, extra map<string,string>").withColumn("field", F.lit("f"))
    got = sorted(tuple(r) for r in personal_data(df, names).collect())
    assert got == [(1, "extra", "name"), (1, "extra", "phone"), (1, "message", "email"), (1, "message", "email"), (3, "raw", "email")]
    out = {(r.entry_id, r.message): r.extra for r in redacted_entries(df.where("entry_id < 3"), names).collect()}
    assert set(out) == {(1, "<EMAIL>"), (2, None)} and out[2, None] == {}
    (extra,) = [r.extra for r in redacted_entries(df.where("entry_id = 1 AND extra IS NOT NULL"), names).collect()]
    assert extra == {"x": None, "agent": "<NAME>", "y": "call <PHONE>"}
    assert personal_data(df.where("false"), names).count() == 0
    one = spark.createDataFrame([(7, None, None, {"a@b.example": "ok", "who": "Bramwick, Hestia", "x": "a\x01b@c.example"})], df.drop("field").schema)
    assert sorted(tuple(r) for r in personal_data(one, names).collect()) == [(7, "extra", "email"), (7, "extra", "name")]
    assert personal_data(df, names.where("false")).count() == 5
