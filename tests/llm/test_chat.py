"""Formatted conversations: round trips, masks, attachments, and the query against DuckDB."""

import hashlib
import random
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldcanon.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = ["\\", "\\\\", "### ", "###", "#", "### assistant: ", "</turn>", "</turn>\n", "<", "</turn", "<|", "<|image:0|>", "|>", ": ", ":", "\n", "é", "👩‍👧", "\x00", " ", "ok", "\\n", "a" * 50]


def odd_rows(n=400, seed=2):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "".join(rng.choices(WORDS, k=rng.randint(0, 8)))])
    roles = ["user", "assistant", "system", None, "", "a: b", "x\\", "### y: ", "</turn>", "assistant: "]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2]), rng.choice(roles), text()) for _ in range(n)]
    return rows + [(9, 0, "assistant", "long \\ ### " * 100_000)] + [(10, t, "assistant", f"{t} text") for t in range(300)] * 2


def in_order(rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", chat.escaped(r[3] or ""))
    return {c: list(own) for c, own in groupby(sorted(rows, key=key), key=lambda r: r[0])}


@pytest.mark.parametrize("part_chars", [chat.PART_CHARS, 100])
def test_round_trip(spark, part_chars):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for c in ("piece", "loss", "part", "content", "formatted", "attachments", "n_turns"):
        df = df.withColumn(c, F.lit("clash"))
    parts = chat.chats(df, part_chars=part_chars)
    got = {}
    for r in sorted(parts.collect(), key=lambda r: (str(r.conv_id), r.part)):
        turns, mask = got.setdefault(r.conv_id, ([], []))
        turns += chat.parsed(r.formatted)
        mask += [chat.unescaped(r.formatted[s.start : s.end]) for s in r.loss]
    want = in_order(rows)
    assert got == {c: ([(r[2] or "", r[3] or "") for r in own], [r[3] or "" for r in own if r[2] == "assistant"]) for c, own in want.items()}
    read = {r.conv_id: r for r in chat.read_back(parts).collect()}
    for c, own in want.items():
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert read[c].n_turns == len(own) and read[c].loss_chars == len(learned)
        assert read[c].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert read[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    if part_chars == 100:
        assert parts.where("conv_id = 10").count() > 50


PARTS = "array<struct<type: string, text: string, ref: string, width: double, height: double, seconds: double, pages: int>>"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_typed_parts(spark):
    turns = [
        (1, 0, "user", [part("text", "see <"), part("text", "| this"), part("image", ref="a.png", width=57.0, height=28.0), part("audio", ref="b.wav", seconds=2.01), part("text", " and \\")]),
        (1, 1, "assistant", [part("document", ref="c.pdf", pages=3), part("text", "done"), part("image", ref=None), None]),
        (1, 2, "user", None),
        (1, 3, "user", []),
        (2, 0, None, [part("video", ref="d.mp4"), part(None, "plain"), part("other", "words"), part(None), part("audio", ref="e", seconds=-1.0)]),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, content {PARTS}")
    rows = {r.conv_id: r for r in chat.chats(df, content_col="content").collect()}
    one = rows[1].formatted
    assert one.startswith("### user: see \\<| this<|image:0|><|audio:1|> and \\\\</turn>\n### assistant: <|document:0|>done<|image:1|></turn>\n")
    assert [(a.kind, a.ref, a.tokens) for a in rows[1].attachments] == [("image", "a.png", 3), ("audio", "b.wav", 51), ("document", "c.pdf", 1680), ("image", None, 256)]
    for a in rows[1].attachments:
        mark = f"<|{a.kind}:{a.n}|>"
        assert one[a["at"] : a["at"] + len(mark)] == mark
    assert [one[s.start : s.end] for s in rows[1].loss] == ["<|document:0|>done<|image:1|>"]
    assert rows[2].formatted == "### : <|document:0|>plainwords<|audio:1|></turn>\n"
    read = {r.conv_id: r for r in chat.read_back(chat.chats(df, content_col="content")).collect()}
    assert (read[1].n_turns, read[1].n_attachments, read[1].attachment_tokens) == (4, 4, 1990)


def test_empty_table_and_other_ids(spark):
    empty = chat.read_back(chat.chats(spark.createDataFrame([], SCHEMA)))
    assert empty.collect() == [] and "turns_sha256" in empty.columns
    named = spark.createDataFrame([("x", 2.5, "user", "b"), ("x", 1.5, "user", "a"), ("y", None, "assistant", "c")], "conv_id string, turn double, role string, text string")
    assert {r.conv_id: r.formatted for r in chat.chats(named).collect()} == {"x": "### user: a</turn>\n### user: b</turn>\n", "y": "### assistant: c</turn>\n"}


def test_broken_text_is_an_error():
    with pytest.raises(ValueError):
        list(chat.parsed("### user: open"))


def test_query_against_duckdb(spark):
    data = "/root/testdata/sf0.01"
    got = queries.QUERIES["op11_chat"](spark, data)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{data}/conversations.parquet')")
    want = con.sql(queries.ORACLE_SQL["op11_chat"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
    assert got.where("conv_id = -7").first().n_turns == 2
