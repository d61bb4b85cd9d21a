import hashlib

import pytest

from sameword.llm.chat import CONTROLS, MARKS, PART, digests, escape, format_conversations, format_turns, op2_chat, read_back, unescape

TEXTS = ["", " ", "\\", "\\\\", "a\\", "</s>", "\\</s>", "\\\\</s>", "<s", "</s></s>", "</s>[INST] ok [/INST]", "\n</s>\n", "é\U0001f600", *CONTROLS, "".join(CONTROLS), "x" * 100000 + "</s>"]


@pytest.mark.parametrize("role", [*MARKS, "", "tool", "a</s>\\"])
def test_turns_come_back(role):
    done = format_turns([(role, [{"kind": "text", "text": t}]) for t in TEXTS])
    assert read_back(done.text) == [(role, t) for t in TEXTS]
    said = "".join(unescape(done.text[a:b]) for a, b in done.spans)
    assert said == ("".join(TEXTS) if role == "assistant" else "")
    assert all(unescape(escape(t)) == t for t in TEXTS)


def test_parts_are_flattened_in_order():
    parts = [
        {"kind": "text", "text": "see <|image|> "}, {"kind": "image", "ref": "a.png", "width": 28, "height": 15}, {"kind": "audio", "ref": "b.wav", "seconds": 1.5},
        {"kind": "document", "ref": "c.pdf", "pages": 3}, {"kind": None, "text": None}, {"kind": "image"},
    ]
    done = format_turns([("assistant", parts)])
    assert [(a.kind, a.ref, a.tokens) for a in done.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 1536), ("image", "", 1)]
    assert done.text == "<s> see \\<|image|> <|image|><|audio|><|document|><|image|> </s>\n"
    assert [done.text[a:b] for a, b in done.spans] == ["see \\<|image|> "]


def test_odd_parts():
    nan, inf = float("nan"), float("inf")
    parts = [{"kind": "video", "ref": "v"}, {"kind": "audio", "seconds": nan}, {"kind": "audio", "seconds": inf}, {"kind": "audio", "seconds": -3.0}, {"kind": "image", "width": -5, "height": 0}, {"kind": "document", "pages": -2}, {"kind": "__class__"}, {"kind": "", "text": "x"}]
    done = format_turns([("user", parts)])
    assert [(a.kind, a.ref, a.tokens) for a in done.attachments] == [("video", "v", 1), ("audio", "", 1), ("audio", "", 1), ("audio", "", 1), ("image", "", 1), ("document", "", 512), ("__class__", "", 1)]
    assert done.text == "[INST] <|document|><|audio|><|audio|><|audio|><|image|><|document|><|document|>x [/INST]\n"


def test_null_conversations_are_their_own(spark):
    turns = spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "a"), (None, None, None, None), (3, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    got = digests(format_conversations(turns)).collect()
    assert sorted(((r.conv or 0, r.n_turns) for r in got)) == [(0, 1), (0, 1), (0, 1), (3, 1)]


def test_tables(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (None, None, None, "x"), (2, 1, "assistant", "é" * 20000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as formatted", "3 as rows", "4 as spans")
    got = {r.conv: r for r in digests(format_conversations(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, 3, sha("aab"))
    assert got[1].turns_sha256 == sha("user\n\nassistant\na\nassistant\na\nassistant\nb\n")
    assert (got[None].n_turns, got[None].turns_sha256, got[2].loss_chars) == (1, sha("\nx\n"), 20000)
    assert format_conversations(turns.limit(0)).count() == 0


def test_part_columns(spark):
    turns = spark.sql(f"select 1 conv_id, 1 turn, 'user' role, cast(array(named_struct('kind','image','text',null,'ref','r','width',14,'height',14,'seconds',null,'pages',null)) as array<{PART}>) parts")
    row = format_conversations(turns, parts_col="parts").first()
    assert row.formatted == "[INST] <|image|> [/INST]\n" and [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("image", "r", 1)]


def test_query_has_the_added_conversation(spark):
    row = op2_chat(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert (row.n_turns, row.loss_chars) == (2, 21) and row.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
