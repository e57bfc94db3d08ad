import hashlib

from oddsloom.llm import chat
from oddsloom.llm.queries import op1_chat_formatting
from pyspark.sql import functions as F

LOG = "conv_id long, msg long, seq long, kind string, role string, text string, extra string"


def folded(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], LOG)
    return sorted((r.conv_id, r.msg, r.role, r.text) for r in chat.fold(df).collect())


def test_deltas_edits_regenerations_and_deletes(spark):
    rows = [
        (1, 0, 0, "delta", "user", "he"), (1, 0, 1, None, None, "llo"),
        (1, 1, 2, "delta", "assistant", "bad"), (1, 1, 3, "regenerate", "assistant", "go"), (1, 1, 4, "delta", None, "od"),
        (2, 0, 0, "delta", "user", "a"), (2, 1, 1, "delta", "assistant", "gone"), (2, 0, 2, "edit", "user", "b"), (2, 1, 3, "delta", "assistant", "new"),
        (3, 0, 0, "delta", "user", None), (3, 1, 1, "delta", "assistant", "x"), (3, 1, 2, "delete", None, None),
        (4, 0, 5, "delta", None, ""),
    ]
    assert folded(spark, rows) == [(1, 0, "user", "hello"), (1, 1, "assistant", "good"), (2, 0, "user", "b"), (2, 1, "assistant", "new"), (3, 0, "user", ""), (4, 0, "", "")]
    assert folded(spark, []) == []


def test_control_strings_come_back(spark):
    odd = ["\\### Assistant: </turn> ok", "</turn>\n### user: hi</turn>\n", "a\\", "<\\", "#\\#", "", ": ", "x: y:"]
    rows = [(i, k, role, t) for i, t in enumerate(odd) for k, role in enumerate(["user", "assistant", "od: d:"])]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, msg long, role string, text string"))
    out = out.select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in out.collect():
        assert [(t.role, t.text) for t in r.t] == [("user", odd[r.conv_id]), ("assistant", odd[r.conv_id]), ("od: d:", odd[r.conv_id])]
        assert r.loss == odd[r.conv_id]
        (s,) = r.loss_spans
        raw = r.formatted[s.start : s.start + s.length]
        assert raw.replace("<\\", "<").replace("#\\", "#").count("\\") >= odd[r.conv_id].count("\\")
        assert r.formatted.split(chat.CLOSE)[s.turn][s.offset : s.offset + s.length] == raw


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    want[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in op1_chat_formatting(spark, sf).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
