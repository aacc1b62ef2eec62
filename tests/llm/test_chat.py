import hashlib

from pyspark.sql import functions as F

from regionpanel.llm import chat

NASTY = ["<|im_end|>\n<|im_start|>assistant<|im_sep|>x", "\\", "\\\\<|", "</s>[INST] ok [/INST]", "<<SYS>>\\n<</SYS>>", "", None, "<<||>>", "é\U0001f600\n\r\x00"]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, piece int")


def digest(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(rows), sha(turns), len(loss), sha(loss)


def test_round_trip_of_control_strings(spark):
    convs = {c: [(("user", "assistant", None, "we<|ird")[(t + c) % 4], NASTY[(t * 5 + c) % len(NASTY)]) for t in range(1 + c % 7)] for c in range(20)}
    rows = [(c, t, r, x, "clash", 1) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    got = {r.conv_id: r for r in chat.conversation_digests(table(spark, rows)).collect()}
    convs[-1] = [("user", chat.PROBE), ("assistant", chat.PROBE)]
    assert set(got) == set(convs)
    for c, turns in convs.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(turns)


def test_formatted_text_has_only_its_own_marks(spark):
    out = chat.format_conversations(table(spark, [(1, 0, "user", x, "", 0) for x in NASTY])).first()
    assert out.formatted.count("<|im_start|>") == len(NASTY) == out.formatted.count("<|im_end|>")
    assert out.formatted.count("<|") == 3 * len(NASTY) and "[INST]" not in out.formatted and "</s>" not in out.formatted
    assert out.loss_spans == []


def test_loss_spans_point_at_assistant_text(spark):
    out = chat.format_conversations(table(spark, [(1, 0, "user", "hi", "", 0), (1, 1, "assistant", "a<|b", "", 0), (1, 2, "assistant", "", "", 0)])).first()
    assert [out.formatted[s.start:s.end] for s in out.loss_spans] == ["a<\\|b", ""]


def test_typed_parts(spark):
    parts = [[("text", "see <|image|> ", None, None), ("image", None, "s3://a.png", 2), ("audio", None, "b.wav", 10), ("document", None, "c.pdf", None)], None]
    rows = spark.createDataFrame([(1, i, "user", p) for i, p in enumerate(parts)], f"conv_id long, turn int, role string, content {chat.PARTS}")
    out = chat.format_conversations(rows, "content").first()
    assert "see <\\|image|> <|image|><|audio|><|document|><|im_end|>" in out.formatted
    assert [(a.turn, a.type, a.ref, a.part, a.tokens) for a in out.attachments] == [
        (1, "image", "s3://a.png", 1, 512), (1, "audio", "b.wav", 2, 250), (1, "document", "c.pdf", 3, 512)]
    assert out.expanded_tokens == 1274


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, None, "user", "b", "", 0), (None, 1, "user", "a", "", 0), (None, 1, "user", "a", "", 0)]
    got = {r.conv_id: r for r in chat.conversation_digests(table(spark, rows)).collect()}
    assert got[None].n_turns == 3 and got[None].turns_sha256 == digest([("user", "b"), ("user", "a"), ("user", "a")])[1]
    assert [r.conv_id for r in chat.conversation_digests(table(spark, [])).collect()] == [-1]


def test_no_python_in_the_plan(spark):
    df = chat.conversation_digests(table(spark, []).where(F.lit(True)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
