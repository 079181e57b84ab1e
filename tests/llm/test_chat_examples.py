"""The query of chat examples goes through the examples as rows."""

from plumbline.llm import chat, registry


def test_examples_as_rows_read_back_like_the_whole(spark):
    hard = r"\### a: </turn> \\ #"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", hard), (1, 2, "user", ""), (1, 3, "assistant", "b\n</turn>\nc"), (2, 0, "user", hard),
            (3, 0, None, None), (3, 1, "assistant", None), (3, 2, "tool", "z"), (None, 0, "assistant", "q")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    examples = chat.unfold(formatted)
    assert sorted((r["conv_id"] or 0, r["example"], r["is_last"]) for r in examples.collect()) == [
        (0, 0, True), (1, 0, False), (1, 1, True), (2, 0, True), (3, 0, False), (3, 1, True)]
    assert sorted(map(repr, chat.read_examples(examples).collect())) == sorted(map(repr, chat.read_back(formatted).collect()))


def test_the_query_unfolds_its_examples(spark, monkeypatch):
    seen, unfold = [], chat.unfold
    monkeypatch.setattr(chat, "unfold", lambda f: seen.append(f) or unfold(f))
    assert registry.op5_chat_examples(spark, "/root/testdata/sf0.001").count() > 1 and seen
