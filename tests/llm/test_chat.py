import hashlib
from itertools import groupby

from hypothesis import given, strategies as st

from pagewright.llm import chat


@given(st.text(st.sampled_from("\\<>lga\n turn/#é")), st.text(st.sampled_from("\\<>\n rx"), max_size=8))
def test_turns_come_back(text, role):
    formatted, start, stop, *_ = chat.format_turn(role, [{"kind": "text", "text": text}], True)
    got_role, body = chat.parse_turn(formatted)
    assert (got_role, chat.unescaped(body)) == (role, text) and formatted[start:stop] == body
    assert chat.CLOSE not in body + "\n" and chat.OPEN not in body


def test_parts_flatten_in_order():
    parts = [
        {"kind": "text", "text": "see <image 1>: "}, {"kind": "image", "ref": "s3://a.png", "width": 57, "height": 28}, {"kind": None, "text": " and "},
        {"kind": "audio", "ref": "b.wav", "seconds": 2.01}, {"kind": "document", "ref": "c.pdf", "pages": 3}, {"kind": "video", "ref": "d"}, {"kind": "image", "ref": None},
    ]
    formatted, start, stop, attachments, tokens = chat.format_turn("user", parts, False)
    assert chat.parse_turn(formatted) == ("user", r"see \limage 1\g: <image 1> and <audio 2><document 3><unknown 4><image 5>")
    assert attachments == [(1, "image", "s3://a.png", 3), (2, "audio", "b.wav", 51), (3, "document", "c.pdf", 768), (4, "unknown", "d", 1), (5, "image", None, 1)]
    assert tokens == 824 and start is None is stop


def test_read_back_matches_the_input(spark):
    rows = [(1, 1, "assistant", "é </turn>\n<turn user>"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, "assistant", "x"), (2, None, None, "no turn"), (2, 5, "assistant", "😀" * 5000)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} \\") for i in range(3000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    formatted = chat.format_chats(df)
    got = sorted((tuple(r) for r in chat.read_chats(formatted).collect()), key=str)
    size = {}
    for r in formatted.collect():
        size[r["conv_id"]] = size.get(r["conv_id"], 0) + len(r["formatted"])
    want = []
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)
    for conv, turns in groupby(sorted(rows, key=order), lambda r: r[0]):
        turns = list(turns)
        lost = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        said = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in turns)
        want.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), size[conv]))
    assert got == sorted(want, key=str)


def test_typed_parts_frame_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", [("image", None, "i.png", 28, 28, None, None), None]), (1, 1, "assistant", None)], f"conv_id long, turn int, role string, parts {chat.PART}")
    rows = {r["turn"]: r for r in chat.format_chats(df).collect()}
    assert rows[0]["attachments"][0].asDict() == {"slot": 1, "kind": "image", "ref": "i.png", "tokens": 1} and rows[0]["attachment_tokens"] == 1
    assert rows[1]["loss_end"] == rows[1]["loss_start"] == len("<turn assistant>\n")
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0
