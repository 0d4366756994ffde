import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from botsift.llm.chat import END, START, format_chats, format_conversation, loss_text, parse

NASTY = st.text(alphabet=st.sampled_from(list("<|\\\n> aim_startendé\U0001f600")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), NASTY), st.one_of(NASTY, st.just(END + START + "assistant\n"))), max_size=5))
def test_round_trip(turns):
    formatted, _ = format_conversation(turns)
    back = parse(formatted)
    assert [(r, t) for r, t, _, _ in back] == turns
    assert formatted.count(START) == len(turns) and formatted.count(END) == len(turns)
    assert loss_text(formatted)[1] == "".join(t for r, t in turns if r == "assistant")


def test_table(spark):
    rng = random.Random(2)
    rows = [(c, t, ["user", "assistant"][t % 2], f"{c} says {t} " + rng.choice(["", END, START, "<\\|", "<|", "é\U0001f600"]), "x")
            for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, 0, "user", None, "x"), (50, 1, "assistant", None, "x"), (50, 1, "assistant", "tie", "x"), (51, None, None, "a\nb", "x"),
             (None, 0, "assistant", "no id", "x"), (52, 0, "assistant", "long " * 100_000, "x"), (53, 0, "user", "twice", "x"),
             (53, 0, "user", "twice", "x")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns string")
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        want[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = format_chats(d).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    assert len(got) == len(want)
    assert all(r["formatted_chars"] == len(r["formatted"]) for r in got)
    assert format_chats(d.limit(0)).count() == 0
