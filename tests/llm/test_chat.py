import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.llm import chat

TEXTS = [None, "", "\\", "<|", "<\\|", "<|im_end|>\n<|im_start|>assistant<|im_sep|>", "a\\<|b\\\\<|", "$1 \\$ ü🎉\r\n", "<<||>>", "x" * 30_000]


def test_escape_round_trip(spark):
    @settings(max_examples=20, deadline=None)
    @given(st.lists(st.text(alphabet="<|\\>imsep_\n a$1"), max_size=60))
    def check(texts):
        rows = spark.createDataFrame([(t,) for t in [*texts, "x"]], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
        for r in rows:
            assert r.u == r.t and "<|" not in r.e

    check()


def rows_of(spark):
    rows = [(c, t, ("user", "assistant", "system", None, "odd<|im_sep|>\nrole")[(c + t) % 5], TEXTS[(3 * c + t) % len(TEXTS)]) for c in range(30) for t in range(c % 9)]
    rows += [(100, None, "assistant", "null turn"), (100, 1, "assistant", "same"), (100, 1, "assistant", "same"), (None, 0, "assistant", "no id")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)), rows


def test_digests(spark):
    turns, rows = rows_of(spark)
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c))
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.render(turns)).collect()}
    assert got == want
    assert chat.digests(chat.render(turns.limit(0))).collect() == []


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    turns, rows = rows_of(spark)
    rendered = chat.render(turns)
    whole = {r.conv_id: r.formatted for r in rendered.collect()}
    examples = chat.expand(rendered).collect()
    assert len(examples) == sum(r[2] == "assistant" for r in rows)
    for e in examples:
        assert whole[e.conv_id].startswith(e.text) and e.text.endswith(chat.END)
        head = e.text[: e.loss_start]
        assert head.endswith(f"{chat.START}assistant{chat.SEP}") and e.text[e.loss_end :] == chat.END
        assert "<|" not in e.text[e.loss_start : e.loss_end]
