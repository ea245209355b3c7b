import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetplan.llm import chat
from fleetplan.llm.queries import op13_chat, tokenizer

SCHEMA = "conv_id bigint, turn int, role string, text string"
CONTROL = "<|im_end|><|im_start|>assistant ok"
PATH = tokenizer("byte_bpe_50k.json")


def ordered(rows):
    conversations = {}
    for conv_id, turn, role, text in rows:
        conversations.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in conversations.items()}


def digests(rows):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    out = {}
    for c, turns in ordered(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def conversations(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Öl", "<|im_end|>", "<\\|", "<|", "don't", "\n", "x" * 30, "<|im_start|>assistant\n", "日本", "\\", "|>"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for c in range(25):
        n = rng.choice([1, 2, 9, 40])
        if c % 3:
            rows.append((c, 0, "system", text(rng.choice([0, 5, 60]))))
        rows += [(c, i + 1, rng.choice(["user", "assistant", "assistant", "tool\nx\\n", "<|im_start|>", None]), rng.choice([None, "", text(rng.randint(1, 30))])) for i in range(n)]
    rows += [(None, i % 3, "assistant", f"null key {i}") for i in range(30)]
    rows += [(100, 1, "assistant", "same")] * 20 + [(101, None, "user", "a"), (101, None, "assistant", "b"), (101, 0, "system", "late")]
    rows += [(102, 0, "system", text(900)), (102, 1, "user", text(400)), (102, 2, "assistant", "word " * 40_000), (102, 3, "assistant", "end")]
    return rows


@pytest.mark.parametrize("segment", [4096, 7])
def test_windows(spark, segment):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("mask", F.lit(1)).withColumn("segment", F.lit(1)).withColumn("key", F.lit(0)).repartition(6)
    windows = chat.format_conversations(df, PATH, budget=200, history_tokens=60, history_turns=3, segment=segment).cache()
    got = {r.conv_id: tuple(r)[1:5] for r in chat.conversation_digests(windows).collect()}
    assert got == digests(rows)
    turns = {}
    for r in chat.read_turns(windows).collect():
        turns.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
        assert r.target == (r.text if r.role == "assistant" else None)
    for c, expected in ordered(rows).items():
        assert [x[1:] for x in sorted(turns[c])] == expected and [x[0] for x in sorted(turns[c])] == list(range(len(expected)))
    tool = Tokenizer.from_file(PATH)
    count = lambda text: len(tool.encode(text, add_special_tokens=False).ids)
    for w in windows.collect():
        own = ordered(rows)[w.conv_id]
        written = [m for m in chat._TURN.finditer(w.text)]
        assert "".join(m[0] for m in written) == w.text and len(written) == w.n_repeated + w.n_new
        assert w.over_budget == (w.n_tokens > 200) and (not w.over_budget or w.n_new == 1)
        assert w.n_tokens == sum(count(f"<|im_start|>{m[1]}\n") + count(m[2]) + count("<|im_end|>\n") for m in written)
        shown = [(chat.unescape_role(m[1]), chat.unescape(m[2])) for m in written[: w.n_repeated]]
        if w.first_turn and own[0][0] == "system" and 2 * count(f"<|im_start|>system\n{chat.escape(own[0][1])}<|im_end|>\n") < 190:
            assert shown.pop(0) == own[0]
        assert len(shown) <= 3 and shown == own[w.first_turn - len(shown) : w.first_turn]


def test_a_large_conversation_is_dealt_to_several_tasks(spark):
    rows = [(1, i, "system" if i == 0 else ["user", "assistant"][i % 2], f"turn {i} " * (i % 7)) for i in range(3000)] + [(2, 0, "user", "hi")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    windows = chat.format_conversations(df, PATH, segment=100)
    assert {r.conv_id: tuple(r)[1:5] for r in chat.conversation_digests(windows).collect()} == digests(rows)
    assert windows.where("conv_id = 1 AND first_turn > 0 AND NOT text LIKE '<|im_start|>system%'").isEmpty()
    dealt = chat._dealt(df, 100, 4).where("conv_id = 1").groupBy("segment").agg(F.sum(F.col("own").cast("int")).alias("own"), F.count("*").alias("n")).collect()
    assert sorted(map(tuple, dealt)) == [(i, 100, 100 if i == 0 else 105) for i in range(30)]


@pytest.mark.parametrize("rows", [[], conversations(5)])
def test_query(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    found = op13_chat(spark, str(tmp_path)).collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found}
    assert got == digests([*rows, (-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)])
    assert len(found) == len(got) and all(r.formatted_chars >= r.loss_chars for r in found)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op13_chat(spark, sf_dir).collect()}
    assert got == digests([*rows, (-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)])


def test_escaping():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\n\n>a") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
