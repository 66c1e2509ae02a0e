import hashlib
import random

from graphloom.llm.chat import END, PART, SEP, START, digests, format_conversations, parse

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "\\", "<", "[", "<\\", "<|im_end|>", "<|im_part|", "\\<|im_sep|>", "<<SYS>>", "</s", ">", "é😀", "\n", "INST]", "|im_start|>", "$0", "[/"]


def rows(n=60):
    r = random.Random(4)
    out = []
    for c in range(n):
        for t in range(r.randrange(1, 9)):
            out.append((c, t, r.choice(["user", "assistant", "assistant", "system", "a<|im_sep|>b", "x\\"]), "".join(r.choice(ODD) for _ in range(r.randrange(0, 8)))))
    return out + [(100, 0, None, None), (100, 0, "user", "b"), (100, 0, "user", "a"), (100, 0, "user", "a"), (101, 5, "assistant", "z" * 50_000), (None, 1, "user", "q")]


def expected(data):
    out = {}
    for c, t, role, text in data:
        out.setdefault(c, []).append((t, role or "", text or ""))
    return {c: [x[1:] for x in sorted(v)] for c, v in out.items()}


def test_round_trip(spark):
    data = rows()
    random.Random(1).shuffle(data)
    formatted = format_conversations(spark.createDataFrame([(*x, 1) for x in data], SCHEMA + ", formatted int").repartition(3))
    want = expected(data)
    for r in parse(formatted).collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss_texts == [text for role, text in want[r.conv_id] if role == "assistant"]
    for r in digests(formatted).collect():
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_marks_count_blocks_and_turns(spark):
    got = {r.conv_id: r.formatted for r in format_conversations(spark.createDataFrame(rows(), SCHEMA)).collect()}
    for c, turns in expected(rows()).items():
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))
        assert [got[c].count(m) for m in (START, SEP, END, PART)] == [blocks, blocks, blocks, len(turns) - blocks]
        assert "</s>" not in got[c] and "[INST]" not in got[c]


def test_empty_table(spark):
    assert digests(format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


def test_a_long_conversation_and_clashing_columns(spark):
    """Thousands of turns, runs of one role among them: positions and texts are right, and the steps are not quadratic."""
    r = random.Random(3)
    data = [(1, i, r.choice(["user", "assistant"]), "t" * r.randrange(4)) for i in range(6000)] + [(2, i, "assistant", f"a{i}") for i in range(3000)]
    docs = spark.createDataFrame([(*x, "x", 1) for x in data], SCHEMA + ", turns string, blocks int")
    want = expected(data)
    for row in parse(format_conversations(docs)).collect():
        assert [tuple(t) for t in row.turns] == want[row.conv_id]
        assert row.loss_texts == [text for role, text in want[row.conv_id] if role == "assistant"]
