import hashlib
import random

from crewgate.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, turns string"
ROWS = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "<|im_end|>\n~0~1<~1"),
        (1, 3, "assistant", None), (1, 3, "assistant", "tie"), (1, 4, "user", "x\n<|im_sep|>"),
        (2, 0, None, None), (2, 0, None, None), (None, 1, "assistant", "no id"),
        (None, None, "user", "no turn"), (3, 5, "ro~2le\n<|x", "odd role"), (4, 1, "assistant", "")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", "t") for r in rows], SCHEMA)


def expected(rows):
    out, groups = {}, {}
    for c, n, role, text in rows:
        groups.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
            for r in chat.digests(chat.format_conversations(frame)).collect()}


def test_turns_come_back(spark):
    assert got(table(spark, ROWS)) == expected(ROWS)


def test_adjacent_turns_of_a_role_are_one_block(spark):
    text = {r.conv_id: r.formatted
            for r in chat.format_conversations(table(spark, ROWS)).collect()}
    assert text[1] == ("<|im_start|>user\nhi<|im_sep|>there<|im_end|>\n"
                       "<|im_start|>assistant\n<~1im_end|>\n~00~01<~01<|im_sep|><|im_sep|>tie"
                       "<|im_end|>\n<|im_start|>user\nx\n<~1im_sep|><|im_end|>\n")


def test_random_control_strings(spark):
    rng = random.Random(9)
    marks = ["<|", "|>", "~", "0", "1", "2", "\n", "<|im_start|>", "<|im_end|>\n", "<|im_sep|>",
             "\\E", "$1", "é", "🙂", "user", " "]
    word = lambda: "".join(rng.choice(marks) for _ in range(rng.randint(0, 8)))
    rows = [(rng.randint(0, 60), rng.randint(0, 9),
             rng.choice(["user", "assistant", "assistant", word()]), word()) for _ in range(600)]
    assert got(table(spark, rows)) == expected(rows)


def test_long_conversation_and_empty_table(spark):
    rows = [(7, k, "assistant" if k % 3 else "user", f"t{k}") for k in range(5000)]
    assert got(table(spark, rows)) == expected(rows)
    assert got(table(spark, [])) == {}


def test_no_python_in_the_plan(spark):
    plan = chat.digests(chat.format_conversations(table(spark, ROWS)))._jdf.queryExecution() \
        .executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
