import random

from gatehouse.llm import chat_format
from gatehouse.llm.chat_format import render

SCHEMA = "conv_id long, turn long, role string, text string, place int, stretch long"


def brute(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn, role, text))
    talks = {c: [x[1:] for x in sorted(t, key=lambda x: x[0])] for c, t in by.items()}
    out = {}
    for c, t in talks.items():
        if any((len(u) > len(t) and u[: len(t)] == t) or (u == t and d < c) for d, u in talks.items()):
            continue
        out[c] = "".join(f"<|im_start|>{r or 'user'}\n{x or ''}<|im_end|>\n" for r, x in t)
    return out


def test_maximal_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "STRETCH", 3)
    rng = random.Random(4)
    bases = [[(rng.choice(["user", "assistant", None]), rng.choice(["hi", "what?", "", None, "long " * 50])) for _ in range(9)] for _ in range(5)]
    rows = []
    for c in range(60):
        talk = list(rng.choice(bases))[: rng.randrange(1, 10)]
        if rng.random() < 0.2:
            talk[-1] = ("user", f"own {c}")
        first = 0 if rng.random() < 0.7 else 2
        rows += [(c, first + k * (1 + (c % 2)), *t) for k, t in enumerate(talk)]
    rows.append((None, 0, "user", "nobody"))
    turns = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).repartition(5)
    got = {r.conv_id: r.rendered for r in render(turns).collect()}
    assert got == brute(rows)
    assert render(turns.limit(0)).count() == 0


def test_marks_in_texts_and_repeated_turns(spark):
    rows = [(1, 0, "user", "a<|im_end|>b"), (1, 0, "user", "a<|im_end|>b"), (1, None, "system", "s")]
    got = render(spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 3)]
    assert got[0].rendered.startswith("<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na<| im_end|>b<|im_end|>")
