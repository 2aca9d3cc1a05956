"""Random logs of events against a plain fold, event by event."""

import random

from locusframe.llm import chat

SCHEMA = "conv_id long, seq long, kind string, message_id string, role string, text string"


def plain(log):
    """Final messages of one conversation, its events in order: a regeneration takes back what later messages had by then."""
    first, state, role = {}, {}, {}
    for seq, kind, m, who, text in log:
        first.setdefault(m, seq)
        if who and not role.get(m):
            role[m] = who
        if kind == "regenerate":
            for other in list(state):
                if first[other] > first[m]:
                    state.pop(other)
                    role.pop(other, None)
            state[m] = ""
        elif kind == "delta":
            state[m] = state.get(m, "") + text
        else:
            state[m] = text
        role.setdefault(m, "")
    return {m: (role[m], state[m]) for m in state}


def made(rng, n):
    names, log = [], []
    for seq in range(n):
        kind = rng.choices(chat.KINDS, [3, 6, 1, 0.2])[0] if names else "message"
        if kind == "message":
            names.append(f"m{seq:05d}")
        m = names[-1] if kind == "message" else rng.choice(names[-6:])
        log.append((seq, kind, m, rng.choice(["user", "assistant"]) if kind == "message" else "", f"<{seq}>" if kind != "regenerate" else ""))
    return log


def test_random_logs(spark):
    rng = random.Random(5)
    logs = {c: made(rng, n) for c, n in enumerate((1, 7, 40, 40, 120, 3000))}
    rows = [(c, s, k, m, r, t) for c, log in logs.items() for s, k, m, r, t in log]
    rng.shuffle(rows)
    got = {}
    for r in chat.fold(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["conv_id"], {})[r["message_id"]] = (r["role"], r["text"])
    assert got == {c: plain(log) for c, log in logs.items()}


def test_one_shuffle(spark, sf_dir):
    plan = chat.op1_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
