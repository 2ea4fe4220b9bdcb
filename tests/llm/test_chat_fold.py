"""The fold of event logs against one event after another."""

import random

from pyspark.sql import functions as F

from lexiquarry.llm import chat


def plain(events):
    """conv_id -> [(msg, role, text)], event by event."""
    order = lambda v: (v is not None, v if v is not None else 0)
    convs = {}
    known = {(c, s, k, m, r or "", t or "") for c, s, k, m, r, t in events}
    for conv, seq, kind, msg, role, text in sorted(known, key=lambda e: (order(e[1]), e[2], e[4], e[5], order(e[3]))):
        state = convs.setdefault(conv, {})
        if kind == "regenerate" and msg is not None:
            for m, s in state.items():
                if m is not None and m > msg:
                    s["stands"], s["text"] = False, ""
        own = state.get(msg)
        if own is None:
            own = state[msg] = {"stands": True, "role": role, "text": "", "opened": False}
        if kind == "open":
            own["stands"], own["role"] = True, role
        elif kind == "delta":
            own["text"] += text
        elif kind == "edit":
            own["text"] = text
        elif kind == "regenerate":
            own["text"] = ""
    return {c: [(m, s["role"], s["text"]) for m, s in sorted(state.items(), key=lambda x: order(x[0])) if s["stands"]] for c, state in convs.items()}


def folded(spark, events):
    rows = chat.fold(spark.createDataFrame(events, chat.EVENTS)).collect()
    return {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in rows}


def test_equal_to_events_one_by_one_on_1000_logs(spark):
    rng = random.Random(11)
    events = []
    for conv in range(1000):
        log = []
        for _ in range(rng.randint(1, 14)):
            kind = rng.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate", "seen"])
            msg = rng.choice([1, 2, 3, 4, None]) if conv % 10 == 0 else rng.randint(1, 4)
            log.append((conv, rng.randint(1, 9), kind, msg, rng.choice(["user", "assistant", None]), rng.choice(["A", "b", "", None, "new "])))
        events += log + rng.sample(log, len(log) // 3)  # some events come twice
    events += [(None, *e[1:]) for e in events[:20]]
    rng.shuffle(events)
    assert folded(spark, events) == plain(events)


def test_ties_and_repeats(spark):
    def one(*events):
        return folded(spark, [(1, s, k, m, "user", t) for s, k, m, t in events])[1]

    start = (0, "open", 1, None)
    assert one(start, (1, "delta", 1, "x"), (1, "edit", 1, "new")) == [(1, "user", "new")]
    assert one(start, (1, "edit", 1, "A"), (1, "edit", 1, "B")) == [(1, "user", "B")]
    assert one(start, (1, "edit", 1, "A"), (1, "edit", 1, "A")) == [(1, "user", "A")]
    assert one(start, (1, "delta", 1, "x"), (1, "regenerate", 1, None)) == [(1, "user", "")]
    late = [(1, "open", 2, None), (2, "delta", 2, "old"), (3, "regenerate", 1, None), (4, "delta", 2, "late")]
    assert one(start, *late) == [(1, "user", "")]
    assert one(start, *late[:3], (5, "open", 2, None), (6, "delta", 2, "again")) == [(1, "user", ""), (2, "user", "again")]


def test_reworked_logs_fold_to_the_rows(spark):
    rows = [(c, t, r, f"text {c} {t} " * (t * 9)) for c in range(30) for t, r in ((0, "user"), (1, "assistant"), (1, "assistant"), (2, None))] + [(99, 0, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.events_of(table, 16, reworked=True)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    assert log.count() > log.distinct().count()
    turns = lambda e: {r["conv_id"]: r["turns"] for r in chat.fold(e).withColumn("turns", F.col("turns")).collect()}
    assert turns(log) == turns(chat.events_of(table, 16)) and len(turns(log)) == 31
