"""Windows of conversations: an exact round trip, and the budget."""

import collections
import random

from shelfmark.llm import chat


def conversations(seed=4):
    random.seed(seed)
    bits = ["hello", "</s>", "<s>", "[INST]", "[/INST]", "[/INST\\]", "<s\\\\>", "\\", "naïve", "☃", "\n", "a [INST", "</s"]
    rows = []
    for c in range(60):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind " * (c % 5)))
        for t in range(1, random.randint(2, 40)):
            rows.append((c, t, "user" if t % 2 else "assistant", " ".join(random.choice(bits) for _ in range(random.randint(0, 60)))))
    return rows


def test_round_trip_and_budget(spark):
    rows = conversations()
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((t, role, text))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    windows = chat.chat_windows(df, budget=300, history=80, history_turns=3).cache()
    raw, read = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(windows.collect(), key=lambda r: (r.conv, r.window)):
        raw[r.conv].append(r)
    for r in sorted(chat.read_back(windows).collect(), key=lambda r: (r.conv, r.window)):
        read[r.conv].append(r)
    several = 0
    for c, expected in turns.items():
        expected = [(role, text) for _, role, text in sorted(expected)]
        assert [tuple(t) for w in read[c] for t in w.turns] == expected
        assert [x for w in read[c] for x in w.targets] == [text for role, text in expected if role == "assistant"]
        for w in raw[c]:
            new = w.text.count("</s>") - w.n_repeated
            assert new >= 1 and (w.n_tokens <= 300 or new == 1)
            assert w.window == 0 or expected[0][0] != "system" or w.text.startswith("<s>system[INST]")
            assert (w.n_repeated == 0) if w.window == 0 else w.n_repeated <= 4
        several += len(raw[c]) > 1
    assert several > 20
