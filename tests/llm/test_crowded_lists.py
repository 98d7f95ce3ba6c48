"""One group of near copies, most pairs just below the bound: its lists are not joined pair by pair, and no link is lost."""

import random

from shelfmark.llm import jaccard
from shelfmark.llm.shingles import shingle_set


def crowd(n):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 3, 3, 3, 4))):
            words[at] = f"own{i}x{at}"
        docs.append((i, " ".join(words)))
    # Some that differ in length by a fifth, and two groups of their own.
    docs += [(n + i, " ".join(base[:120 + i] + [f"end{i}"])) for i in range(12)]
    docs += [(n + 20 + i, " ".join([f"g{i % 2}v{k}" for k in range(60)] + [f"tail{i}"] * (i % 3))) for i in range(10)]
    return docs


def components(docs):
    sets = {i: set(shingle_set(t, 5).tolist()) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    docs = crowd(150)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    want = components(docs)
    stored, rows = jaccard.stored, {}

    def counted(frame, name):
        out = stored(frame, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    for long in (0, 16, 1000):
        rows.clear()
        monkeypatch.setattr(jaccard, "LONG", long, raising=False)
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 40)
        got = {r.id: r.component for r in jaccard.jaccard_components(df).collect()}
        assert got == want
        assert len(set(want.values())) > 20
        if long == 16:
            assert rows["met"] <= 16 * len(docs) / 2
