"""The budget of chat windows in the tokens of a real tokenizer, and odd columns."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import chat


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def turns(seed=1):
    rng = random.Random(seed)
    kinds = ["今天我们去公园散步看见许多花", "сегодня мы идём гулять в парк", "plain words of a longer sentence", "qzxjkvwp", "<s>[INST\\]", "😀🏽👩‍💻", "१२३४५", "0123456789", "\u1c8a\ua7cb", "\n\t  "]
    out = []
    for c in range(40):
        out += [(c, 0, "system", "be kind")] if c % 2 else []
        out += [(c, t, "user" if t % 2 else "assistant", "".join(rng.choices(kinds, k=rng.randint(0, 14)))) for t in range(1, rng.randint(4, 30))]
    return out


@pytest.mark.parametrize("exact", [False, True])
def test_windows_of_several_turns_keep_the_budget(spark, tokenizer, exact):
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rows = [(*r, count(r[3])) for r in turns()]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n bigint")
    got = chat.chat_windows(df, budget=700, history=150, tokens="n" if exact else None).collect()
    several = [w for w in got if w.text.count(chat.CLOSE) > w.n_repeated + 1]
    assert len(several) > 20 and all(w.n_tokens <= 700 for w in several)
    assert all(count(w.text) <= w.n_tokens for w in got)


def test_exact_counts_fill_the_windows(spark, tokenizer):
    rows = [(1, t, "user", "plain words of a longer sentence " * 6, n) for t, n in enumerate([None, -5, *[len(tokenizer.encode("plain words of a longer sentence " * 6).ids)] * 40])]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n bigint")
    assert chat.chat_windows(df, tokens="n").count() < chat.chat_windows(df).count() / 2


def test_clashing_columns_and_empty_table(spark):
    rows = [(1, 0, "user", "hi", "a", 1, "b", 4, 5), (1, 1, "assistant", "yes", "a", 2, "b", 4, 5)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, conv string, `window` int, t string, tokens int, given int")
    (w,) = chat.chat_windows(df).collect()
    assert (w.conv, w.window, w.text) == (1, 0, "<s>user[INST]hi[/INST]</s><s>assistant[INST]yes[/INST]</s>")
    assert chat.chat_windows(df.limit(0)).count() == 0


def test_a_very_long_conversation_and_text(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "long " * 400_000), *((1, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(2, 6000))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    read = sorted(chat.read_back(chat.chat_windows(df)).collect(), key=lambda r: r.window)
    assert [tuple(t) for r in read for t in r.turns] == [r[2:] for r in rows]
    assert [x for r in read for x in r.targets] == [r[3] for r in rows if r[2] == "assistant"]
