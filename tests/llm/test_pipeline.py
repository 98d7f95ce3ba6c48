"""The stages against plain Python, on a corpus that has something for each of them."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests_llm_brute import brute_components, brute_lines, sequence, words
from tokenizers import Tokenizer

import corpus_pipeline


@pytest.fixture
def folder(spark, corpus, tmp_path):
    clean = [(i, " ".join(f"word{(i * 7 + j * j) % 997}" for j in range(80)) + ".\nSecond line of it, number " + str(i) + ", ends well here.") for i in range(300, 330)]
    leak = " ".join(clean[4][1].split()[10:40])
    docs = [*corpus, *clean, (400, clean[8][1]), (401, "Before it. " + leak + " " + clean[9][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), leak


def test_stages(spark, folder):
    sf_dir, leak = folder
    docs, frames = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/stage{i}")
        frames.append((docs, docs := spark.read.parquet(f"{sf_dir}/stage{i}")))
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    for before, after in frames[:4]:
        assert after.columns == before.columns and all(r.n_chars == len(r.text) for r in after.collect())

    before, after = map(texts, frames[0])
    assert {d for d, t in before.items() if len(re.findall(r"\S+", t)) < 50}.isdisjoint(after) and set(range(300, 330)) <= set(after)
    before, after = map(texts, frames[1])
    lines = brute_lines(list(before.items()))
    assert after == {d: t for d, t in lines.items() if t.split() or not before[d].split()}
    before, after = map(texts, frames[2])
    roots, sets = brute_components(list(before.items()))
    assert set(after) == {d for d in before if roots[d] == d} and all(after[d] == before[d] for d in after)
    before, after = map(texts, frames[3])
    want = collections.Counter(sequence(words(leak)))
    size = sum(want.values())

    def has(text):
        seq = sequence(words(text))
        return any(100 * (low := sum((collections.Counter(seq[p : p + size]) & want).values())) >= 80 * (2 * size - low) for p in range(max(0, len(seq) - size + 1)))

    assert set(before) - set(after) == {d for d, t in before.items() if has(t)} and len(before) > len(after)
    tokens = collections.Counter()
    for r in frames[4][1].collect():
        tokens[r.doc_id] += r.length
    assert set(tokens) == set(after)


def test_run_is_the_stages(spark, folder):
    """The whole output of run() equals the stages one by one, each checked above, and the tokens are the library's."""
    sf_dir, _ = folder
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/again{i}")
        docs = spark.read.parquet(f"{sf_dir}/again{i}")
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*model.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}
    got, places = collections.defaultdict(dict), []
    for r in rows:
        got[r.doc_id][r.start] = np.frombuffer(r.ids, np.uint16).tolist()
        places += [(r.sequence_id, r.offset + k) for k in range(r.length)]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, np.uint16).astype("<u4").tobytes())
    assert {d: [x for _, part in sorted(parts.items()) for x in part] for d, parts in got.items()} == want and len(want) > 100
    assert sorted(places) == [divmod(k, 1024) for k in range(len(places))]
