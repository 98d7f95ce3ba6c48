"""Encoding by a monoid tree against the tiktoken library, and the round trip."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from shelfmark.llm import bpe_tree, fst_tokens, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
EVERY = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    ids, each = bpe_tree.ranks_of(PATH).encode(texts)
    out, at = [], 0
    for n in each.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def joined(form):
    """The form with every code point, a hundred to a text."""
    return ["\n".join(map(form.format, EVERY[i : i + 100])) for i in range(0, len(EVERY), 100)]


@pytest.mark.parametrize("form", ["{}'re", "a{} b"])
def test_every_code_point(library, form):
    texts = joined(form)
    assert encoded(texts) == library.encode_ordinary_batch(texts)


def test_every_code_point_in_the_other_tokenizer():
    """The boundary machine of the token counts knows the same classes as its library."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, texts = Tokenizer.from_file(path), joined("{}'re")
    counts = fst_tokens.count_tokens(texts, fst_tokens.lexicon_of(fst_tokens.Counts, path))
    assert counts == [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]
    random.seed(3)
    strings = ["".join(random.choice(EVERY) if random.random() < 0.4 else random.choice(" 'abrestvl19.\n") for _ in range(30)) for _ in range(10_000)]
    counts = fst_tokens.count_tokens(strings, fst_tokens.lexicon_of(fst_tokens.Counts, path))
    assert counts == [len(e.ids) for e in model.encode_batch(strings, add_special_tokens=False)]


def test_random_strings(library):
    random.seed(4)
    draw = lambda letters, n: "".join(random.choice(letters) for _ in range(n))
    texts = [draw(EVERY, random.randint(0, 40)) + draw("abc d'sre\n 1é", 60) for _ in range(2000)]
    texts += [draw("aetionsr", random.randint(0, 2500)) for _ in range(200)] + [draw("ab", 2000) for _ in range(50)]
    texts += [s * k for s in ("a", "ab", "=", " ", "\n", "ü", "中", "😀", "1", "- ") for k in (1, 2, 3, 7, 100, 999, 3001)]
    got = encoded(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [bpe_tree.ranks_of(PATH).decode(x).decode() for x in got] == texts


def test_product_is_associative():
    ranks = bpe_tree.ranks_of(PATH)
    random.seed(6)
    for _ in range(300):
        a, b, c = ("".join(random.choice("thelowing") for _ in range(random.randint(0, 50))).encode() for _ in range(3))
        x, y, z = map(ranks.merge, (a, b, c))
        assert ranks.join(ranks.join(x, y), z) == ranks.join(x, ranks.join(y, z)) == ranks.merge(a + b + c) == ranks.merge_long(a + b + c)


def test_long_unbroken_text(library):
    texts = ["x" * 300_000, "ab" * 150_000]
    got = encoded(texts)
    assert [bpe_tree.ranks_of(PATH).decode(x).decode() for x in got] == texts
    assert all(ranks_stable(x) for x in got)


def ranks_stable(ids):
    ranks = bpe_tree.ranks_of(PATH)
    return all(ranks.stable(a, b) for a, b in zip(ids, ids[1:], strict=False))


def test_query(spark, corpus, library, tmp_path):
    rows = [*corpus, (900, None), (901, ""), (902, "same"), (902, "same"), (None, "naïve ☃ 😀\r\n<|endoftext|>")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_bpe_monoid_tree(spark, str(tmp_path)).collect()), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids))), sha(t or "")) for i, t in rows]
    assert got == sorted(want, key=str)


def test_odd_and_empty_tables(odd_docs, no_docs):
    encoded = bpe_tree.encode_documents(odd_docs, PATH)
    assert encoded.columns == ["id", "ids"] and encoded.count() == odd_docs.count()
    got = bpe_tree.decode_documents(encoded, PATH).collect()
    assert sorted((str(r.id), bytes(r.decoded).decode()) for r in got) == sorted((str(r.doc_id), r.text or "") for r in odd_docs.collect())
    assert bpe_tree.decode_documents(bpe_tree.encode_documents(no_docs, PATH), PATH).collect() == []
