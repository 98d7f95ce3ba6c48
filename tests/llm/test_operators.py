"""Every operator against plain Python on a small corpus."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
from tests_llm_brute import WORD, brute_components, brute_lines, sequence, words
from tokenizers import Tokenizer

from shelfmark.llm import decontaminate, fst_tokens, jaccard, line_dedup, packing, pii, quality, secrets, suffix_dedup
from shelfmark.llm.spans import joined

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_line_dedup(corpus_df, corpus):
    got = {r.id: r for r in line_dedup.dedup_lines(corpus_df).collect()}
    expected = brute_lines(corpus)
    assert {d: r.clean_text for d, r in got.items()} == expected
    assert sum(r.n_removed for r in got.values()) > 30
    assert all(r.n_removed == t.count("\n") + 1 - r.clean_text.count("\n") - (r.clean_text != "") for (d, t) in corpus if (r := got[d]).clean_text)


def test_packing(corpus_df, corpus):
    model = Tokenizer.from_file(TOKENIZER)
    ids = {d: np.array(model.encode(t, add_special_tokens=False).ids + [0], "<u4") for d, t in corpus}
    rows = packing.pack(corpus_df, TOKENIZER).collect()
    at = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.id, r.start)):
        assert r.start == at[r.id] and r.doc_tokens == len(ids[r.id])
        cut = ids[r.id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(cut.tobytes()) and np.frombuffer(r.ids, np.uint16).tolist() == cut.tolist()
        at[r.id] += r.length
    assert at == {d: len(x) for d, x in ids.items()}
    used = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert sorted(used.values())[1:] == [1024] * (len(used) - 1) and sorted(used) == list(range(len(used)))


def test_hilbert_neighbours_are_adjacent():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = cells[np.argsort(packing.hilbert(cells, bits=3))]
    assert len({tuple(c) for c in order}) == side**3
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_decontamination(spark, corpus_df, corpus):
    clean = [(i, t) for i, t in corpus if i % 3]
    items = [(j, " ".join(clean[5 * j][1].split()[2 : 2 + 20 + j])) for j in range(12)] + [(90, None), (91, ""), (92, "few words here"), (93, " ".join(["again"] * 30))]
    changed = items[0][1].upper().replace(" ", " ,\n")
    docs = [*corpus, (500, "x y z " + changed + " tail"), (501, "so few WORDS here"), (502, "few words here."), (503, " ".join(["again"] * 28))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    got = {(r.id, r.item): round(r.similarity, 6) for r in rows}

    expected = {}
    for d, t in docs:
        seq = sequence(words(t))
        for i, item in items:
            want = collections.Counter(sequence(words(item)))
            m = min(sum(want.values()), len(seq))
            for p in range(len(seq) - m + 1) if m else ():
                low = sum((collections.Counter(seq[p : p + m]) & want).values())
                score = low / (m + sum(want.values()) - low)
                if score >= 0.8:
                    expected[d, i] = max(expected.get((d, i), 0), round(score, 6))
    assert got == expected and (500, 0) in got and (503, 93) in got
    kept = {r.doc_id for r in decontaminate.without_contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in expected}


def test_decontamination_blocks_give_the_same(spark, corpus_df, corpus, monkeypatch):
    bench = spark.createDataFrame([(j, " ".join(corpus[9 * j][1].split()[1:30])) for j in range(15)], "item_id bigint, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(corpus_df, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 4)
    assert sorted(map(tuple, decontaminate.contaminated(corpus_df, bench).collect())) == whole and whole


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(3)
    items = decontaminate.Items([(i, " ".join(f"w{rng.integers(1 << 40)}" for _ in range(20))) for i in range(30)], 5)
    for i, value in enumerate(items.prints):
        for distance in (0, 5, decontaminate.RADIUS):
            flip = sum(1 << int(b) for b in rng.choice(64, distance, replace=False))
            assert i in items.candidates(value ^ np.uint64(flip))


def brute_quality(text):
    w = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    seen, covered = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_figures(corpus_df, corpus):
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(corpus_df).collect()}
    for d, t in corpus:
        f = brute_quality(t)
        assert got[d] == (*f, f[0] < 50 or 100 * f[4] > 50 * f[0])


def test_quality_lines(spark):
    good = "The first sentence has enough words in it to be kept as it is. So has the second one, which follows here without trouble. " * 3
    words = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, good + words + "."), (2, words), (3, " | ".join(f"item{i}" for i in range(90)) + "."), (4, "!! ".join(f"LOUD{i}" for i in range(90)) + "!!"),
        (5, " ".join(f"sym{i}###" for i in range(90)) + "."), (6, words + ".\nLicensed under a licence.\n\nHome"), (7, words + ".\n" + "Privacy Policy " * 60 + "."),
    ]
    got = {r.id: r for r in quality.quality_rules(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert {d: r.kept for d, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False}
    assert got[6].clean_text == words + ".\n" and got[1].clean_text == docs[0][1]


def test_jaccard_components(corpus_df, corpus):
    expected, sets = brute_components(corpus)
    got = {r.id: (r.component, r.n_shingles) for r in jaccard.jaccard_components(corpus_df).collect()}
    assert got == {d: (expected[d], len(sets[d])) for d in sets}
    assert len(set(expected.values())) < len(corpus) - 20


def test_jaccard_at_a_lower_threshold(corpus_df, corpus):
    """More groups whose leaders are apart, so answers are derived through leaders more often."""
    expected, _ = brute_components(corpus, 40)
    assert {r.id: r.component for r in jaccard.jaccard_components(corpus_df, percent=40).collect()} == expected


def test_jaccard_chain_of_near_copies(spark):
    """Neighbours link, ends do not: one component through members whose leaders are apart."""
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(12):
        docs.append((100 - i, " ".join(words)))
        words[7 + 15 * i] = f"x{i}"
    expected, _ = brute_components(docs)
    assert {r.id: r.component for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()} == expected


def test_suffix_dedup(corpus_df, corpus):
    check_suffix(corpus_df, corpus)


def test_suffix_dedup_in_small_shards(corpus_df, corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_FRAGMENTS", 2)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "STRETCH_BITS", 10)
    check_suffix(corpus_df, corpus)


def check_suffix(df, corpus):
    seen = collections.Counter()
    for _, t in corpus:
        b = t.encode()
        seen.update(b[i : i + 400] for i in range(len(b) - 399))
    got = {r.id: r for r in suffix_dedup.remove_repeats(df).collect()}
    for d, t in corpus:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) == (len(b), int(gone.sum()), spans, kept, sha(kept)), d


def test_suffix_array_and_prefixes():
    from shelfmark.llm.suffix_array import common_prefixes, suffix_array

    rng = np.random.default_rng(1)
    for codes in ([*rng.integers(0, 3, 300)], [1, 2] * 120, [5] * 70, [*range(50)], [1]):
        codes = np.array(codes, np.int16)
        order = suffix_array(codes)
        text = codes.tolist()
        expected = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == expected
        shared = common_prefixes(codes, order, 40)
        for k in range(1, len(text)):
            a, b = text[expected[k - 1] :], text[expected[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(40, same)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


def test_pii(spark, corpus_df, corpus):
    odd = [(900, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 001.002.003.255 1.2.3.256 +1 ((( 2 +123456789 4111-1111-1111-1111 4111 1111 1111 1112 12345678901234567890123 ☃ z@y.x")]
    got = pii.find_pii(spark.createDataFrame(odd, "doc_id bigint, text string").unionByName(corpus_df)).select("id", joined_base(pii.BASE).alias("s")).collect()
    assert {r.id: r.s for r in got} == {d: brute_pii(t) for d, t in [*odd, *corpus]}


def joined_base(kinds):
    from pyspark.sql import functions as F

    return joined(F.filter("spans", lambda s: s["kind"].isin(*kinds)))


def test_pii_checksums_and_context(spark):
    docs = [(1, "my iban DE89 3704 0044 0532 0130 00 here"), (2, "iban DE89370400440532013001"), (3, "ssn: 123-45-6789"), (4, "code 123-45-6789"), (5, "ssn 000-45-6789")]
    got = {r.id: [(s.kind, s.start, s.end, round(s.score, 2)) for s in r.spans] for r in pii.find_pii(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: [("iban", 8, 35, 0.8)], 2: [], 3: [("ssn", 5, 16, 0.55)], 4: [], 5: []}


def brute_secrets(t):
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, t, re.A) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets(spark, corpus_df, corpus):
    odd = [(901, "PassWord : \"abcdefghijkl\" TOKEN=secret:abcdefghijklmnop apikey=AKIAAKIAAKIAAKIAAK1 x0123456789abcdef0123456789ABCDEF ☃ passwd=ſhort")]
    got = secrets.find_secrets(spark.createDataFrame(odd, "doc_id bigint, text string").unionByName(corpus_df)).select("id", joined_base(secrets.BASE).alias("s")).collect()
    expected = {d: brute_secrets(t) for d, t in [*odd, *corpus]}
    assert {r.id: r.s for r in got} == expected and sum(map(bool, expected.values())) > 10


def test_trigram_queries():
    assert secrets.trigram_query(r"ab(?:cde|x)fg") == [["abc", "bcd", "cde", "def", "efg"], ["abx", "bxf", "xfg"]]
    assert secrets.trigram_query(r"ab[cd]ef") == [] and secrets.trigram_query(r"KEY_?X") == [["eyx", "key"], ["ey_", "key", "y_x"]]
    assert secrets.QUERIES["hex"] == [] and all(secrets.QUERIES[k] for k in ("assign", "access"))


def test_added_secret_rules(spark):
    docs = [(1, "ghp_" + "aZ9" * 12), (2, "xoxb-1234567890-abc"), (3, "eyJhbGciOiJI.eyJzdWIiOiIx.abc_d"), (4, "-----BEGIN RSA PRIVATE KEY-----"), (5, "ghp_short xoxb-1 eyJ.eyJ")]
    got = {r.id: {s.kind for s in r.spans} for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: {"github"}, 2: {"slack"}, 3: {"jwt"}, 4: {"private_key"}, 5: set()}


def test_token_counts(spark, corpus_df, corpus):
    odd = [(902, "it's 's  's don't I'll we've  'reX ''s\t\n x <|endoftext|> <|endoftext|><|endoftext|>"), (903, "a\0b　漢字 ½ ​ 😀\r\n\r\n  "), (904, "e" * 70_000)]
    model = Tokenizer.from_file(TOKENIZER)
    got = {r.id: (r.n_bytes, r.n_tokens, r.over_limit) for r in fst_tokens.token_counts(spark.createDataFrame(odd, "doc_id bigint, text string").unionByName(corpus_df), TOKENIZER).collect()}
    for d, t in [*odd, *corpus]:
        n = len(model.encode(t, add_special_tokens=False).ids)
        assert got[d] == (len(t.encode()), n, n > 1024)


def test_encoding_is_the_tokenizers():
    rng = np.random.default_rng(2)
    letters = list("ab é1९  \n\t\r'stmdrevl.,!?#$%ÀÖß 　漢字😀\x1c")
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(400)]
    model, lexicon = Tokenizer.from_file(TOKENIZER), fst_tokens.Lexicon(TOKENIZER, bound=50)
    expected = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, np.uint16).tolist() for x in fst_tokens.encode(texts, lexicon)] == expected
    assert fst_tokens.count_tokens(texts, fst_tokens.Counts(TOKENIZER)) == list(map(len, expected))


def test_state_maps_compose_over_chunks(monkeypatch):
    """A run longer than a chunk whose state is not settled by its own symbols."""
    symbols = np.full(1000, fst_tokens.S_MARK, np.uint8)
    symbols[0] = fst_tokens.S_LETTER
    symbols[500:] = fst_tokens.S_APOS2
    whole = fst_tokens.boundaries(symbols)
    monkeypatch.setattr(fst_tokens, "CHUNK", 7)
    assert fst_tokens.boundaries(symbols).tolist() == whole.tolist() == [0, 1]
