"""Every link of the Jaccard join, also those inside a component."""

import collections
import random

import pytest
from tests_llm_brute import shingles

from shelfmark.llm import jaccard


def brute_links(docs, percent=80):
    """Similar pairs of different sets, each as two lists of documents, and the links of every document."""
    holders = collections.defaultdict(list)
    for d, t in docs:
        holders[shingles(t)].append(d)
    sets, count = [s for s in holders if s], collections.Counter({d: 0 for d, _ in docs})
    pairs = set()
    for i, a in enumerate(sets):
        for d in holders[a]:
            count[d] += len(holders[a]) - 1
        for b in sets[i + 1 :]:
            k = len(a & b)
            if 100 * k >= percent * (len(a) + len(b) - k):
                pairs.add(frozenset([min(holders[a]), min(holders[b])]))
                for x, y in ((a, b), (b, a)):
                    for d in holders[x]:
                        count[d] += len(holders[y])
    return pairs, dict(count)


def check(df, docs, percent=80):
    links, members = jaccard.all_links(df, percent=percent)
    members, links = members.collect(), links.collect()
    first = {}
    for r in members:
        first[r.node] = min(first.get(r.node, r.id), r.id)
    pairs, count = brute_links(docs, percent)
    assert {frozenset([first[r.a], first[r.b]]) for r in links} == pairs and len(links) == len(pairs)
    assert all(r.a < r.b for r in links)
    assert {r.id: r.n_links for r in members} == count
    return pairs


@pytest.mark.parametrize("percent", [80, 40])
def test_links_of_the_corpus(corpus_df, corpus, percent):
    check(corpus_df, corpus, percent)


def test_links_inside_a_large_group(spark, monkeypatch):
    """Near copies of one text, many of which are similar to each other and not to one leader."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    random.seed(3)
    base, docs = [f"w{i}" for i in range(150)], [(900, ""), (901, "")]
    for d in range(120):
        words = list(base)
        for p in random.sample(range(150), d % 6):
            words[p] = f"x{random.randrange(40)}"
        docs.append((d, " ".join(words)))
    pairs = check(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), docs)
    assert len(pairs) > 500


def test_no_links(spark):
    docs = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "")]
    check(spark.createDataFrame(docs, "doc_id bigint, text string"), docs)
    links, members = jaccard.all_links(spark.createDataFrame([], "doc_id bigint, text string"))
    assert links.count() == members.count() == 0
