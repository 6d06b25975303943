"""What the near-copies join compares after its rounds of hubs."""

import random

from skyledger.llm import jaccard_join
from skyledger.llm.common import prepare, shingle_set


def _words(r, n):
    return [f"w{r.randrange(10**7)}" for _ in range(n)]


def _link_components(spark, texts, monkeypatch):
    """The components by doc_id, and how many pairs were left after the hubs."""
    seen = {}
    checked = jaccard_join._checked

    def spy(pairs, docs, sets, width, percent, path):
        seen[path.rsplit("/", 1)[1]] = pairs.count()
        return checked(pairs, docs, sets, width, percent, path)

    monkeypatch.setattr(jaccard_join, "_checked", spy)
    docs = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard_join.link_components(docs, 5, 80).collect()
    return {r.doc_id: r.component_id for r in rows}, seen["rest"]


def _brute_force(texts, width=5, percent=80):
    sets = [set(shingle_set(t.encode(), width).tolist()) for t in texts]
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= percent * len(a | b) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    return dict(enumerate(comp))


def test_long_texts_that_share_a_passage_are_refused_where_they_meet(corpus_spark, monkeypatch):
    r = random.Random(5)
    texts = []
    for _ in range(6):                       # six pairs with 30 % in common, which 256 bits can't tell from links
        passage = _words(r, 400)
        texts += [" ".join(_words(r, 800) + passage) for _ in range(2)]
    components, left = _link_components(corpus_spark, texts, monkeypatch)
    assert components == _brute_force(texts) == {i: i for i in range(12)}
    assert left == 0


def test_groups_about_the_threshold_lose_no_link(corpus_spark, monkeypatch):
    r = random.Random(8)
    texts = []
    for size, edits in ((90, (0, 1, 2)), (270, (2, 3, 4)), (900, (8, 10, 13))):
        base = _words(r, size)
        for _ in range(14):
            words = list(base)
            for i in r.sample(range(size), r.choice(edits)):
                words[i] = f"x{r.randrange(10**7)}"
            texts.append(" ".join(words))
    components, _ = _link_components(corpus_spark, texts, monkeypatch)
    expected = _brute_force(texts)
    assert components == expected
    assert 3 < len(set(expected.values())) < len(texts)
