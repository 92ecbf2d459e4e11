"""Items that share a long header: a text that holds what is an item's own has most of its weight."""

import random
from collections import Counter

import pytest

from quillspark.llm import decontamination


def similarity(window, item, holders):
    def shingles(words):
        return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))

    a, b = shingles(window), shingles(item)
    weight = lambda s: 1 / holders[s] if s in holders else 1.0
    return sum(weight(s) * min(a[s], b[s]) for s in a | b) / sum(weight(s) * max(a[s], b[s]) for s in a | b)


@pytest.mark.parametrize("seed", [1, 2])
def test_items_with_a_common_header(spark, seed):
    dice = random.Random(seed)
    word = lambda: "".join(dice.choice("abcdefghij") for _ in range(dice.randrange(4, 9)))
    header = [word() for _ in range(150)]
    items = [(k, " ".join([*header, *(word() for _ in range(30))])) for k in range(60)]
    texts = [(k, " ".join(t.split()[150:])) for k, t in items]
    holders = Counter(s for _, t in items for s in {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)})
    want = {k for k, t in texts if similarity(t.split(), dict(items)[k].split(), holders) >= 0.8}
    got = {r.doc_id for r in decontamination.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() if r.doc_id == r.item_id}
    assert len(want) == 60 and len(got) >= 59, (len(got), len(want))
