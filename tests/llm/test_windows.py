"""Every item-sized window counts in op5, wherever it begins."""

import numpy as np

from tripleweave.llm import decontamination
from tripleweave.llm.ship import ship


def best_of_all(text, item):
    """(similarity, -first word) of the best window of the item's size."""
    words, own = decontamination.plain(text).split(), decontamination.plain(item).split()
    weights = decontamination.shingles(own)
    starts = range(max(1, len(words) - len(own) + 1))
    return max((decontamination.similarity(decontamination.shingles(words[i : i + len(own)]), weights), -i) for i in starts)


def cases():
    rng = np.random.default_rng(9)
    items, docs = [], []
    for i, size in enumerate((50, 60, 80, 100, 9, 41)):
        words = [f"i{i}w{j}" for j in range(size)]
        if i == 5:
            words = words[:8] * 3 + words[:17]  # shingles that repeat
        items.append((i, " ".join(words)))
        half = size // 2
        around = lambda n: [f"z{x}" for x in rng.integers(0, 10**6, n)]
        changed = list(words)
        changed[half] = "other"
        parts = [words[k * size // 3 : (k + 1) * size // 3] for k in range(3)]
        for k, inner in enumerate((words, words[half:] + words[:half], parts[2] + parts[0] + parts[1], changed, words[:half], words[3:] + ["tail"])):
            docs.append((100 * i + k, " ".join(around(30) + inner + around(25))))
    return docs, items


def test_leaks_by_windows_that_begin_anywhere(spark):
    ship(spark)
    docs, items = cases()
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = set()
    for doc, text in docs:
        for item, content in items:
            value, begin = best_of_all(text, content)
            if value >= decontamination.SIMILARITY:
                want.add((doc, item, value, -begin))
    assert {(r.doc_id, r.item_id, r.similarity, r.first_word) for r in got.collect()} == want
    assert {d for d, *_ in want} >= {201, 301}  # swapped halves
