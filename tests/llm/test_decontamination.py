import random

import numpy as np

from tallyforge.llm import decontamination as D

rng = random.Random(3)
WORDS = [f"{a}{b}" for a in ("al", "bor", "ce", "dun", "eth") for b in ("an", "ico", "u", "relle", "ist", "omar")]
say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def test_search_finds_all_fingerprints_within_the_radius():
    r = np.random.default_rng(1)
    index = D.ItemIndex([(i, say(20)) for i in range(50)])
    prints = index.prints[r.integers(0, 50, 400)].copy()
    for i in range(len(prints)):
        for b in r.choice(64, r.integers(0, D.RADIUS + 4), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    w, item = index.near(prints, index.all[0])
    got = set(zip(w.tolist(), item.tolist(), strict=True))
    expected = {(i, j) for i in range(400) for j in range(50) if int(prints[i] ^ index.prints[j]).bit_count() <= D.RADIUS}
    assert got == expected


def _best(text, item):
    """The highest similarity of any window of the item's length."""
    h = D.WordHashes()
    w, _, f, e, _ = h.spans([text])
    iw, _, jf, je, _ = h.spans([item])
    n = min(len(iw), len(w))
    target = D._shingles(iw, je - jf)
    return max((D.similarity(D._shingles(w[s : s + n], (e - f)[s : s + n]), target) for s in range(len(w) - n + 1)), default=0.0)


def test_planted_passages_and_clean_texts(spark):
    items = [(i, say(rng.randint(15, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "two words")]
    rows, planted = [], set()
    for i in range(300):
        t = say(rng.randint(0, 400))
        if i % 3 == 0:
            k, p = rng.randrange(40), items[rng.randrange(40)][1]
            p = items[k][1]
            if i % 2:
                p = p.upper()
            t = f"{t}\n{p} {say(rng.randint(0, 50))}"
            planted.add((i, k))
        rows.append((i, t))
    rows += [(400, None), (401, ""), (402, items[7][1]), (403, " ".join(items[9][1].split()[:-1])), (404, say(30_000) + " " + items[3][1])]
    docs, its = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = D.matches(docs, its).collect()
    got = {(r.doc_id, r.item_id): r for r in out}
    assert planted | {(402, 7), (404, 3)} <= set(got)
    texts, kinds = dict(rows), dict(items)
    assert all(abs(r.similarity - _best(texts[r.doc_id], kinds[r.item_id])) < 1e-9 and r.similarity >= 0.8 for r in out if r.doc_id != 404)
    clean = {i for i, t in rows if t and i < 300 and i % 3}
    assert not {d for d, _ in got} & {i for i in clean if max(_best(texts[i], kinds[k]) for k in range(5)) < 0.5}
    kept = D.drop_contaminated(docs.withColumnRenamed("doc_id", "item_id"), its)
    assert kept.columns == ["item_id", "text"]
    assert {r.item_id for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in got}


def test_no_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs, none).count() == 0 and D.drop_contaminated(docs, none).count() == 1
    assert D.matches(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def _worn(r, item):
    """item with words replaced for as long as its similarity stays at 0.8 or more."""
    now = item.split()
    while True:
        words = list(now)
        words[r.randrange(len(words))] = f"other{r.randrange(999)}"
        if _best(" ".join(words), item) < 0.8:
            return " ".join(now)
        now = words


def test_planted_items_of_a_batch_are_all_found():
    """Items at starts, middles and ends of many texts in one batch, exact and worn down to 0.8.

    A worn item has the length of its original, so its own window is at least 0.8 similar.
    """
    r = random.Random(1)
    speak = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))
    items = [speak(r.randint(20, 90)) for _ in range(120)]
    texts = []
    for i in range(900):
        before, after = ("" if i % 3 == 0 else speak(r.randint(30, 300))), ("" if i % 3 == 2 else speak(r.randint(30, 300)))
        item = items[i % 120]
        texts.append(f"{before} {item if i // 3 % 2 else _worn(r, item)} {after}")
    words, starts, first, end, _ = D.WordHashes().spans(texts)
    found = D.ItemIndex(list(enumerate(items))).search(words, end - first, starts, 0.8)
    assert {(t, t % 120) for t in range(900)} <= {(t, i) for t, i, *_ in found}


def test_recall_of_edited_passages():
    """Words changed, dropped and inserted, items of 15 to 600 words: all pairs of 0.8 and more are found."""
    r = random.Random(8)
    speak = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))
    items = [speak(n) for n in (*(r.randint(15, 120) for _ in range(60)), 300, 600)]
    texts, true = [], set()
    for i in range(250):
        item = r.randrange(len(items))
        words = items[item].split()
        for _ in range(r.randint(0, max(3, len(words) // 40))):
            at, how = r.randrange(len(words)), r.randrange(3)
            words[at : at + (how > 0)] = [] if how == 1 else [f"edit{r.randrange(999)}"]
        texts.append(f"{speak(r.randint(0, 150))} {' '.join(words)} {speak(r.randint(0, 150))}".strip())
        if _best(texts[-1], items[item]) >= 0.8:
            true.add((i, item))
    words, starts, first, end, _ = D.WordHashes().spans(texts)
    found = {(t, i) for t, i, *_ in D.ItemIndex(list(enumerate(items))).search(words, end - first, starts, 0.8)}
    assert len(true) > 120 and true <= found


def test_a_very_long_item_and_ties():
    item = say(3500) + " " + "internationalisation " * 40
    text = f"{say(2000)} {item} {say(900)}"
    twice = f"{say(50)} {item[:150].rsplit(' ', 1)[0]} {say(80)} {item[:150].rsplit(' ', 1)[0]}"
    words, starts, first, end, _ = D.WordHashes().spans([text, twice])
    index = D.ItemIndex([(1, item), (2, item[:150].rsplit(" ", 1)[0])])
    found = {(t, i): (s, n, x) for t, i, s, n, x in index.search(words, end - first, starts, 0.8)}
    assert found[0, 1] == (2000, 3540, 1.0) and found[1, 2][0] == 50  # of two equal windows the first


def test_items_in_several_blocks(spark, monkeypatch):
    items = [(i, say(30)) for i in range(50)] + [(7, say(30))]
    docs = spark.createDataFrame([(i, f"{say(40)} {items[i][1]} {say(20)}") for i in range(51)] + [(99, say(80)), (100, None)], "doc_id long, text string")
    its = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "ITEMS", 16)
    assert sorted((r.doc_id, r.item_id) for r in D.matches(docs, its).collect()) == sorted((i, items[i][0]) for i in range(51))
    assert sorted(r.doc_id for r in D.drop_contaminated(docs, its).collect()) == [99, 100]


def test_repeated_items_are_counted_not_gathered(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b c " + words), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(7, words)] * 5 + [(None, words), (None, words), (8, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0) for r in D.matches(docs, items).collect())
    assert got == [(1, 0)] * 2 + [(1, 7)] * 5
    assert max(len(b) for b in D._blocks(items)) == 2
    assert [r.doc_id for r in D.drop_contaminated(docs, items).collect()] == [2]
