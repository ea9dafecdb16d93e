from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from made import prose

from flowrhythm.llm import near_dedup
from flowrhythm.llm.components import components
from flowrhythm.llm.near_dedup import classes, keep_one, shingles, similarity, sketches, weighted


def edited(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(f"zz{r.randint(0, 10**6)}" if r.random() < share else w for w in text.split())


def brute(a: str, b: str) -> float:
    x, y = Counter(shingles(a).tolist()), Counter(shingles(b).tolist())
    every = {*x, *y}
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in every if x[i] and y[i])


def test_similarity_is_probability_jaccard():
    for k in range(20):
        a = prose(k, 60) + " rep eat ed wor ds" * (k % 5)
        b = edited(a, 0.04, k) + " rep eat ed wor ds" * (k % 3)
        assert abs(similarity(a, b) - brute(a, b)) < 1e-9
    assert similarity("", "a b") == similarity(None, None) == 0


def test_registers_agree_as_often_as_texts_are_alike():
    pairs = [(prose(k, 300), edited(prose(k, 300), 0.02, k)) for k in range(60)]
    got, want = [], []
    for a, b in pairs:
        x, y = weighted(a), weighted(b)
        s = sketches(np.repeat([0, 1], [len(x[0]), len(y[0])]), np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), 2, 140)
        got.append((s[0] == s[1]).mean())
        want.append(similarity(a, b))
    assert abs(np.mean(got) - np.mean(want)) < 0.02


@pytest.mark.parametrize("chunk", [500_000, 60])
def test_components(spark, chunk):
    r = random.Random(5)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)]
    root = {x: x for p in links for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long"), chunk=chunk).collect()}
    assert got == {x: top(x) for p in links if p[0] != p[1] for x in p}


def test_classes_against_all_pairs(make_docs):
    base = [prose(k, 120) for k in range(25)]
    texts = list(base)
    for k in range(12):
        texts += [edited(base[k], p, 10 * k + j) for j, p in enumerate((0.01, 0.02, 0.03, 0.1))]
    texts += [base[3].upper(), base[3] + "  ", base[0]]
    texts += [edited(base[20], 0.012, 900 + k) for k in range(60)]  # a large group of near copies
    texts += [prose(700, 60) + " " + prose(800 + k, 60) for k in range(40)]  # a shared passage, not alike enough
    docs = make_docs([*enumerate(texts)])
    root = [*range(len(texts))]

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    words = [" ".join(t.lower().split()) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if words[i] == words[j] or similarity(texts[i], texts[j]) >= 0.8:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in classes(docs).collect()}
    assert got == {i: top(i) for i in range(len(texts))}
    kept = {r.doc_id for r in keep_one(docs).collect()}
    assert kept == {top(i) for i in range(len(texts))}


def test_large_group_of_dissimilar_members(make_docs, monkeypatch):
    """Near copies among hundreds of documents of one template that are not alike enough: no leader resembles them."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    template, r = prose(5, 300).split(), random.Random(8)

    def changed(words: list[str], n: int) -> list[str]:
        out = list(words)
        for k in r.sample(range(5, len(out) - 5), n):
            out[k] = f"zz{r.randint(0, 10**9)}"
        return out

    texts = [changed(template, 6) for _ in range(260)]
    texts += [changed(texts[7 * k + 3], 2) for k in range(30)]
    r.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    root = [*range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert 200 < len(set(root)) < 270
    got = {d.doc_id: d.class_id for d in classes(make_docs([*enumerate(texts)])).collect()}
    assert got == dict(enumerate(root))


def test_odd_rows(odd_docs, no_docs):
    rows = classes(odd_docs).collect()
    by = {(r.doc_id, r.of): r for r in rows}
    assert len(by) == len(rows) == 11
    same = [r for r in rows if r.class_id == 7 and r.doc_id in (7, 8)]
    assert len(same) == 3 and len({r.class_of for r in same}) == 2
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, None, 5, 6, 7, 7, 7, None])
    assert classes(no_docs).count() == 0 == keep_one(no_docs).count()
