"""Phrase mining against a plain count of all phrases."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from made import prose

from flowrhythm.llm import collocations as C
from flowrhythm.llm import filters


def plain(rows, top, least, cover=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {q for p, b in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= cover * own[q := p[i : i + m]]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                s, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", 9, "b", 1) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, chunk string, body int").repartition(3)


def made(seed=3):
    r = random.Random(seed)
    words = [prose(k, 1).lower().rstrip(".") for k in range(60)]
    rows = []
    for k in range(150):
        text = " ".join(r.choice(words) + r.choice(("", "", "", "", ".", ",", "\n", "\t ", "\r;")) for _ in range(r.randint(0, 120)))
        rows.append((text + " New York City Hall " * r.randint(0, 2) + "ÉTÉ à la Carte", r.choice(("en", "fr", None))))
    rows += [(None, "en"), ("", "de"), ("  \t ", None), ("one two. " * 400, "en"), ("x " * 3000, "en"), ("a\x0bb\x0cc d e\x1cf g " * 40, "fr"), ("KK Iİ big deal " * 40, "en")]
    return rows + [rows[0]] * 40


def test_equals_a_plain_count(spark):
    rows = made()
    got = sorted(map(tuple, C.collocations(docs_of(spark, rows), top=50, least=5).collect()))
    assert got == plain(rows, 50, 5)
    assert {r[0] for r in got} == {"en", "fr", "und"}


def test_parts_are_ranked_apart(spark, monkeypatch):
    monkeypatch.setattr(C, "RANKED", 40)
    rows = made(4)
    assert sorted(map(tuple, C.collocations(docs_of(spark, rows), top=15, least=3).collect())) == plain(rows, 15, 3)


def test_small_filters_and_slices_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(filters, "MOST_BITS", 1 << 7)
    monkeypatch.setattr(filters, "LEAST_BITS", 1 << 7)
    monkeypatch.setattr(C, "HELD", 100)
    rows = made(5)
    assert sorted(map(tuple, C.collocations(docs_of(spark, rows), top=50, least=4).collect())) == plain(rows, 50, 4)


def test_counts_that_longs_times_a_factor_do_not_hold(spark):
    d = spark.createDataFrame([("en", b"a b ", 2, 1 << 61), ("en", b"a ", 1, 1 << 60)], "lang string, chunk binary, body int, n long")
    got = {r.phrase: r.a for r in C.count_phrases(d).collect()}
    assert got == {"a b": 1 << 61, "a": (1 << 61) + (1 << 60), "b": 1 << 61}


def test_phrases_that_share_a_hash_are_counted_apart(spark):
    chunked = C.materialise(C.dictionary(docs_of(spark, made(6))))
    want = sorted(map(tuple, C.count_phrases(chunked, 5).collect()))
    assert len(want) > 100
    for bits in (3, 9):
        assert sorted(map(tuple, C.count_phrases(chunked, 5, bits=bits).collect())) == want


def test_chunks_hold_each_phrase_once():
    words = [f"w{k % 37}".encode() for k in range(2000)]
    found = Counter()
    for of, chunk, body in zip(*C.chunks([b"", b" ".join(words)])):
        own = chunk.split()
        assert of == 1 and chunk.endswith(b" ") and len(own) <= body + 3
        found.update(tuple(own[i : i + 4]) for i in range(body) if i + 4 <= len(own))
    assert found == Counter(tuple(words[i : i + 4]) for i in range(len(words) - 3))
    # cut alike wherever it stands
    a = set(C.chunks([b"x y z " + b" ".join(words[:500])])[1])
    b = set(C.chunks([b"some other words before " + b" ".join(words[:500])])[1])
    assert len(a & b) >= len(a) - 2


def test_filter_has_all_its_entries(spark):
    h = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000)
    f = C.bloom(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert f.has(h.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 20000).astype(np.uint64)
    assert f.has(other).mean() < 0.05


def test_no_documents(spark):
    assert C.collocations(docs_of(spark, []).limit(0)).count() == 0
    assert C.collocations(docs_of(spark, [(None, None), ("", "en")])).count() == 0


def peak_mb(run):
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_a_task_holds_little(monkeypatch):
    """Two tasks of an executor share its memory with the JVM: 4 MB of texts took 109 MB, and a slice of sums 93."""
    r = np.random.default_rng(1)
    words = np.array(["".join(map(chr, r.integers(97, 123, k))) for k in r.integers(2, 9, 20_000)])
    texts = [" ".join(words[r.zipf(1.3, 2000) % len(words)]).encode() for _ in range(330)]
    batch = pa.record_batch([["en"] * len(texts), pa.array(texts, pa.binary())], names=["lang", "text"])
    found = []
    assert peak_mb(lambda: found.extend(b.num_rows for b in C._parsed(batch, C.PERIOD))) < 80
    want = C.chunks(texts)
    assert len(found) > 1 and sum(found) == len(want[1])

    hashes = [r.integers(0, 1 << 18, 100_000).astype(np.uint64) for _ in range(30)]
    sums, total = C._Sums("h", "tag", "n"), Counter()

    def taken():
        for b in sums.take():
            assert b.num_rows <= C.HANDED and b.schema.names == ["h", "tag", "n"]
            total["n"] += sum(b.column("n").to_numpy())

    def run():
        for h in hashes:
            if sums.add(h, h << np.uint64(32), np.ones(len(h), np.int64)):
                taken()
        taken()

    assert peak_mb(run) < 60 and total["n"] == 3_000_000
