"""License scan, benchmark search, top-k and mixing against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, licenses, mixing, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_licenses(documents):
    filler = "some plain words of no license at all in any way "
    notice = dict(licenses.TEMPLATES)
    rows = [(k, filler * (k % 3) + text.upper() + " " + filler) for k, text in enumerate(notice.values())]
    near = notice["BSD-3-Clause"].replace("conditions are met", "terms are met")
    far = notice["GPL-3.0"].replace("General", "Special")
    rows += [(50, near), (51, far), (52, None), (53, ""), (54, "Licensed under the"), (None, notice["MIT"])]
    rows += [(55, filler * 4000 + notice["MIT"]), (0, rows[0][1])]
    got = {(r.doc_id, r.license_id): r for r in licenses.license_scan(documents(rows)).collect()}
    want = {(k, name) for k, name in enumerate(notice)} | {(50, "BSD-3-Clause"), (None, "MIT"), (55, "MIT")}
    assert set(got) == want
    assert all(r.containment == 1.0 for k, r in got.items() if k[0] != 50)
    assert 0.8 <= got[50, "BSD-3-Clause"].containment < 1
    assert got[55, "MIT"].first_word == 44_000 and got[55, "MIT"].n_words == 5
    assert licenses.license_scan(documents([])).count() == 0
    with pytest.raises(ValueError):
        licenses.license_scan(documents(rows), [("x", " !? ")])


def test_short_templates_beside_long_ones(documents):
    templates = [("long", notice_of("MIT-grant")), ("short", "All rights reserved."), ("one", "copyleft")]
    rows = [(1, "x all RIGHTS reserved y all rights reserved"), (2, "all rights are reserved"), (3, "Copyleft"), (4, None)]
    got = {(r.doc_id, r.license_id, r.first_word, r.n_words) for r in licenses.license_scan(documents(rows), templates).collect()}
    assert got == {(1, "short", 1, 3), (3, "one", 0, 1)}


def notice_of(name):
    return dict(licenses.TEMPLATES)[name]


def test_licenses_against_all_windows(documents):
    """Texts with edited notices: every place of the template's length, by brute force."""
    draw = random.Random(2)
    word = re.compile(licenses.WORD_ASCII)
    rows, want = [], {}
    templates = [t for t in licenses.TEMPLATES if len(word.findall(t[1])) >= 5]
    for k in range(150):
        words = word.findall(draw.choice(templates)[1].lower())
        for _ in range(draw.randrange(3)):
            words[draw.randrange(len(words))] = draw.choice(["changed", "the", "license"])
        text = [draw.choice("some other words of a page".split()) for _ in range(draw.randrange(30))]
        rows.append((k, " ".join(text + words + text[::-1])))
        own = word.findall(rows[-1][1])
        for name, template in templates:
            t = word.findall(template.lower())
            shingles = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            best = 0.0
            for start in range(-len(t), len(own)):
                region = own[max(start, 0) : start + len(t)]
                its = {tuple(region[i : i + 5]) for i in range(len(region) - 4)}
                best = max(best, len(shingles & its) / len(shingles))
            if best >= 0.8:
                want[k, name] = best
    got = {(r.doc_id, r.license_id): r.containment for r in licenses.license_scan(documents(rows), templates).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 50
    assert all(got[key] <= want[key] + 1e-9 for key in got)


def test_one_repeated_word_as_item_and_text():
    """Every window is the item: the first is taken, the others are not verified one by one."""
    index = decontaminate.Index([(1, "again " * 40), (2, "other words " * 20)])
    data = np.frombuffer(b"again " * 30_000, np.uint8)
    verified = []
    plain = index.verify
    index.verify = lambda *args: verified.append(1) or plain(*args)
    found = index.matches(data, np.array([0, len(data)]))
    assert found == {(0, 0): (1.0, 0, 40)}


def test_decontamination(documents, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 7)  # several passes
    draw = random.Random(4)
    vocabulary = [f"t{k}" for k in range(3000)]

    def text(n):
        return " ".join(draw.choice(vocabulary) for _ in range(n))

    items = [(k, text(n)) for k, n in enumerate([3, 6, 14, 15, 22, 31, 40, 55, 59, 120, 20, 33])]
    items += [(20, None), (21, " "), (None, text(20)), (3, items[3][1])]
    rows, want = [], set()
    for k in range(12):
        body = items[k][1].title() if k % 2 else items[k][1]
        rows.append((k, text(draw.randrange(50)) + " " + body + "\n" + text(draw.randrange(50))))
        want.add((k, k))
    words = items[9][1].split()
    words[60] = "changed"
    rows.append((30, text(10) + " " + " ".join(words)))
    want.add((30, 9))
    rows += [(31, " ".join(items[9][1].split()[:60])), (32, text(5000)), (33, None), (34, "")]
    rows += [(None, items[7][1]), (5, rows[5][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows)
    found = decontaminate.contaminated(docs, benchmark).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert set(got) == want | {(None, 7)} and len(found) == len(got)
    assert all(r.similarity == 1.0 for r in found if r.doc_id != 30)
    assert got[30, 9].first_word == 10 and got[30, 9].n_words == 120
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [31, 32, 33, 34]
    assert decontaminate.contaminated(documents([]), benchmark).count() == 0
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(rows)


def test_decontamination_near_the_threshold():
    """Every document with edits, against all windows of the item's length by brute force."""
    draw = random.Random(11)
    vocabulary = [f"t{k}" for k in range(3000)]

    def words(n):
        return [draw.choice(vocabulary) for _ in range(n)]

    def shingles(text):
        out = {}
        for k in range(len(text) - 4):
            out[tuple(text[k : k + 5])] = sum(map(len, text[k : k + 5]))
        return out

    def similarity(a, b):
        common = sum(v for s, v in a.items() if s in b)
        return common / (sum(a.values()) + sum(b.values()) - common)

    items = [words(n) for n in [50, 52, 55, 56, 142, 200]]
    index = decontaminate.Index([(k, " ".join(item)) for k, item in enumerate(items)])
    docs, want = [], {}
    for number, item in enumerate(items):
        own = shingles(item)
        for _ in range(40):
            copy = list(item)
            for _ in range(draw.choice([1, 1, 2, 3, 4])):
                at = draw.randrange(len(copy))
                copy[at : at + 1] = draw.choice([["changed"], ["changed"], [], [copy[at], "added"]])
            head = words(draw.randrange(12))
            doc = head + copy + words(draw.randrange(12))
            best = max(
                similarity(own, shingles(doc[max(s, 0) : max(s, 0) + len(item) + min(s, 0)]))
                for s in range(5 - len(item), len(doc) - 4)
            )
            if best >= 0.8:
                want[len(docs), number] = best
            docs.append(" ".join(doc))
    sizes = np.cumsum([0] + [len(d) for d in docs])
    got = index.matches(np.frombuffer("".join(d for d in docs).encode(), np.uint8), sizes)
    missed = set(want) - set(got)
    assert len(want) > 100 and not missed, f"{len(missed)} of {len(want)} missed"
    assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_multi_index_finds_all_within_radius():
    draw = np.random.default_rng(1)
    prints = draw.integers(0, 1 << 63, 40, np.uint64)
    found = np.repeat(prints, 60)
    for k in range(len(found)):
        for bit in draw.choice(64, draw.integers(0, 20), replace=False):
            found[k] ^= np.uint64(1) << np.uint64(bit)
    tables = [decontaminate.Index.table(prints, b) for b in range(decontaminate.BLOCKS)]
    at, number = decontaminate.Index.near(found, prints, tables)
    near = np.bitwise_count(found[:, None] ^ prints[None, :]) <= decontaminate.RADIUS
    assert set(zip(at.tolist(), number.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    draw = random.Random(6)
    rows = [(k, [draw.gauss(0, 1) * scale for _ in range(6)]) for k in range(150)]
    rows += [(200 + k, [1.0] * 6) for k in range(60)]  # ties
    odd = [(400, None), (401, [1.0, None]), (402, [math.inf] * 6), (403, [math.nan]), (None, [1.0] * 6)]
    odd += [(420, [2.0, 3.0]), (440, []), (20, rows[20][1])]
    frame = spark.createDataFrame(
        [(i, v, 0, 0) for i, v in rows + odd], "vec_id long, embedding array<float>, shard int, block int"
    )
    asks = F.col("vec_id") % 20 == 0
    got = [tuple(r) for r in topk.top_k(frame, asks).collect()]
    usable = rows + [(420, [2.0, 3.0]), (440, []), (20, rows[20][1])]
    vectors = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in usable]
    want = []
    for q, v in vectors[:-1]:
        if q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(v, c)), i) for i, c in vectors if i != q]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:20], 1)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(frame.limit(0), asks).count() == 0
    few = topk.top_k(frame.filter("vec_id IN (1, 40, 41)"), asks)
    assert few.count() == 2


def brute_quota(votes, seats):
    quota = dict.fromkeys(votes, 0)
    for _ in range(seats if any(votes.values()) else 0):
        best = min(votes, key=lambda p: (-votes[p] / (2 * quota[p] + 1), p))
        quota[best] += 1
    return quota


def test_sainte_lague(spark):
    draw = random.Random(8)
    rows, want = [], {}
    for group in range(12):
        votes = {p: draw.choice([0, 3, 10, 10, 77, 500, 5000]) for p in range(draw.randrange(1, 9))}
        seats = draw.choice([0, 1, 2, 7, 100, 999])
        rows += [(group, p, v, seats) for p, v in votes.items()]
        want |= {(group, p): q for p, q in brute_quota(votes, seats).items()}
    frame = spark.createDataFrame(rows, "g long, p long, votes long, seats long")
    got = mixing.sainte_lague(frame, ["g"], "votes", "seats", [F.col("p")]).collect()
    assert {(r.g, r.p): r.quota for r in got} == want


def test_mixing(documents, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 5)
    draw = random.Random(2)
    rows, sources = [], []
    for k in range(200):
        sources.append(draw.choice(["a", "b", "B", "é", None, "big", "big", "big"]))
        rows.append((k if k % 50 else None, "word " * draw.randrange(400)))
    rows += [(500, None), (501, ""), (502, "tiny text here"), (3, rows[3][1])]
    sources += ["a", "b", "lone", sources[3]]
    docs = documents(rows, sources=sources)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for (_, text), source in zip(rows, sources):
        size[source] = size.get(source, 0) + len(WORD.findall(text or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, pool = {}, 1.5 * sum(size.values())
    while True:
        rest, over = pool - sum(target.values()), [s for s in names if s not in target]
        share = {s: rest * weight[s] / sum(weight[o] for o in over) for s in over}
        full = [s for s in over if share[s] > 2 * size[s]]
        if not full:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in full}
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS * 3
    again = sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    assert again == sorted((r.doc_id or -1, r.size, r.taken) for r in got)
    assert mixing.mix(documents([])).count() == 0
    assert [r.taken for r in mixing.mix(documents([(1, None)])).collect()] == [0]
