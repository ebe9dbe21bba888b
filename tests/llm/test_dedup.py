"""Substring, line and near-duplicate operators against brute force."""

import hashlib
import random
import re
from itertools import combinations

import pytest

from tessera.llm import linededup, neardup, substrings
from tessera.llm.linking import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").encode())


def test_substrings(documents, prose, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(substrings, "BUCKET_WINDOWS", 4_000)
    seen, want = set(), {}
    for doc_id, text in sorted(prose, key=lambda r: r[0]):
        words = words_of(text)
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    for levels in (1, 2, 3):
        done = substrings.substring_dedup(documents(prose + [(None, "a b " * 30)]), 20, levels).collect()
        got = {r.doc_id: tuple(r)[1:] for r in done}
        alone = got.pop(None)
        assert got == want
        assert alone[:2] == (60, 0)
        assert len(done) == len(prose) + 1
    assert sum(w[1] for w in want.values()) > 500


def test_substrings_of_repeated_rows_and_empty_table(documents):
    text = " ".join(f"v{k}" for k in range(25))
    rows = substrings.substring_dedup(documents([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 25), (2, 25)]
    assert substrings.substring_dedup(documents([])).count() == 0
    with pytest.raises(ValueError):
        substrings.substring_dedup(documents([]), 20, 4)


def line_brute(prose):
    import numpy as np

    from tessera.llm import text as T

    def line_hash(line):
        data = np.frombuffer(line, np.uint8)
        return int(T.span_hash(T._BYTES[0][data], np.array([0]), np.array([len(line)]))[0])

    seen, out = set(), {}
    for doc_id, text in sorted(prose, key=lambda r: r[0]):
        if not text:
            out[doc_id] = (text, 0, 0)
            continue
        lines = text.encode().split(b"\n")
        full = [k for k, line in enumerate(lines) if words_of(line.decode())]
        if not full:
            out[doc_id] = (text, 0, 0)
            continue
        hashes = [line_hash(lines[k]) for k in full]
        joined = [(h + b * 31) % 2**64 for h, b in zip(hashes, [0, *hashes])]
        r = [int(x) for x in T.mix(np.array(joined, np.uint64))]
        ends = [k for k in range(1, len(r) - 2) if r[k - 1] > r[k] <= r[k + 1]] + [len(r) - 1]
        kept, gone, cuts, upto = [], 0, 0, 0
        for a, b in zip([-1, *ends], ends):
            body = b"\n".join(lines[full[a + 1] : full[b] + 1])
            stop = len(lines) if b == len(r) - 1 else full[b] + 1
            if b - a >= 2 and body in seen:
                gone, cuts = gone + stop - upto, cuts + 1
            else:
                kept.append(b"\n".join(lines[upto:stop]))
                if b - a >= 2:
                    seen.add(body)
            upto = stop
        lines = gone
        out[doc_id] = (b"\n".join(kept).decode(), lines, cuts)
    return out


def test_lines(documents, prose, monkeypatch):
    monkeypatch.setattr(linededup, "SHARE", 3)  # a passage of eight copies then needs three shares
    want = line_brute(prose)
    frame = documents(prose + [(None, "p q\nr s\nt u\nv w"), (None, "p q\nr s\nt u\nv w")])
    done = linededup.line_dedup(frame)
    assert done.columns[: len(frame.columns)] == frame.columns
    rows = done.collect()
    got = {r.doc_id: (r.text, r._lines_removed, r._chunks_removed) for r in rows if r.doc_id is not None}
    assert got == want
    assert [r.text for r in rows if r.doc_id is None] == ["p q\nr s\nt u\nv w"] * 2
    assert {r._id for r in rows} == {3}
    assert sum(w[2] for w in want.values()) > 20


def test_blank_lines_do_not_hide_copies(documents):
    """Whole copies go whatever blank lines separate or surround their paragraphs."""
    draw = random.Random(3)
    bodies = [[f"paragraph {k} {draw.random()} of it" for k in range(draw.randrange(2, 12))] for _ in range(40)]
    rows = [(k, "\n\n".join(body)) for k, body in enumerate(bodies)]
    rows += [(100 + k, "\n\n".join(body) + "\n \n") for k, body in enumerate(bodies)]
    rows += [(300, "\n \n\t"), (301, "\n \n\t")]
    done = linededup.line_dedup(documents(rows))
    got = {r.doc_id: r.text for r in done.collect()}
    assert all(got[k] == text for k, text in rows[:40]) and got[300] == got[301] == "\n \n\t"
    assert all(got[100 + k] == "" for k in range(40))
    again = linededup.line_dedup(done)  # its own columns are there already
    assert again.columns[-2:] == ["__lines_removed", "__chunks_removed"]
    assert {r.doc_id: r.text for r in again.collect()} == got


def test_lines_of_repeated_rows_and_empty_table(documents):
    text = "\n".join(f"line {k} of it" for k in range(12))
    rows = linededup.line_dedup(documents([(4, text), (4, text), (9, text)])).collect()
    assert sorted((r.doc_id, r._lines_removed) for r in rows)[:2] == [(4, 0), (4, 0)]
    assert [r for r in rows if r.doc_id == 9][0]._lines_removed == 12
    assert linededup.line_dedup(documents([])).count() == 0


def near_brute(prose, size, percent):
    sets = {}
    for doc_id, text in prose:
        words = [w.translate(FOLD) for w in words_of(text)]
        n = len(words)
        sets[doc_id] = {tuple(words[k : k + size]) for k in range(max(n - size + 1, min(n, 1)))}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for x, y in combinations(sorted(sets), 2):
        common = len(sets[x] & sets[y])
        if common and 100 * common >= percent * len(sets[x] | sets[y]):
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("size, percent, listed", [(3, 85, 8), (5, 80, 2)])
def test_near_duplicates(documents, prose, monkeypatch, size, percent, listed):
    monkeypatch.setattr(neardup, "SHARE", 7)
    monkeypatch.setattr(neardup, "LIST", listed)  # longer lists get leaders of their own
    want = near_brute(prose, size, percent)
    rows = neardup.near_duplicates(documents(prose + [(None, prose[0][1])]), size, percent).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert len(set(want.values())) < len(want)


def test_compared_pairs_grow_with_the_rows(documents, monkeypatch):
    """Edited copies of one text around the threshold: pairs compared per copy stay level."""
    compare, pairs = neardup.compare, []
    monkeypatch.setattr(neardup, "compare", lambda p, *rest: pairs.append(p.count()) or compare(p, *rest))
    per_copy = []
    for n in (300, 1200):
        draw = random.Random(12)
        base = [f"b{k}" for k in range(150)]
        copies = []
        for k in range(n):
            words = list(base)
            for _ in range(draw.randrange(1, 12)):
                words[draw.randrange(150)] = f"e{draw.randrange(5000)}"
            copies.append((k, " ".join(words)))
        pairs.clear()
        rows = neardup.near_duplicates(documents(copies), 5, 80).collect()
        per_copy.append(sum(pairs) / n)
        if n == 300:
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near_brute(copies, 5, 80)
    assert per_copy[1] < 1.3 * per_copy[0] and max(per_copy) < 20, per_copy


def test_near_duplicates_of_repeated_rows_and_empty_table(documents):
    text = " ".join(f"v{k}" for k in range(25))
    rows = neardup.near_duplicates(documents([(3, text), (3, text), (8, text.upper())])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [
        (3, 3, True), (3, 3, True), (8, 3, False)
    ]
    assert neardup.near_duplicates(documents([])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}
