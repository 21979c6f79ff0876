"""Exact, line, near and substring deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tagloom.llm import exact, lines, near, simhash, suffix

LAST = 1 << 62


def order(i):
    return LAST if i is None else i


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_exact(docs, rows, no_docs):
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    for (i, t), n in zip(rows, norm):
        groups[n].append((-len(t or ""), order(i), i))
    expected = Counter()
    for (i, t), n in zip(rows, norm):
        less, _, keep = min(groups[n], key=lambda g: g[:2])
        kept = i == keep and len(t or "") == -less
        digest = hashlib.sha256(n.encode()).hexdigest()
        expected[(i, keep, len(groups[n]), kept, digest)] += 1
    assert rows_of(exact.exact_duplicates(docs)) == expected
    assert exact.exact_duplicates(no_docs).count() == 0


def test_exact_uses_no_python(docs):
    plan = exact.merge_runs(exact.digest_records(docs))[1]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_lines(rows):
    distinct = sorted({(order(i), xx(t), t) for i, t in rows if t is not None})
    seen, result = set(), {}
    for i, h, t in distinct:
        parts = t.split("\n")
        gone = set()
        for k in range(len(parts) - 2):
            window = tuple(parts[k : k + 3])
            if window in seen:
                gone.update((k, k + 1, k + 2))
            seen.add(window)
        result[(i, t)] = ("\n".join(p for k, p in enumerate(parts) if k not in gone), len(parts), len(gone))
    return result


def xx(text):
    """Spark's xxhash64 of a string, signed."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_lines(docs, rows, no_docs):
    found = brute_lines(rows)
    expected = Counter()
    for i, t in rows:
        kept, n, gone = found[(order(i), t)] if t is not None else (None, 0, 0)
        expected[(i, kept, n, gone)] += 1
    assert rows_of(lines.dedup_lines(docs)) == expected
    assert sum(k[3] for k in expected) > 0
    carried = lines.dedup_lines(docs, carry=True)
    assert {"lang", "source", "n_chars", "row_key"} <= set(carried.columns)
    assert lines.dedup_lines(no_docs).count() == 0


def brute_fingerprint(text, size=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]
    if not words:
        return 0
    k = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def test_simhash(docs, rows, no_docs):
    prints = [brute_fingerprint(t or "") for _, t in rows]
    component = brute_components(prints)
    smallest = defaultdict(lambda: LAST)
    for (i, _), p in zip(rows, prints):
        smallest[component[p]] = min(smallest[component[p]], order(i))
    expected = Counter()
    for (i, _), p in zip(rows, prints):
        least = smallest[component[p]]
        expected[(i, f"{p:016x}", None if least == LAST else least)] += 1
    assert rows_of(simhash.component_report(docs)) == expected
    assert simhash.component_report(no_docs).count() == 0


def test_near_pairs_lose_nothing(spark):
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(8):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                v ^= 1 << b
            values.add(v)
    signed = {int(np.uint64(v).view(np.int64)): v for v in values}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {(signed[r.src], signed[r.dst]) for r in simhash.near_pairs(df).collect()}
    found = {tuple(sorted(p)) for p in found}
    expected = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    assert found == expected and len(expected) > 100


def test_code_is_perfect():
    first, pattern, over = simhash.anchor_offsets(2)
    assert len(first) == 2049 and (np.diff(first) > 0).all()
    assert np.array_equal(np.add.reduceat(over == 0, first[:-1]), np.ones(2048))
    for s in (0, 5, 2047):
        assert len(set(pattern[first[s] : first[s + 1]] ^ pattern[first[s]])) == first[s + 1] - first[s]


def test_keep_one(docs, rows, no_docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    component = brute_components([brute_fingerprint(t or "") for _, t in rows])
    first = {}
    for i, t in rows:
        place = (order(i), xx(t) if t is not None else 42)
        group = component[brute_fingerprint(t or "")]
        if group not in first or place < first[group][0]:
            first[group] = (place, (i, t))
    assert rows_of(kept.select("doc_id", "text")) == Counter(r for _, r in first.values())
    assert simhash.keep_one(no_docs).count() == 0


def test_copy_links_grow_with_the_members(spark):
    """Mutually different edits of one text: links stay at most one per set and key."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    made = []
    for n in (100, 200):
        texts = []
        for i in range(n):
            copy = list(base)
            for at in rng.sample(range(len(copy)), 5):
                copy[at] = f"x{i}_{at}"
            texts.append(" ".join(copy))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        sketched = near.sketches(df)
        links = near.copy_links(sketched)
        made.append(links.count())
        assert made[-1] <= near.BANDS * n
        assert simhash.linked_components(links).select("component").distinct().count() <= n // 10
    assert made[1] <= 2.5 * made[0]


def test_keep_one_tells_components_apart(spark):
    texts = ["one two three four five", "red green blue black white", "north east south west here"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, "sun moon star sky rain")]
    prints = [brute_fingerprint(t) for _, t in rows]
    assert len(set(brute_components(prints).values())) == 4
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(kept) == Counter(set(rows))


def brute_repeats(rows, size=100):
    distinct = sorted({(order(i), xx(t) if t is not None else 42, t or "") for i, t in rows})
    seen, result = set(), {}
    for i, _, t in distinct:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - size + 1):
            if b[s : s + size] in seen:
                gone[s : s + size] = True
            seen.add(b[s : s + size])
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        result[(i, t)] = (len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest())
    return result


@pytest.mark.parametrize("share", [None, 0.0005])
def test_suffix(docs, rows, no_docs, share, monkeypatch):
    if share:  # treat many anchors as frequent
        real = suffix.frequent_anchors
        monkeypatch.setattr(suffix, "frequent_anchors", lambda d, _: real(d, share))
    found = brute_repeats(rows)
    expected = Counter((i, *found[(order(i), t or "")]) for i, t in rows)
    assert rows_of(suffix.repeat_report(docs)) == expected
    assert sum(k[2] for k in expected) > 0
    if not share:
        assert suffix.repeat_report(no_docs).count() == 0


def mutated(rng, base, alphabet):
    out = bytearray(base[rng.randint(0, 40) :])
    for _ in range(rng.randint(0, 3)):
        out[rng.randrange(len(out))] = rng.choice(alphabet + b"z")
    return bytes(out)


def test_matching_statistics_of_texts_that_are_not_in_the_index():
    rng = random.Random(1)
    for alphabet in [b"ab", b"abc", b"abcdefgh", bytes(range(256))] * 10:
        base = bytes(rng.choice(alphabet) for _ in range(rng.randint(100, 260)))
        indexed = [mutated(rng, base, alphabet) for _ in range(rng.randint(1, 4))] + [base[: rng.randint(1, 80)]]
        texts = [mutated(rng, base, alphabet), bytes(rng.choice(alphabet) for _ in range(130)), b"\xff\xfe" * 60, b""]
        lengths, begins = suffix.RunIndex(indexed).stream(texts)
        for text, begin in zip(texts, begins):
            longest = 0
            for i in reversed(range(len(text))):  # a match is at most one byte longer than the next one
                longest = min(longest + 1, suffix.LENGTH)
                while longest and not any(text[i : i + longest] in t for t in indexed):
                    longest -= 1
                assert lengths[begin + i] == longest


def test_indexed_texts_count_earlier_places_only():
    rng = random.Random(1)
    letters = bytes(rng.choice(b"abc") for _ in range(400))
    texts = [letters[:180], letters[40:260], b"ab" * 90, letters[100:230], b"ab" * 70, letters[:99]]
    lengths, begins = suffix.RunIndex(texts).stream(texts, np.arange(len(texts)))
    seen = set()
    for t, begin in zip(texts, begins):
        for s in range(len(t) - 99):
            assert (lengths[begin + s] == suffix.LENGTH) == (t[s : s + 100] in seen)
            seen.add(t[s : s + 100])


def test_rounds_find_every_later_window(monkeypatch):
    rng = random.Random(3)
    sizes = []
    real = suffix.RunIndex.__init__
    monkeypatch.setattr(suffix.RunIndex, "__init__", lambda self, t: (sizes.append((sum(map(len, t)), len(t))), real(self, t))[1])
    for _ in range(120):
        alphabet = rng.choice([b"ab", b"abcd", b"abcdefghij "])
        anchors, texts = [], []
        for group in range(rng.randint(1, 4)):
            base = bytes(rng.choice(alphabet) for _ in range(rng.randint(120, 300)))
            for _ in range(rng.randint(1, 6)):
                text = mutated(rng, base, alphabet) if rng.random() > 0.1 else base[:7] * 40
                text = text if len(text) >= 100 else text + bytes(rng.choice(alphabet) for _ in range(100))
                anchors.append(group)
                texts.append(bytes(x ^ group << 5 for x in text))  # windows of one anchor only
        limit = rng.choice([200, 500, 10_000])
        sizes.clear()
        found = Counter()
        for owner, offset, n in suffix.later_windows(np.array(anchors), np.ones(len(texts), bool), texts, limit):
            found.update((int(o), int(a) + i) for o, a, k in zip(owner, offset, n) for i in range(k))
        seen, expected = {}, Counter()
        for i, text in enumerate(texts):
            own = seen.setdefault(anchors[i], set())
            for j in range(len(text) - 99):
                expected[(i, j)] += text[j : j + 100] in own
                own.add(text[j : j + 100])
        assert found == +expected
        assert all(size <= limit or n < 6 for size, n in sizes)


def test_long_text_in_portions(monkeypatch, spark):
    monkeypatch.setattr(suffix, "CUT_BYTES", 700)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    data = [(1, text), (2, text[500:2500]), (3, "q" * 150)]
    expected = brute_repeats(data)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeat_report(df).collect()}
    assert got == {i: expected[(i, t)] for i, t in data}
