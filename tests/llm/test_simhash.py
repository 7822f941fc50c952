import random
import re

import xxhash

from tests.llm.helpers import docs, prose, with_clashes
from tidewright.llm import simhash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values):
    group = {v: v for v in values}

    def top(v):
        while group[v] != v:
            v = group[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {v: top(v) for v in values}


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (0, 1, 2, 3, 4, 50, 500)] + [None, "", " \t\x0b", "ÉA b C", "x\x1cy z\xa0w", "a a a a a a"]
    for t in texts:
        assert simhash.fingerprint(t) % (1 << 64) == brute_fingerprint(t)


def test_long_texts_in_slices(monkeypatch):
    text = prose(random.Random(2), 777)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 10)
    assert simhash.fingerprint(text) == whole


def test_links_connect_exactly_the_close(spark):
    from tidewright.operators.components import connected_components

    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63, 3 << 62, 7 << 61}
    for centre in [rng.getrandbits(64) for _ in range(6)]:
        near = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)}
        values |= near
    for _ in range(30):  # chains
        v = rng.getrandbits(64)
        for _ in range(5):
            values.add(v)
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    truth = brute_groups(values)
    sizes = {}
    for v, g in truth.items():
        sizes.setdefault(g, set()).add(signed(v))
    want = {frozenset(s) for s in sizes.values() if len(s) > 1}
    for direct in (2, 16, 1000):
        links = simhash.close_links(df, direct=direct)
        got = {}
        for r in connected_components(links, "a", "b").collect():
            got.setdefault(r["component"], set()).add(r["node"])
        assert {frozenset(s) for s in got.values()} == want


def test_table_cases(spark):
    base = prose(random.Random(4), 400)
    near = base.rsplit(" ", 1)[0] + " changed"
    texts = [base, None, near, "", base, "other words here now", base, None]
    ids = [5, 4, 3, 9, 2, 8, None, None]
    df = with_clashes(docs(spark, texts, ids=ids))
    rows = simhash.near_duplicates(df).collect()
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in rows)
    linked = (brute_fingerprint(base) ^ brute_fingerprint(near)).bit_count() <= 2
    assert linked and got == [(-1, 2), (-1, 4), (2, 2), (3, 2), (4, 4), (5, 2), (8, 8), (9, 4)]
    left = simhash.first_of_each_group(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 4, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.first_of_each_group(df.limit(0)).count() == 0


def test_ids_that_repeat(spark):
    rng = random.Random(5)
    a, b = prose(rng, 50), prose(rng, 50)
    left = simhash.first_of_each_group(docs(spark, [a, b, b, a, a], ids=[1, 1, 2, 1, 3])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == sorted([(1, a), (1, b)])
    nulls = simhash.first_of_each_group(docs(spark, [a, a, b], ids=[None, None, None])).collect()
    assert sorted(r["text"] for r in nulls) == sorted([a, b])


def test_query_equals_brute_force(spark, sf):
    from tidewright.llm.queries import op9_simhash_near_duplicates

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    groups = brute_groups(set(fps.values()))
    least = {}
    for d, f in fps.items():
        least[groups[f]] = min(d, least.get(groups[f], d))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op9_simhash_near_duplicates(spark, sf).collect()}
    assert got == {d: (f"{f:016x}", least[groups[f]]) for d, f in fps.items()}


def test_similar_texts_by_brute_force(spark):
    """Five-word shingles at 0.8: kept rows against all pairs, on altered copies and odd texts."""
    import random

    rng = random.Random(9)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    texts += [None, "", "  ", "two words", "two words", "w1 " * 20_000]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    near = []
    for i in range(len(sets)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or both >= 0.8 * either:
                a, b = sorted((top(i), top(j)))
                group[b] = a
            near.append(both / either if either else 1.0)
    want = {i for i in range(len(texts)) if top(i) == i}
    df = with_clashes(docs(spark, texts))
    got = simhash.first_of_similar(df)
    assert got.columns == df.columns
    kept = {r["doc_id"] for r in got.collect()}
    assert want <= kept and len(kept - want) <= 1
    assert simhash.first_of_similar(df.limit(0)).count() == 0


def test_crowded_files_are_divided(spark):
    """More copies than a cell holds still end as one."""
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(0, 300, 2)]
    assert simhash.first_of_similar(docs(spark, texts)).count() == 1


def links_of(spark, texts, recall=0.9, cell=simhash.CELL):
    """Links that the operator finds, as pairs of places in texts (which all differ)."""
    import numpy as np
    import xxhash

    bits, blocks = simhash.plan_blocks(len(texts), 0.8, recall)
    sets = [simhash.shingle_set(t, 5, 42) for t in texts]
    name = [int.from_bytes(xxhash.xxh64_digest(s.astype("<u8").tobytes(), 42), "little", signed=True) for s in sets]
    rows = [(m, len(s), simhash.wide_fingerprint(s, bits, blocks)) for m, s in zip(name, sets, strict=True)]
    values = spark.createDataFrame(rows, "same long, n int, fp array<int>").persist()
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = spark.createDataFrame([(m, i) for i, m in enumerate(name)], "same long, _id long").join(plain.selectExpr("doc_id AS _id", "xxhash64(text) AS _mark"), "_id")
    place = {m: i for i, m in enumerate(name)}
    links = simhash.similar_links(values, (plain, at), 0.8, bits, blocks, 5, 42, cell=cell).collect()
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    values.unpersist()
    return [(place[r["a"]], place[r["b"]]) for r in links], alike


def crowd(rng, base, copies, changes, words):
    for _ in range(copies):
        w = list(base)
        for at in rng.sample(range(len(w)), changes):
            w[at] = f"y{rng.randrange(words)}"
        yield " ".join(w)


def grouped(n, links):
    group = list(range(n))

    def top(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, j in links:
        group[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(n)]


def test_crowd_of_copies_that_are_near_one_text_only(spark):
    """600 copies that are similar to their base and not to one another, among unlike texts."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [*crowd(rng, base, 300, 7, 10**6), " ".join(base), *crowd(rng, base, 300, 7, 10**6)]
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))) for _ in range(3000)]
    links, alike = links_of(spark, texts)
    assert all(alike(i, j) for i, j in links)
    want = [i for i in range(601) if i != 300 and alike(i, 300)]
    group = grouped(len(texts), links)
    assert len(want) > 590 and sum(group[i] == group[300] for i in want) >= 0.9 * len(want)


def test_links_in_crowds_of_several_bases(spark):
    """Every pair that is similar ends in one group for at least 0.9 of pairs, none that is not,
    where files are cut into many cells."""
    rng = random.Random(12)
    first = [f"w{rng.randrange(5000)}" for _ in range(300)]
    bases = [first, *(t.split() for t in crowd(rng, first, 5, 11, 10**6))]
    texts = list(dict.fromkeys(t for b in bases for t in [" ".join(b), *crowd(rng, b, 40, 4, 10**6)]))
    links, alike = links_of(spark, texts, cell=16)
    assert all(alike(i, j) for i, j in links)
    group = grouped(len(texts), links)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(i, j)]
    assert len(pairs) > 200 and sum(group[i] == group[j] for i, j in pairs) >= 0.9 * len(pairs)
