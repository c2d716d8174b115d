"""The pipeline's near-dedup against all pairs by exact 5-word Jaccard similarity."""

import random

from tests.llm.test_operators import SCHEMA, WORD, awkward, lower


def shingle_set(text):
    words = WORD.findall(lower(text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def least_of_each(rows):
    """The (doc_id, text) that stay: of each component the least id, null last."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    left = {}
    for k, (i, _) in enumerate(rows):
        left.setdefault(root(k), []).append(i)
    return sorted(str(min(ids, key=lambda i: (i is None, i))) for ids in left.values())


def edited():
    """Copies from light to heavy edits, chains of copies, and a passage that fills 70-90 % of otherwise different texts."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows = []
    for n in (6, 12, 40, 120, 900):
        for _ in range(6):
            base = words(n)
            rows.append(" ".join(base))
            for edits in (1, n // 40, n // 30, n // 20):
                near = list(base)
                for _ in range(edits):
                    near[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
                rows.append(" ".join(near))
    for _ in range(25):  # each like the one before, the ends unlike each other
        base = base[3:] + words(3) if len(base) == 60 else words(60)
        rows.append(" ".join(base))
    passage = words(100)
    rows += [" ".join(words(rng.randrange(2, 25)) + passage + words(rng.randrange(2, 25))).upper() for _ in range(40)]
    return [(1000 + i, t) for i, t in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 1, 7, 3, 1, 2, 3, "x", 0, "b", 1.0) for i, t in rows], SCHEMA).repartition(3)


def test_near_copies_against_all_pairs(spark):
    from threadloom.llm.near_copies import one_of_each_similar

    rows = [(i, t) for i, t, _ in awkward()] + edited()
    rows.append(rows[5])
    df, want = frame(spark, rows), least_of_each(rows)
    for small in (8, 2):
        left = one_of_each_similar(df, small)
        assert left.columns == df.columns
        assert sorted(str(r["doc_id"]) for r in left.select("doc_id").collect()) == want, small
    assert one_of_each_similar(df.limit(0)).isEmpty()


def test_stage_takes_near_copies_that_simhash_leaves(spark):
    import corpus_pipeline
    from threadloom.llm.simhash import one_of_each

    rows = [(i, t) for i, t in edited() if i < 1150]
    df, want = frame(spark, rows), least_of_each(rows)
    assert one_of_each(df).count() > len(want)
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()) == want


def test_the_cut_loses_three_pairs_in_a_hundred_million_at_most():
    """Exactly, for pairs of random sets just at the similarity: the chance that a bit differs, and that over RADIUS of 64 do."""
    from math import comb

    from threadloom.llm.near_copies import LEAST_CUT, PART, RADIUS, WHOLE

    def lost(both, x, y):
        of = lambda n: [comb(n, k) / 2**n for k in range(n + 1)]
        bit = 0.0
        for shared, p in enumerate(of(both)):
            a, b = (sum(q for k, q in enumerate(of(n)) if 2 * (shared + k) > both + n) for n in (x, y))
            bit += p * (a * (1 - b) + b * (1 - a))
        return sum(comb(64, k) * bit**k * (1 - bit) ** (64 - k) for k in range(RADIUS + 1, 65))

    worst = 0.0
    for small in (*range(LEAST_CUT, 60), 100, 200):
        for big in range(small, small * WHOLE // PART + 1):
            both = -(-(small + big) * PART // (WHOLE + PART))  # the fewest shared ones at the similarity
            if both <= small:
                worst = max(worst, lost(both, small - both, big - both))
    assert worst < 3e-8


def test_pairs_with_a_small_set_are_all_kept():
    import numpy as np

    from threadloom.llm.near_copies import LEAST_CUT, undiscarded
    from threadloom.llm.simhash import pivot_distances

    sim = np.array([0, -1, 0, -1], np.int64)  # 64 bits apart
    size = np.array([5, LEAST_CUT - 1, LEAST_CUT, LEAST_CUT])
    a, b = undiscarded(sim, pivot_distances(sim), size, np.array([0, 1, 2, 2]), np.array([1, 2, 3, 2]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (1, 2), (2, 2)]
