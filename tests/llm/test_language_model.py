"""Operator 8's sampler where pairs are crowded, and its scores against a sampler that moves one customer at a time."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from threadloom.llm import language_model
from threadloom.llm.language_model import D0, D1, S0, S1, Part, Seating


def crowded_part(count):
    """A word with ``count`` customers in each of 16 contexts, and two words with fewer."""
    rng, contexts = np.random.default_rng(1), 16
    keys = np.array([w << 5 | k for w in range(3) for k in range(contexts)])
    counts = np.array([count] * 16 + list(rng.integers(1, 400, 32)))
    return Part(np.arange(3).astype(np.uint64), keys, counts, contexts, 0)


def sampled(count, seed, sweeps=4):
    """Mean tables of a crowded pair and the word's unigram probability after the sweeps."""
    part, rng = crowded_part(count), np.random.default_rng(seed)
    total = part.by_context(np.ones(len(part.keys)))
    seating = Seating.first(part, total, rng)
    for k in range(sweeps + 1):
        if k:
            seating.sweep(total, rng)
        assert (np.add.reduceat(seating.sizes, np.cumsum(seating.tables) - seating.tables) == seating.count).all() and (seating.sizes > 0).all()
        tables = part.tables(seating.tables)
        total = part.by_context(tables)
    return tables[part.word == 0].mean(), part.unigram(tables, total.sum())[0]


def test_crowded_pairs_sit_as_if_one_by_one(monkeypatch):
    """Blocks against one customer at a time, means of three chains each.

    One chain's tables deviate by 8 %, its probability by 0.018, so three standard errors of
    the difference are 0.2 and 0.045. Twelve chains each gave 544 and 537 tables (standard
    error of the difference 17), and 0.808 and 0.803 (0.007).
    """
    got = np.mean([sampled(2000, seed) for seed in range(3)], axis=0)
    monkeypatch.setattr(language_model, "ONE_BY_ONE", 10**9)
    want = np.mean([sampled(2000, seed) for seed in range(3)], axis=0)
    assert abs(got[0] / want[0] - 1) < 0.2 and abs(got[1] - want[1]) < 0.045


def test_twenty_thousand_customers():
    """Without a cap: thousands of tables; a hundred would make the word's probability a seventh."""
    tables, unigram = sampled(20_000, 1)
    assert 2500 < tables < 4500 and unigram > 0.9


def exact_scores(docs, sweeps=60, averaged=50):
    """Each text's log10 probability by Gibbs, one customer at a time; contexts are hashed as the operator's."""
    rng = random.Random(3)
    tokens = {i: (text or "").lower().split() + [""] for i, text in docs}
    hashed = lambda w: (xxhash.xxh64_intdigest(w.encode()) >> 20) % language_model.LEAST_CONTEXTS
    before = {i: [None, *map(hashed, own[:-1])] for i, own in tokens.items()}
    counts = Counter((w, u) for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w, u in zip(own, before[i], strict=True))
    sitting = {pair: [1] * n for pair, n in counts.items()}
    of_word, of_context, whole = Counter(), Counter(), 0
    for (w, u), t in sitting.items():
        of_word[w] += len(t)
        of_context[u] += len(t)
        whole += len(t)
    customers, vocabulary = Counter(), len(of_word)
    for (_, u), n in counts.items():
        customers[u] += n
    pairs = {p for i, own in tokens.items() for p in zip(own, before[i], strict=True)}
    chance = defaultdict(float)
    for k in range(sweeps):
        for (w, u), t in sitting.items():
            for _ in range(counts[w, u]):
                at = rng.choices(range(len(t)), t)[0]
                t[at] -= 1
                if not t[at]:
                    t.pop(at)
                    of_word[w] -= 1
                    of_context[u] -= 1
                    whole -= 1
                parent = (of_word[w] - D0 if of_word[w] else S0 + D0 * vocabulary) / (S0 + whole)
                at = rng.choices(range(len(t) + 1), [x - D1 for x in t] + [(S1 + D1 * of_context[u]) * parent])[0]
                if at < len(t):
                    t[at] += 1
                else:
                    t.append(1)
                    of_word[w] += 1
                    of_context[u] += 1
                    whole += 1
        if k >= sweeps - averaged:
            for w, u in pairs:
                parent = (of_word[w] - D0 if of_word[w] else S0 + D0 * vocabulary) / (S0 + whole)
                direct = counts[w, u] - D1 * len(sitting[w, u]) if (w, u) in counts else 0
                chance[w, u] += (direct + (S1 + D1 * of_context[u]) * parent) / (S1 + customers[u]) / averaged
    return {i: sum(math.log10(chance[p]) for p in zip(own, before[i], strict=True)) for i, own in tokens.items()}


def test_scores_against_an_exact_sampler(spark):
    from threadloom.llm.language_model import score

    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(30)], k=rng.randrange(5, 40)))) for i in range(60)]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(docs, "doc_id long, text string"), sweeps=24, averaged=20).collect()}
    want = exact_scores(docs)
    assert set(got) == set(want) and max(abs(got[i] / want[i] - 1) for i in want) < 0.03
    assert abs(sum(got.values()) / sum(want.values()) - 1) < 0.01
