"""Each operator against a brute-force version, on small tables with the awkward rows: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, _id long, _hash long, fp long, spans string, part int, block string, target double"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def awkward():
    """(doc_id, text, source) rows."""
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = words(30), words(120)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "two words", "b"), (6, " ".join(words(3000)), "c")]
    rows += [(10 + i, " ".join(base), "hot") for i in range(30)]
    for i in range(20):
        near = list(base)
        near[rng.randrange(120)] = f"x{i}"
        rows.append((50 + i, " ".join(near), "hot"))
    rows += [(80 + i, " ".join(words(rng.randrange(5, 60)) + passage + words(5)), rng.choice("abcd")) for i in range(15)]
    rows += [(100 + i, "\n".join(" ".join(words(rng.randrange(1, 30))) for _ in range(3)), rng.choice("abcde") if i % 6 else None) for i in range(60)]
    rows += [(200, " ".join(passage * 3), "z"), (201, " nbsp words <s> <|endoftext|> ▁x  y", "z"), (None, "no id at all", "z")]
    rows += [(100, rows[-63][1], rows[-63][2])] if rows[-63][0] == 100 else []
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, 3, 1, 2, 3, "x", 0, "b", 1.0) for i, t, s in rows], SCHEMA)
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_sharding(docs, empty, rows):
    from threadloom.llm.sharding import shard

    got = collect(shard(docs, shards=4))
    assert len(got) == len(rows) and shard(empty).isEmpty()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 4
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, got)) == sorted(map(str, collect(shard(docs.repartition(2), shards=4))))


def test_sharding_balances_and_keeps_groups(spark):
    from threadloom.llm.sharding import shard

    rng = random.Random(1)
    texts = ["hot " * 50] * 300 + [f"{i} " * rng.randrange(20, 90) for i in range(600)] + [f"pair{i} " * 9 for i in range(50) for _ in (0, 1)]
    got = collect(shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=8))
    size, of = Counter(), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        of[texts[r["doc_id"]]].add(r["shard"])
    assert max(size.values()) <= 1.03 * min(size.values()) and len(size) == 8
    share = sum(size.values()) / 8
    assert all(len(s) == 1 for t, s in of.items() if texts.count(t) * (len(t) + 16) < share)


def test_best_fit_by_tree_is_best_fit():
    from threadloom.llm.sharding import best_fit_decreasing

    rng = random.Random(2)
    units = [(rng.randrange(1, 120), i) for i in range(300)]
    placed, bins = best_fit_decreasing(units, 128)
    rooms, want = [], {}
    for size, unit in sorted(units, key=lambda u: (-u[0], u[1])):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= size]
        if not fits:
            rooms.append(128)
            fits = [(128, len(rooms) - 1)]
        k = min(fits)[1]
        rooms[k] -= size
        want[unit] = k
    assert placed == want and bins == len(rooms)


def test_token_counts(docs, empty, rows):
    import sentencepiece

    from threadloom.llm.token_counts import Lengths, frequent_lengths, token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in collect(token_counts(docs)))
    assert got == Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, _ in rows)
    assert token_counts(empty).isEmpty()
    known = Lengths(model, frequent_lengths(path))
    for text in ("  x", "x ", "x  ", " ", "   ", "a  b   c ", "a▁ b", "▁", "\t \n x", "é　y ", "x" * 300):
        assert known.count(text) == len(model.encode(text)), repr(text)


def brute_mix(rows, weights=(5, 2, 1), repeats=3):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total, of = sum(size), Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        of[s] += n
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        rest = total - sum(repeats * of[s] for s in capped)
        share = rest / max(1, sum(weight[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and weight[s] * share > repeats * of[s]}
        if not over:
            return size, of, {s: repeats * of[s] if s in capped else weight[s] * share for s in names}, target
        capped |= over


def test_mixing(spark, docs, empty, rows):
    from threadloom.llm.mixing import mix, repeated

    got = collect(mix(docs))
    size, of, target, _ = brute_mix(rows)
    assert len(got) == len(rows) and mix(empty).isEmpty()
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == of[s] and math.isclose(r["target"], target[s], rel_tol=1e-9)
        assert r["taken"] == 0 if r["size"] == 0 else r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, n) for (i, _, _), n in zip(rows, size, strict=True))
    longest = {s: max(n for (_, _, x), n in zip(rows, size, strict=True) if x == s) for s in of}
    assert all(abs(taken[s] - target[s]) <= 2 * longest[s] for s in of) and sum(taken.values()) <= sum(size)
    assert sorted(map(str, got)) == sorted(map(str, collect(mix(docs.repartition(2)))))
    again = repeated(docs)
    twins = spark.createDataFrame([(1, "a b c", "x", "s", 3), (1, "a b c", "y", "s", 3), (1, "a b c", "x", "s", 3), (1, "a b c", "x", "t", 3), (2, "d", "x", "t", 1), (None, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars int")
    got_twins, sum_of = Counter((r["doc_id"], r["lang"], r["source"]) for r in repeated(twins).collect()), sum(r["taken"] for r in mix(twins).collect())
    assert sum(3 if i == 1 else 1 for i, *_ in got_twins.elements()) == sum_of and got_twins[1, "x", "s"] <= 6 and got_twins[1, "y", "s"] <= 3 and got_twins[1, "x", "t"] <= 3
    assert abs(got_twins[1, "x", "s"] - 2 * got_twins[1, "y", "s"]) <= 2
    assert again.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in collect(again)) == sum(taken.values())


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    from threadloom.llm.packing import pack

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = collect(pack(docs, length=512))
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for i, each in ids.items():
        want = [(a, len(x[a : a + 512]), zlib.crc32(np.array(x[a : a + 512], "<u4").tobytes()), len(x)) for x in each for a in range(0, len(x), 512)]
        assert sorted(pieces[i]) == sorted(want), i
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r["length"] for r in got)
    assert len(sequences) <= 1.1 * total / 512 + 2 and pack(empty).isEmpty()


def test_cutting_stock_covers_demand_and_nears_the_bound():
    from threadloom.llm.packing import cutting_stock

    rng = np.random.default_rng(3)
    demand = rng.integers(0, 300, 64)
    plan = cutting_stock(demand)
    assert (sum(np.array(use) * times for use, times in plan) == demand).all()
    assert all((np.array(use) * np.arange(1, 65)).sum() <= 64 for use, _ in plan)
    rooms = Counter()  # first fit decreasing, by room
    for size in range(64, 0, -1):
        for _ in range(demand[size - 1]):
            room = min((r for r in rooms if r >= size and rooms[r]), default=64)
            rooms[room] -= room != 64 or rooms[64] > 0
            rooms[room - size] += 1
    assert sum(times for _, times in plan) <= sum(rooms.values())
    demand[32:] = 0
    assert sum(times for _, times in cutting_stock(demand)) <= (demand * np.arange(1, 65)).sum() / 64 * 1.002 + 8
    assert cutting_stock(np.zeros(64, int)) == []


def test_quality(spark, docs, empty):
    from threadloom.llm.quality import judge

    rng = random.Random(9)
    good = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.choice('xyz')}{rng.randrange(40)}" for _ in range(n))
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = " ".join("junk%%%" if rng.random() < 0.7 else good(1) for _ in range(40)) if bad else good(60)
        rows.append((i, f"{text} vermin {good(4)} filth" if toxic else text, "en", f"s{i % 9}"))
        labels.append((i, int(not bad), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    truth = spark.createDataFrame(labels[:400] + [(5, None, 1), (None, 1, 0), labels[3]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in collect(judge(df, truth))}
    assert len(got) == 600
    wrong = [i for i in range(400, 600) if got[i]["keep"] != (i % 5 != 0 and i % 7 != 0)]
    assert len(wrong) <= 2
    assert all(0 <= r["p_quality"] <= 1 and 0 <= r["path_toxic"] <= 1 for r in got.values())
    for n in (1, 3, 7):  # labels of a text or an id that contradict each other, and any partitions
        again = {r["doc_id"]: r for r in collect(judge(df.repartition(n), truth.repartition(n)))}
        assert again == got
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert judge(empty, truth).isEmpty()
    assert all(r["keep"] for r in collect(judge(docs, none))) and judge(docs, truth).count() == docs.count()


def test_sparse_sites_shrink_toward_the_global_rate(spark):
    from threadloom.llm.quality import judge

    rows = [(i, f"text {i}", "en", "big" if i < 300 else f"tiny{i}") for i in range(320)]
    truth = [(i, int(i % 3 > 0 and i < 300), 0) for i in range(320)]
    got = {r["doc_id"]: r for r in collect(judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(truth, "doc_id long, quality int, toxic int")))}
    mean = sum(q for _, q, _ in truth) / 320
    assert all(abs(got[i]["path_quality"] - mean) < 0.05 for i in range(300, 320))


def brute_top_k(rows, every, k):
    ok = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, q in set(ok):
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for j, v in ok if (j is None or j != i) and len(v) == len(q))
            out.update((i, n, None if none else j, -s) for n, (s, none, j) in enumerate(found[:k], 1))
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_top_k(spark, monkeypatch, scaled):
    from threadloom.llm import top_k as module

    monkeypatch.setattr(module, "BUCKET_ROWS", 50)
    monkeypatch.setattr(module, "PART_ROWS", 40)
    monkeypatch.setattr(module, "HEADS", 60)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8)) * (rng.lognormal(0, 1, (300, 1)) if scaled else 1)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(400 + i, rows[7][1]) for i in range(40)] + [(500, None), (510, [1.0, None] + [0.0] * 6), (520, [float("nan")] * 8), (530, [float("inf")] * 8), (540, [0.0] * 8), (600, [1.0, 2.0]), (601, [3.0, 1.0]), (None, rows[3][1]), (None, rows[3][1]), rows[5], rows[8], rows[8], rows[20], rows[120]]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, q string, norm double")
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collect(module.top_k(df, every=10, k=7)))
    assert got == brute_top_k(rows, 10, 7)
    assert module.top_k(df.limit(0)).isEmpty()


def test_simhash(docs, empty, rows, monkeypatch):
    from threadloom.llm.simhash import near_dedup, one_of_each

    def fingerprint(text):
        words = WORD.findall(lower(text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    fps = [(i, fingerprint(t)) for i, t, _ in rows]
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        least[root(k)] = min((x for x in (least.get(root(k)), i) if x is not None), default=None)
    want = Counter((i, f"{f:016x}", least[root(k)]) for k, (i, f) in enumerate(fps))
    for hot in (20_000, 3):
        got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in collect(near_dedup(docs, hot=hot)))
        assert got == want, hot
    left = collect(one_of_each(docs))
    assert len(left) == len({root(k) for k in range(len(fps))}) and near_dedup(empty).isEmpty()
    assert set(left[0]) == set(docs.columns)


def test_links_match_all_pairs_when_hot_keys_are_dealt_again(spark):
    from threadloom.llm.simhash import Forest, links

    rng = np.random.default_rng(0)
    points = set(rng.integers(0, 2**63, 20).tolist())
    for center in list(points)[:3]:
        for _ in range(150):
            x = center
            for bit in rng.integers(0, 63, rng.integers(1, 7)).tolist():
                x ^= 1 << bit
            points.add(x)
    fp = np.array(sorted(points), np.int64)
    want = Forest(len(fp))
    for k in range(len(fp)):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[k]) <= 4)
        want.unite(np.full(len(near), k), near)
    place = {x: i for i, x in enumerate(fp.tolist())}
    for hot in (20, 20_000):
        found = links(spark.createDataFrame([(x,) for x in fp.tolist()], "fp long"), 4, hot).collect()
        got = Forest(len(fp))
        got.unite(np.array([place[r["a"]] for r in found]), np.array([place[r["b"]] for r in found]))
        assert (got.root(np.arange(len(fp))) == want.root(np.arange(len(fp)))).all()


def test_components(spark):
    from threadloom.llm.components import components

    chain = [(i, i + 1) for i in range(60)] + [(200, 101), (101, 150), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 101: 101, 150: 101, 200: 101}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_language_model(docs, empty, rows):
    from threadloom.llm.language_model import held_out, score

    tokens = [(i, [*WORD.findall(lower(t or "")), None]) for i, t, _ in rows]
    counts = Counter()
    for i, own in tokens:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i or 0, len(own), sum(x in counts for x in own), round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), 6)) for i, own in tokens))
    got = collect(score(docs))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["held_out"] == held_out(r["doc_id"]) and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    again = {(r["doc_id"], r["n_tokens"]): r["score"] for r in collect(score(docs))}
    assert all(math.isclose(again[r["doc_id"], r["n_tokens"]], r["score"]) for r in got) and score(empty).isEmpty()


def small_part():
    from threadloom.llm.language_model import Part

    contexts, shift = 1024, 11
    keys = np.array([0 << shift | 3, 0 << shift | 5, 1 << shift | 3, 2 << shift | 5])
    return Part(np.array([7, 8, 9], np.uint64), keys, np.array([40, 3, 5, 1]), contexts, 0)


def test_predictive_probabilities_add_up_to_one():
    from threadloom.llm.language_model import D0, D1, S0, S1, Seating

    part, rng = small_part(), np.random.default_rng(0)
    seating = Seating.first(part, part.by_context(np.ones(4)), rng)
    for _ in range(3):
        tables = part.tables(seating.tables)
        total, customers = part.by_context(tables), part.by_context(part.counts)
        assert (tables >= 1).all() and (tables <= part.counts).all() and len(seating.sizes) == seating.tables.sum()
        assert (np.add.reduceat(seating.sizes, np.cumsum(seating.tables) - seating.tables) == seating.count).all()
        unigram, unknown = part.unigram(tables, total.sum()), (S0 + D0 * 3) / (S0 + total.sum())
        for u in (3, 5, 1024):
            own = sum(part.counts[i] - D1 * tables[i] for i in range(4) if part.context[i] == u)
            assert math.isclose((own + (S1 + D1 * total[u]) * (unigram.sum() + unknown)) / (S1 + customers[u]), 1)
        seating = Seating.of(dict(zip(("part", "block", "words", "per_word", "contexts", "counts", "docs", "sizes"), seating.row(0), strict=True)))
        seating.sweep(total, rng)


def test_sweeps_sample_what_a_customer_by_customer_sampler_samples():
    from threadloom.llm.language_model import D0, D1, S0, S1, Seating

    part, rng = small_part(), random.Random(1)
    seating, other = Seating.first(part, part.by_context(np.ones(4)), np.random.default_rng(1)), np.random.default_rng(2)
    got = np.zeros(3)
    for k in range(4000):
        seating.sweep(part.by_context(part.tables(seating.tables)), other)
        got += seating.tables if k >= 200 else 0
    pairs = [(part.word[i], part.context[i], int(part.counts[i])) for i in part.several]
    tables = [[n] for *_, n in pairs]  # one by one, each given all others as they are
    want = np.zeros(3)
    for k in range(2000):
        for i, (w, u, n) in enumerate(pairs):
            for _ in range(n):
                at = rng.choices(range(len(tables[i])), tables[i])[0]
                tables[i][at] -= 1
                tables[i] = [x for x in tables[i] if x]
                of = lambda test: sum(len(t) for t, p in zip(tables, pairs, strict=True) if test(p))
                in_context, whole = of(lambda p: p[1] == u) + (u == 5), of(lambda p: True) + 1
                new = (S1 + D1 * in_context) * (of(lambda p: p[0] == w) - D0) / (S0 + whole)
                at = rng.choices(range(len(tables[i]) + 1), [x - D1 for x in tables[i]] + [new])[0]
                tables[i] = tables[i] + [1] if at == len(tables[i]) else [x + (j == at) for j, x in enumerate(tables[i])]
        want += [len(t) for t in tables] if k >= 200 else 0
    assert np.allclose(got / 3800, want / 1800, rtol=0.1)  # pairs that move at once see each other a step late


def brute_substrings(rows, width=20):
    words = [(2**63 - 1 if i is None else i, WORD.findall(t or "")) for i, t, _ in rows]
    first = {}
    for i, own in words:
        for s in range(len(own) - width + 1):
            key = tuple(own[s : s + width])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, own in words:
        gone = [False] * len(own)
        for s in range(len(own) - width + 1):
            if first[tuple(own[s : s + width])] < (i, s):
                gone[s : s + width] = [True] * width
        kept = [w for w, g in zip(own, gone, strict=True) if not g]
        out.append((i, len(own), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1_000_000, 900])
def test_substrings(docs, empty, rows, monkeypatch, block):
    from threadloom.llm import substrings

    monkeypatch.setattr(substrings, "BLOCK_WORDS", block)
    got = Counter((2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in collect(substrings.remove_repeats(docs)))
    assert got == Counter(brute_substrings(rows)) and substrings.remove_repeats(empty).isEmpty()
    of = defaultdict(list)
    for i, t, _ in rows:
        of[2**63 - 1 if i is None else i].append(WORD.findall(t or ""))
    found = collect(substrings.factors(docs))
    for r in found:  # a factor is what stands at its source, which is earlier
        for begin, n, source, place in np.array(r["factors"]).reshape(-1, 4).tolist():
            assert n >= 20 and (source, place) < (r["_id"], begin)
            assert any(a[begin : begin + n] == b[place : place + n] and len(a) >= begin + n for a in of[r["_id"]] for b in of[source])
    assert max(len(r["factors"]) for r in found) > 4
    cut = substrings.cut_repeats(docs)
    assert cut.columns == docs.columns
    kept = Counter(hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest() for r in collect(cut))
    assert kept == Counter(h for *_, h in brute_substrings(rows))


def wave(x, rate=11025, bits=16):
    import struct

    data = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes() if bits == 16 else ((np.clip(x, -1, 1) * 127) + 128).astype(np.uint8).tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * bits // 8, bits // 8, bits) + b"data" + struct.pack("<I", len(data)) + data


def tune(rng, notes, rate=11025):
    t = np.arange(int(0.4 * rate)) / rate
    return np.concatenate([0.4 * np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) + 0.2 * np.sin(2 * np.pi * 440 * 2 ** (n / 12) * t) for n in rng.integers(0, 24, notes)])


def test_media_alignment(spark):
    from threadloom.llm import media

    rng = np.random.default_rng(11)
    songs = [tune(rng, 30) for _ in range(4)]
    chroma = media.Chroma(shifts=4)
    noise = lambda x, s: x + s * rng.normal(size=len(x))
    recordings = [(1, wave(noise(np.concatenate([tune(rng, 12), songs[2], tune(rng, 5)]), 0.02))), (2, wave(tune(rng, 40))), (3, wave(songs[0])), (4, None), (5, b""), (6, b"RIFFxxxxWAVEjunk"), (7, wave(np.zeros(50_000))), (8, wave(songs[1][:2000])), (9, wave(noise(songs[3], 0.05)[20_000:], bits=8)), (None, wave(songs[0])), (3, wave(songs[0]))]
    df = spark.createDataFrame([(i, m, 0) for i, m in recordings], "id long, media binary, n_frames int")
    references = spark.createDataFrame([(k, wave(x)) for k, x in enumerate(songs)] + [(None, wave(songs[0])), (9, None), (10, b"bad")], "id long, media binary")
    for threshold in ("10MB", "-1"):  # references broadcast, and exchanged by integer
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = collect(media.fingerprint_and_align(df, references, chroma))
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert len(got) == len(recordings)
        match = {r["id"]: r["match_id"] for r in got}
        assert match == {1: 2, 2: None, 3: 0, 4: None, 5: None, 6: None, 7: None, 8: None, 9: 3, None: 0}
        first = next(r for r in got if r["id"] == 1)
        assert abs(first["match_offset"] - 12 * 0.4 * 11025 / chroma.hop) <= 1.5 and first["match_errors"] < 0.25
        frames = {r["id"]: r["n_frames"] for r in got}
        assert frames[4] == frames[5] == frames[6] == 0 and frames[8] == 1 and frames[3] > 80
    double = spark.createDataFrame([(1, wave(np.concatenate([songs[1], songs[3]])))], "id long, media binary")
    (row,) = collect(media.fingerprint_and_align(double, references, chroma))
    assert {m["id"] for m in row["matches"]} == {1, 3} and row["matches"][0]["id"] == row["match_id"]
    assert media.fingerprint_and_align(df.limit(0), references, chroma).isEmpty()
    assert media.fingerprint_and_align(df, references.limit(0), chroma).filter("match_id is not null").isEmpty()


def test_integral_image_filters_match_direct_sums():
    from threadloom.llm import media

    rng = np.random.default_rng(1)
    x = rng.normal(size=3000).astype(np.float32)
    chroma = media.TEXT
    ints, heard = media.integers(x, 8000, chroma)
    window, classes = media._tables(chroma.frame, 8000, chroma.low, chroma.high)
    frames = np.lib.stride_tricks.sliding_window_view(x, chroma.frame)[:: chroma.hop]
    folded = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * window)) ** 2 @ classes
    folded = folded / np.sqrt((folded**2).sum(1, keepdims=True))
    kind, y, h, x0, w = media.FILTERS[1]
    for i in (0, 5, 100):
        plus, minus = folded[i + x0 : i + x0 + w, y : y + h // 2].mean(), folded[i + x0 : i + x0 + w, y + h // 2 : y + h].mean()
        step = int(np.searchsorted(media.STEPS, np.log((plus + 0.01) / (minus + 0.01))))
        assert kind == 1 and (int(ints[i]) >> 28) & 3 == int(media.GRAY[step])
    assert heard.all()
