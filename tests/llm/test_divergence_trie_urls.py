"""Operators 11 to 13 against brute-force versions, on small tables with the awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.test_queries import SMALL, canonical

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# ---- 11


def brute_divergence(rows, least=3, top=200):
    """rows: (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall(lower(text or ""))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups.add((lang, source))
    out = Counter()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for g, s in groups if g == lang)

        def p(count, kept=kept):
            whole = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (whole + len(kept)) for t in kept}

        shares = {s: p(counts[lang, s]) for s in own}
        all_ = p(sum((counts[lang, s] for s in own), Counter()))
        f = lambda x, y: (x - y) ** 2 // y
        for s in own:
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, f(shares[s][t], all_[t])) for t in kept if counts[lang, s][t] and shares[s][t] > all_[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out.update((lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < top)
    return out


DOCS = "doc_id long, text string, lang string, source string, term string, count long, _k int, value long"


def divergence_rows():
    rng = random.Random(11)
    vocabulary = ["the", "The", "ÉTÉ", "été", "l'eau", "x1y", "字", "a\x00b", "𝔘n", "it's", "Z[z]", "naïve"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(None, None, None), ("", "en", "a"), (" .,;1234 ", "xx", "lone"), ("word", "xx", "other"), ("same same same", "en", None), ("\ud7ff\U0001f600 ok", "en", "a")]
    rows += [(" ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "b", "c", None])) for _ in range(150)]
    rows += [("the hot one " * 2000, "en", "a")] + [("copy of one text", "fr", "b")] * 5
    return rows


@pytest.mark.parametrize("top", [200, 4])
def test_divergence(spark, top):
    from threadloom.llm.divergence import divergence

    rows = divergence_rows()
    df = spark.createDataFrame([(i if i % 9 else None, t, lang, s, "x", 1, 2, 3) for i, (t, lang, s) in enumerate(rows)], DOCS).repartition(3)
    got = divergence(df, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got) == brute_divergence(rows, top=top)
    assert divergence(df.limit(0)).isEmpty()


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from threadloom.llm.divergence import share

    cases = [(10**13, 10**14, 10**7), (0, 0, 1), (2**40 + 1, 2**41, 3), (5, 0, 0)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select(share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // max(n + v, 1) for c, n, v in cases]


def test_texts_are_searched_once(spark):
    from threadloom.llm.divergence import counted

    texts = [".one two..", "one", "", None, "[]\x00", "Two\x00one@ÉTÉ"]
    df = spark.createDataFrame([(t, "en", "a") for t in texts], "text string, lang string, source string")
    got = counted(df)
    assert rows_of(got) == Counter({("en", "a", "one", 3, 3): 1, ("en", "a", "two", 2, 2): 1, ("en", "a", "ÉtÉ", 1, 1): 1})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"split\(|regexp_extract_all\(", plan)) == 1


def test_shares_where_64_bits_end(spark):
    from pyspark.sql import functions as F

    from threadloom.llm.divergence import PLAIN, share

    cases = [(c, n, v) for c in (PLAIN - 1, PLAIN, PLAIN + 1) for n, v in ((PLAIN + 1, 7), (10**17, 3))]
    got = spark.createDataFrame(cases, "c long, n long, v long").select(share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases]


# ---- 12


def brute_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    members, whole = defaultdict(list), {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(said.get(c - int(math.fmod(c, 5)), [])[:h] + said[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    saved, leaves = Counter(), Counter()
    for node, convs in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += not children[node]
    out = Counter()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if whole[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out[min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


TURNS = "conv_id long, turn long, role string, text string, node string, path string, depth long, bytes long"


def conversation_rows():
    rng = random.Random(12)
    phrases = ["", None, "hi", "Grüße", "x" * 3000, "ok", "no"]
    rows = [(None, 0, "user", "no conversation"), (7, None, None, None), (7, None, "user", "null turn"), (7, 3, "user", "late"), (10**15, 1, "user", "far"), (-7, 1, "user", "below"), (-5, 1, "user", "base below")]
    for c in range(20, 60):
        if c % 10 != 5:  # some bases are absent
            rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(phrases)) for t in range(rng.randrange(1, 12))]
    rows += [(c, 0, "user", "hot start") for c in range(100, 200)] + [(c, t, "user", f"deep {t}") for c in (300, 301, 302, 303) for t in range(70)]
    rows += [(304, t, "user", f"deep {t}" if t < 40 else "fork") for t in range(60)]
    return rows + rows[30:34]


@pytest.mark.parametrize("block", [2, 3, 16])
def test_prefix_trie(spark, block):
    from threadloom.llm.prefix_trie import conversation_trie

    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "n", "p", 1, 2) for r in rows], TURNS).repartition(5)
    got = conversation_trie(df, block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(got) == brute_trie(rows)
    if block == 16:
        assert conversation_trie(df.limit(0)).isEmpty()


def test_ends_in_several_strings(spark, monkeypatch):
    from threadloom.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "JOINED", 3)
    ids = [2, 10, 1, 30, 4, 5, 6, 7, 8, 9]
    df = spark.createDataFrame([(bytearray(b"a"), i) for i in ids] + [(bytearray(b"b"), 3)], "node binary, conv_id long").repartition(4)
    want = {b"a": ",".join(map(str, sorted(ids))), b"b": "3"}
    assert {bytes(r.node): r.ends_sha256 for r in prefix_trie.ends_hashed(df).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


# ---- 13


def brute_urls(rows, rules, rare=0.02, least=5, apart=1.96, weight=5.0, low=0.5, levels=8):
    """rows: (page_id, url)."""
    judged = []
    for page, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url[url.index("://") + 3 :]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = min(fit, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block")) if fit else None
        segments = re.sub(r"[0-9]+", "#", path[1:]).split("/", levels - 1)
        judged.append((page, host, path, best and best[0] + best[1], best and best[2], segments))
    of = ["" for _ in judged]
    for k in range(levels):
        below = defaultdict(lambda: defaultdict(list))
        for i, j in enumerate(judged):
            if len(j[5]) > k:
                below[j[1], of[i]][j[5][k]].append(i)
        for (_, template), children in below.items():
            whole = sum(map(len, children.values()))
            stay = {s: v for s, v in children.items() if len(v) >= least and len(v) >= rare * whole}
            stats = {s: (sum(judged[i][4] is not None for i in v), sum(judged[i][4] == "block" for i in v)) for s, v in stay.items()}
            groups, before = [], None
            for s in sorted((s for s in stay if stats[s][0]), key=lambda s: (stats[s][1] / stats[s][0], s.encode())):
                n, b = stats[s]
                if before:
                    pooled = (b + before[1]) / (n + before[0])
                    error = math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / before[0]))
                if not before or abs(b / n - before[1] / before[0]) > apart * error:
                    groups.append([])
                groups[-1].append(s)
                before = n, b
            groups += [[s] for s in stay if not stats[s][0]]
            name = {s: "|".join(sorted(g)) for g in groups for s in g}
            for s, v in children.items():
                for i in v:
                    of[i] = f"{template}/{name.get(s, '*')}"
    total, by_host, by_template = [0, 0], defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (_, host, _, _, verdict, _), template in zip(judged, of, strict=True):
        for counts in (total, by_host[host], by_template[host, template]):
            counts[0] += verdict is not None
            counts[1] += verdict == "block"
    share = total[1] / total[0] if total[0] else 0.0

    def found(host, template):
        n, b = by_template[host, template]
        of_host = (by_host[host][1] + weight * share) / (by_host[host][0] + weight)
        return "block" if n and 1 - (b + weight * of_host) / (n + weight) < low else "allow"

    return Counter((page, host, path, rule, verdict or found(host, t)) for (page, host, path, rule, verdict, _), t in zip(judged, of, strict=True))


PAGES = "page_id long, url string, html string, host string, path string, rule string, verdict string, shape string, template string"


def url_rows():
    rng = random.Random(13)
    urls = [None, "", "no scheme", "://", "http://", "HTTP://Example.NET", "http://example.net/en", "http://example.net/en/", "http://notexample.net/en/1", "http://A.Example.Com/de/1?x=/en/#y", "http://example.com/DE/1", "http://org/fr/", "http://x.org?/fr/", "http://x.org/fr/#", "a://b://c.net/", "http://ünï.net/é/", "http://u.com/" + "s/" * 500 + "é" * 20000, "http://h.com//\n/x"]
    for i in range(400):
        host = rng.choice(["hot.com", "hot.com", "hot.com", "b.example.com", "c.org", "d.net", "e.info"])
        urls.append(f"http://{host}/" + rng.choice([f"user/{rng.choice('abcdefgh')}{i}x{chr(97 + i % 26)}/posts/{i}", f"tag/t{i}", "en/1.html", "de/2", f"fr/{i}", f"spam/{i}", f"spam/deal{chr(97 + i % 26)}", "mixed/1", "mixed/x"]))
    return [(i if i % 11 else None, u) for i, u in enumerate(urls)] + [(3, urls[40])] * 3


@pytest.mark.parametrize("rare", [0.02, 0.2])
def test_urls(spark, rare):
    from threadloom.llm.url_filter import RULES, judge_urls

    rules = [*RULES, ("hot.com", "/spam/1", "block"), ("hot.com", "/spam/2", "block"), ("hot.com", "/spam/31", "allow"), ("hot.com", "/mixed/1", "block"), ("e.info", "/user/", "allow"), ("fo", "/user/", "block")]
    rows = url_rows()
    df = spark.createDataFrame([(*r, "h", "a", "b", "c", "d", "e", "f") for r in rows], PAGES).repartition(3)
    got = judge_urls(df, rules, rare=rare)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = brute_urls(rows, rules, rare=rare)
    assert rows_of(got) == want
    methods = Counter(v for _, _, _, rule, v in want.elements() if rule is None)
    assert methods["block"] > 3 and methods["allow"] > 100
    assert judge_urls(df.limit(0)).isEmpty() and judge_urls(df, []).filter("verdict = 'block'").isEmpty()


# ---- as registered


@pytest.mark.parametrize("name", ["op11_divergence", "op12_prefix_trie"])
def test_sql_agrees(spark, duck, name):
    from threadloom.llm import queries

    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got.fillna(-1)) == canonical(want.fillna(-1).astype(got.fillna(-1).dtypes.to_dict()))


def test_url_query_as_registered(spark):
    from threadloom.llm import queries
    from threadloom.llm.url_filter import RULES

    pages = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()]
    assert rows_of(queries.QUERIES["op13_url_filter"](spark, SMALL)) == brute_urls(pages, RULES)
