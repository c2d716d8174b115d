"""op4, op7 and op10 as they are registered, over the whole smallest table, against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from tests.llm.test_operators import WORD, brute_substrings, lower
from tests.llm.test_queries import SMALL


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    from threadloom.llm.queries import QUERIES

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = QUERIES["op4_packing"](spark, SMALL).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert len(pieces) == len(texts)
    for i, text, _ in texts:
        ids, at = [*tok.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.02 * total / 4096 + 1


def test_simhash(spark, texts):
    from threadloom.llm.queries import QUERIES

    fps = []
    for i, text, _ in texts:
        words = WORD.findall(lower(text or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0))
    least = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, f in fps:
            low = min(least[j] for j, g in fps if (f ^ g).bit_count() <= 4)
            changed, least[i] = changed or low < least[i], low
    assert {tuple(r) for r in QUERIES["op7_simhash"](spark, SMALL).select("doc_id", "fingerprint", "component_id").collect()} == {(i, f"{f:016x}", least[i]) for i, f in fps}
    assert len(set(least.values())) < len(fps)


def test_substrings(spark, texts):
    from threadloom.llm.queries import QUERIES

    got = Counter(tuple(r) for r in QUERIES["op10_substrings"](spark, SMALL).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == Counter(brute_substrings(texts)) and sum(r[2] for r in got) > 0
