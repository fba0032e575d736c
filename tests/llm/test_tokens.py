import random

import pytest

from fixwright.llm import tokens


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.vocabulary_file())


def expected(counter, texts):
    return [len(counter.library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_are_the_library_s(counter):
    rng = random.Random(7)
    pool = [*"aZ 1'sdtm\n\t\r  !?-_éßñ漢字١٢½Ⅷ　\xa0\x85​🙂👍🏽ǅª", "<|endoftext|>", "  ", "\n\n", "'ll", "'RE", " the", " of", "ing"]
    pool += [chr(c) for c in (rng.randrange(0x20, 0x30000) for _ in range(300)) if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert counter(texts) == expected(counter, texts)


def test_whole_tokens_are_proven(counter):
    some = sorted(counter.whole)[:: len(counter.whole) // 200]
    assert len(counter.whole) > 40_000 and expected(counter, some) == [1] * len(some)


def test_merge_loops_agree(counter):
    pieces = [" thntedtion", "Ærøskøbing", "zzzzzzzzq", "!!!???", " 1234567", "漢字漢"]
    assert counter.merge(pieces) == counter._by_library(pieces) and counter.merge.__name__ == "<lambda>"


def test_memory_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 2)
    texts = ["qwxz zxqw", "vvkq qkvv", "qwxz"]
    assert [counter([t])[0] for t in texts] == expected(counter, texts)


def test_operator_edge_cases(spark, counter):
    long = "many words and no end " * 40_000
    rows = [(1, "a b", 7), (1, "a b", 7), (2, "", 7), (3, None, 7), (None, "<|endoftext|>x", 7), (4, long, 7), (5, "w " * 513, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, N_TOKENS int")
    out = tokens.count(docs, tokens.vocabulary_file())
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()]
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(rows, expected(counter, [r[1] or "" for r in rows]), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokens.count(docs.limit(0), tokens.vocabulary_file()).count() == 0
