"""Alignment of two tokenizers against brute force."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from barloom.llm import align, queries
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
RANKS, JSON, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(JSON)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}


def sides(libraries, text):
    """((id, bytes) of a), (.. of b), by the libraries and their vocabularies."""
    first, second = libraries
    of = byte_of()
    a = [(i, bytes(of[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i in second.encode(text) for p in [second.id_to_piece(i)]]
    return a, b


def brute(libraries, text):
    """(n_a, n_b, groups, links) by comparing byte ranges."""
    if not text:
        return 0, 0, [], []
    a, b = sides(libraries, text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return 0, 0, [], []

    def ranges(tokens):
        at, out = 0, []
        for i, x in tokens:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    ra, rb = ranges(a), ranges(b)
    cuts = sorted({e for _, _, e in ra} & {e for _, _, e in rb})
    groups, start = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, _, e in r if start < e <= cut) for r in (ra, rb)))
        start = cut
    return len(a), len(b), groups, [(i, j) for i, s, e in ra for j, s2, e2 in rb if s < e2 and s2 < e]


def by_owner(libraries, text):
    """As `brute`, by the owners of each byte, for long texts."""
    if not text:
        return 0, 0, [], []
    a, b = sides(libraries, text)
    if any(b"".join(x for _, x in s) != (" " + text).encode() for s in (a, b)):
        return 0, 0, [], []
    owner = [[n for n, (_, x) in enumerate(s) for _ in x] for s in (a, b)]
    pairs = list(dict.fromkeys(zip(*owner, strict=True)))
    groups, held = [], ([], [])
    for n, (i, j) in enumerate(pairs):
        for side, token in zip(held, (i, j), strict=True):
            if not side or side[-1] != token:
                side.append(token)
        if n + 1 == len(pairs) or (pairs[n + 1][0] != i and pairs[n + 1][1] != j):
            groups.append("|".join(",".join(str(s[t][0]) for t in side) for s, side in zip((a, b), held, strict=True)))
            held = ([], [])
    return len(a), len(b), groups, [(a[i][0], b[j][0]) for i, j in pairs]


def expected(libraries, rows, one=brute):
    told = [(i, *one(libraries, t)) for i, t in rows]
    count = collections.Counter(x for *_, links in told for x in links)
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(i, a, b, len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha(g)) for i, a, b, g, links in told]


def digested(df):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


ODD = [(1, None), (1, ""), (2, "plain <|endoftext|> and </s>"), (2, "plain <|endoftext|> and </s>"), (None, "naïve 中文\U0001f600 🇩🇪"), (3, "has ▁ inside"), (4, "  two\n\n\tlines \r\n x123 4567"), (5, "\x00\x01é́"), (6, " "), (7, "don't won't " * 40)]


@pytest.mark.parametrize("known", [0, 7, 10_000])
def test_rows_equal_brute_force(spark, libraries, known):
    """Whatever share of the pairs is looked up and whatever is joined."""
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in ODD], "doc_id long, text string, pairs long, groups string, n bigint").repartition(3)
    rows = align.digest(align.align(docs, RANKS, public_tokenizers.PATTERN, MODEL))
    assert sorted(digested(align.with_counts(rows, known)), key=str) == sorted(expected(libraries, ODD), key=str)
    empty = align.with_counts(align.digest(align.align(docs.limit(0), RANKS, public_tokenizers.PATTERN, MODEL)), known)
    assert empty.count() == 0


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "word and " * 40_000), (2, "ab" * 100_000), (3, " " * 50_000)], "doc_id long, text string")
    for r in align.align(docs, RANKS, public_tokenizers.PATTERN, MODEL).collect():
        assert r.n_links == r.n_a + r.n_b - r.n_groups == sum(r.times) > 0


def test_first_side_equals_the_json_files_tokenizer(libraries, spark):
    own = align.BytePairs(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    some = ["".join(chr(rng.choice([rng.randint(0, 0x17F), rng.randint(0x2000, 0x33FF), 32, 32, 10])) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in [*some, *(r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect())]:
        assert own.encode(" " + text) == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_query_equals_brute_force(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = digested(queries.op13_alignment(spark, SF))
    assert sorted(found) == sorted(expected(libraries, docs, by_owner))
