"""Operator 11 against both libraries on whole texts and all pairs of their tokens."""

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from levelscope.llm import alignment as A
from levelscope.llm.encoding import vocabulary

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


class Whole:
    """Texts encoded at once, and all pairs of overlapping tokens."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.alphabet = A.byte_alphabet()

    def tokens(self, text):
        """Ids and bytes of the tokens of both, or nothing."""
        if not text:
            return [], []
        own = (" " + text).encode()
        e = self.a.encode(" " + text, add_special_tokens=False)
        a = [(k, bytes(self.alphabet[c] for c in t)) for k, t in zip(e.ids, e.tokens, strict=True)]
        b = []
        for k in self.b.encode(text):
            p = self.b.id_to_piece(k)
            b.append((k, bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != own or b"".join(x for _, x in b) != own:
            return [], []
        return a, b

    def spans(self, tokens):
        at, out = 0, []
        for k, x in tokens:
            out.append((k, at, at + len(x)))
            at += len(x)
        return out

    def document(self, text):
        """n_a, n_b, groups as text and links."""
        a, b = map(self.spans, self.tokens(text))
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        sides = [[[] for _ in ends] for _ in range(2)]
        for side, tokens in zip(sides, (a, b), strict=True):
            for k, _, e in tokens:
                side[bisect_left(ends, e)].append(str(k))
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides, strict=True)]
        owners = [[n for n, (_, p, q) in enumerate(tokens) for _ in range(q - p)] for tokens in (a, b)]
        links = [(a[x][0], b[y][0]) for x, y in dict.fromkeys(zip(*owners, strict=True))]  # tokens that share a byte
        return len(a), len(b), groups, links


def expected(texts):
    whole = Whole()
    found = [whole.document(t) for t in texts]
    counts = Counter(x for *_, links in found for x in links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for n_a, n_b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def by_aligner(aligner, texts):
    columns = [c.to_pylist() for c in aligner.documents(pa.array(texts, pa.string()))]
    counts, highest = Counter(), Counter()
    for keys, times in zip(*columns[5:], strict=True):
        assert keys == sorted(set(keys))
        counts.update(dict(zip(keys, times, strict=True)))
    for key, n in counts.items():
        highest[key % (1 << A.B_BITS)] = max(highest[key % (1 << A.B_BITS)], n)
    best = [sum(t for k, t in zip(*x, strict=True) if counts[k] == highest[k % (1 << A.B_BITS)]) for x in zip(*columns[5:], strict=True)]
    sums = [sum(counts[k] * t for k, t in zip(*x, strict=True)) for x in zip(*columns[5:], strict=True)]
    return list(zip(*columns[:4], best, sums, columns[4], strict=True))


TEXTS = st.text(alphabet=st.sampled_from(list("ab0 'st\n\t  ́éΣ<|>漢1.\x1c▁\r\x00\U0001f600")), max_size=30)
HARD = ["a <|endoftext|> b", "<s> x </s>", "▁", "x ▁y", "<0x41> A", " lead", "trail ", "a\n\nb", "\nstart", "two  spaces", "naïve café 漢字 \U0001f600", "tab\there", "can't won't", "don 't", "9 99 999 9999"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS, st.sampled_from(HARD)), min_size=1, max_size=6))
def test_words_equal_whole_texts(texts):
    assert by_aligner(_own(), texts) == expected(texts)


def test_hard_texts_and_little_room():
    """Each alone, and all with room for next to nothing kept between slices."""
    for t in HARD:
        assert by_aligner(_own(), [t]) == expected([t]), t
    small = A.Aligner(*PATHS, most_bytes=2000)
    for _ in range(2):
        assert by_aligner(small, HARD) == expected(HARD)
    words = [f"w{k} unbelievably antidisestablishmentarianism{k}" for k in range(50)]
    for w in words:
        small.documents(pa.array([w]))
    assert len(small.known) < 60
    assert by_aligner(small, words) == expected(words)


def _own(made=[]):  # noqa: B006
    if not made:
        made.append(A.Aligner(*PATHS))
    return made[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60), min_size=1, max_size=12), st.sets(st.integers(1, 60), min_size=1, max_size=40)), min_size=1, max_size=6))
def test_gallop(pairs):
    pairs = [(sorted(x | {61}), sorted(y | {61})) for x, y in pairs]
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in pairs]
    short, long = (np.array([e for p in pairs for e in p[k]]) for k in (0, 1))
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    at, bt = np.cumsum(n) - n, np.cumsum(m) - m
    want = [b + int(np.searchsorted(y, e)) for (x, y), b in zip(pairs, bt.tolist(), strict=True) for e in x]
    assert A.gallop(short, at, n, long, bt, m).tolist() == want


@pytest.mark.parametrize("most_pairs", [A.MOST_PAIRS, 10])
def test_corpus(spark, corpus, texts, most_pairs):
    """Counts as arrays, and joined."""
    rows = A.align(corpus, *PATHS, most_pairs=most_pairs).collect()
    want = sorted(zip([str(d) for d, _ in texts], expected([t for _, t in texts]), strict=True))
    assert sorted((str(r["doc_id"]), tuple(r)[1:]) for r in rows) == want


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
