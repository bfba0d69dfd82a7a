"""Operators 1, 2, 6, 7, 8 and 10 against brute force and round trips."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from levelscope.llm import bin_packing, chat_format, components, kneser_ney, near_dedup, range_coder, token_binary
from levelscope.llm.common import new_path
from levelscope.llm.encoding import WordwiseEncoder, encoder, vocabulary
from levelscope.llm.token_counts import TokenCounts, count_tokens


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def tokenizer(request):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(request.param))
    t.encode_special_tokens = True
    return request.param, t


def ids(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


TEXTS = st.text(alphabet=st.sampled_from(list("ab0 'st\n\t  ́éΣ<|>漢1.\x1c")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS, st.sampled_from(["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>"])), max_size=8))
def test_wordwise_encoding_equals_whole(texts):
    """As ordinary text, with the library's defaults, and with next to nothing kept between slices."""
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        if name not in _made:
            plain, default = (Tokenizer.from_file(vocabulary(name)) for _ in range(2))
            plain.encode_special_tokens = True
            _made[name] = [(plain, encoder(vocabulary(name))), (default, WordwiseEncoder(vocabulary(name), special=True)), (plain, WordwiseEncoder(vocabulary(name), most_bytes=500))]
        for t, own in _made[name]:
            assert [np.frombuffer(x, "<u4").tolist() for x in own.many(texts)] == [ids(t, x) for x in texts]


def test_wordwise_encoding_of_many_words():
    """Pieces that go to the library together, with and without the separator in them."""
    from tokenizers import Tokenizer

    r = random.Random(5)
    words = ["".join(r.choice("abcdeé漢0.,'-") for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(400)) + r.choice(["", "\nnext line", "  two"]) for _ in range(20)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(vocabulary(name))
        assert [np.frombuffer(x, "<u4").tolist() for x in WordwiseEncoder(vocabulary(name)).many(texts)] == [ids(t, x) for x in texts]


def test_pieces_are_told_apart_by_their_bytes(monkeypatch):
    """Steady pieces go to the library without a separator; what a normalizer changes doesn't, and keeps its ids."""
    from tokenizers import Tokenizer

    pieces = ["Word", "\nline", "l'été,", "don\u2019t", "\u0130x", "\u212bngstrom", "e\u0301", "a\tb", "\u6f22", "x" * 300, "<|endoftext|>", "10", "\n\u0130", "\u0178\u017f"] * 9
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(vocabulary(name))
        t.encode_special_tokens = True
        own = WordwiseEncoder(vocabulary(name))
        sent = []
        monkeypatch.setattr(own, "_by_separator", lambda p, f=own._by_separator: sent.extend(p) or f(p))
        flat, lengths = own._of_pieces(pieces)
        ends = np.cumsum(lengths)
        assert [flat[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)] == [ids(t, p if p[0] == "\n" else " " + p) for p in pieces]
        assert set(sent) == {"\u0130x", "\u212bngstrom", "e\u0301", "a\tb", "\u6f22", "\n\u0130"}
        own.sizes[:] = 1  # bytes that don't fit: all go with separators, and their ids stay
        again, more = own._of_pieces(pieces)
        assert again.tolist() == flat.tolist() and more.tolist() == lengths.tolist() and len(sent) > len(pieces)


_made: dict = {}


def test_token_counts(spark, tmp_path):
    schema = "doc_id long, tokenizer string, op string, source string, lang string, n_tokens long, seq long"
    store = TokenCounts(spark, f"file://{tmp_path}/store")
    assert store.totals().count() == 0
    live: dict = {}
    r = random.Random(1)
    for b in range(4):
        rows = [(r.randrange(12) or None, "t", r.choice(["upsert", "upsert", "delete", None]), r.choice(["a", "b", None]), "en", r.choice([None, r.randrange(50)]), k) for k in range(20)]
        df = spark.createDataFrame(rows, schema)
        assert store.commit(f"b{b}", df) and not store.commit(f"b{b}", df)
        last: dict = {}
        for x in rows:
            if x[2]:
                last[x[0]] = x
        for d, x in last.items():
            live.pop(d, None)
            if x[2] == "upsert":
                live[d] = (x[3], x[4], x[5] or 0)
        want: Counter = Counter()
        docs: Counter = Counter()
        for s, lang, n in live.values():
            want[s, lang] += n
            docs[s, lang] += 1
        got = {(x["source"], x["lang"]): (x["n_docs"], x["n_tokens"]) for x in store.totals().collect()}
        assert got == {k: (docs[k], want[k]) for k in docs}
    assert store.commit("empty", spark.createDataFrame([], schema)) and len(store.batches()) == 5


def test_a_batch_lost_half_way_is_written_anew(spark, tmp_path):
    import shutil

    schema = "doc_id long, tokenizer string, op string, source string, lang string, n_tokens long, seq long, d_docs string"
    store = TokenCounts(spark, f"file://{tmp_path}/store")
    store.commit("one", spark.createDataFrame([(1, "t", "upsert", "a", "en", 5, 1, "x"), (2, "t", "upsert", "a", "en", 7, 1, "x")], schema))
    # of equal seq the largest by op, source, lang and count holds; clashing columns are ignored
    second = spark.createDataFrame([(1, "t", "upsert", "b", "en", 6, 2, "x"), (1, "t", "upsert", "b", "en", 9, 2, "x"), (1, "t", "delete", "z", "en", 0, 2, "x")], schema)
    assert store.commit("two", second)
    want = sorted(map(tuple, store.totals().collect()))
    shutil.rmtree(tmp_path / "store/rollup/two")
    assert store.batches() == ["one"] and store.commit("two", second) and not store.commit("two", second)
    assert sorted(map(tuple, store.totals().collect())) == want == [("a", "en", "t", 1, 7), ("b", "en", "t", 1, 9)]


def test_count_tokens(corpus, texts, tokenizer):
    name, t = tokenizer
    got = Counter((r["doc_id"], r["n_tokens"]) for r in count_tokens(corpus, vocabulary(name)).collect())
    assert got == Counter((d, len(ids(t, x))) for d, x in texts)


RECORDS = [
    {"id": 1, "turn": 0, "prompt": "hi <|im_end|> \\ <\\| \\\\"}, {"meta": {"conversation": 1, "turn": 1}, "output": {"text": "yes\n<|im_start|>assistant ok"}},
    {"id": 2, "instruction": "do", "input": "", "output": "done"}, {"id": 3, "conversations": [{"from": "odd\nrole<\\n", "value": None}, {"from": "assistant", "value": "é漢"}]},
    {"id": 4, "turn": 0, "messages": [{"role": "system", "content": "x" * 20_000}]}, {"id": 5, "prompt": "p", "completion": "c"},
]


def test_chat_format(spark):
    raw = [json.dumps(x) for x in RECORDS] + [None, "not json", "[1]", json.dumps({"other": 1})]
    df = spark.createDataFrame([(x, 1) for x in raw], "record string, turn int")
    turns = chat_format.to_turns(df)
    want = [(1, 0, "user", RECORDS[0]["prompt"]), (1, 1, "assistant", RECORDS[1]["output"]["text"]), (2, 0, "user", "do"), (2, 1, "assistant", "done"), (3, 0, "odd\nrole<\\n", ""), (3, 1, "assistant", "é漢"), (4, 0, "system", "x" * 20_000), (5, 0, "user", "p"), (5, 1, "assistant", "c")]
    assert sorted(map(tuple, turns.collect())) == want
    formatted = chat_format.format_turns(turns)
    for f in formatted.collect():
        assert f["formatted"].count("<|im_start|>") == 1 and f["formatted"].count("<|im_end|>") == 1
    back = chat_format.read_turns(formatted)
    assert sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in back.collect()) == want
    d = {r["conv_id"]: r for r in chat_format.digests(back).collect()}
    one = "".join(f"{r}\n{t}\n" for c, _, r, t in want if c == 1)
    assert d[1]["turns_sha256"] == hashlib.sha256(one.encode()).hexdigest() and d[1]["n_turns"] == 2
    assert d[1]["loss_sha256"] == hashlib.sha256(want[1][3].encode()).hexdigest() and d[4]["loss_chars"] == 0
    assert chat_format.unmapped(df).count() == 4 and chat_format.to_turns(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.read_turns(chat_format.format_turns(nulls))).first()["n_turns"] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 3)), max_size=60) | st.lists(st.integers(0, (1 << 32) - 1) | st.integers(65_530, 65_540), max_size=40), max_size=6))
def test_range_coder_round_trip(blocks):
    arrays = [np.array(b, np.uint32) for b in blocks]
    coded = range_coder.encode_blocks(arrays)
    assert [x.tolist() for x in range_coder.decode_blocks(coded)] == blocks
    assert [range_coder.decode_blocks([c])[0].tolist() for c in coded] == blocks


def test_range_coder_compresses_and_checks():
    coded = range_coder.encode_blocks([np.tile(np.arange(50, dtype=np.uint32), 80)])
    assert len(coded[0]) < 800
    for at in range(len(coded[0])):  # every byte of head and payload is checked before anything is decoded
        bad = bytearray(coded[0])
        bad[at] ^= 1
        with pytest.raises(range_coder.CorruptBlock):
            range_coder.decode_blocks([bytes(bad)])
    facts = range_coder.FACTS.pack(range_coder.MAGIC, 1, range_coder.MOST_IDS + 1, 0)
    with pytest.raises(range_coder.CorruptBlock):
        range_coder.decode_blocks([facts + zlib.crc32(facts).to_bytes(4, "little")])


def test_range_coder_uses_order_0():
    """Ids that neither context predicts cost less the more uneven they are."""
    r = np.random.default_rng(3)
    even, uneven = r.integers(0, 50_000, 4000).astype(np.uint32), (r.geometric(0.02, 4000) % 50_000).astype(np.uint32)
    sizes = [len(x) for x in range_coder.encode_blocks([even, uneven])]
    assert sizes[1] < 0.75 * sizes[0]


def test_range_coder_keeps_its_format():
    """Bytes of coded blocks of either width, as files on disk hold them; rows of digit frequencies get halved on the way."""
    r = np.random.default_rng(5)
    blocks = [(r.geometric(0.01, 4000) % 50_000).astype(np.uint32), np.zeros(3000, np.uint32), r.integers(0, 1 << 32, 50, np.uint32), np.tile(np.arange(40, dtype=np.uint32), 50)]
    coded = range_coder.encode_blocks(blocks)
    assert zlib.crc32(b"".join(coded)) == 1103937080
    assert all(np.array_equal(a, b) for a, b in zip(range_coder.decode_blocks(coded), blocks, strict=True))


def test_long_blocks_come_back_whole():
    """Of either width, with lanes of unlike length, carries through many units, and runs of one id."""
    r = np.random.default_rng(7)
    shapes = [range_coder.SHORT + 1, 5000, 16 * 320, 30_011]
    blocks = [(r.geometric(0.01, n) % 50_000).astype(np.uint32) for n in shapes] + [r.integers(0, 1 << 16, 9000, np.uint32), r.integers(0, 1 << 32, 9000, np.uint32)]
    blocks += [np.full(6000, x, np.uint32) for x in (0, 0xFFFF, 0xFFFFFFFF)] + [np.where(r.random(20_000) < 0.999, 0xFFFF, 3).astype(np.uint32), np.zeros(10, np.uint32)]
    blocks += [np.where(r.random(8000) < 0.5, r.integers(0, 1 << 32, 8000, np.uint32), np.uint32(7))]
    coded = range_coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) and a.dtype == np.uint32 for a, b in zip(range_coder.decode_blocks(coded), blocks, strict=True))
    assert [x[:4] for x in coded] == [range_coder.MAGIC if len(b) <= range_coder.SHORT else range_coder.LONG_MAGIC for b in blocks]
    for at in range(0, len(coded[0]), 37):
        bad = bytearray(coded[0])
        bad[at] ^= 1
        with pytest.raises(range_coder.CorruptBlock):
            range_coder.decode_blocks([bytes(bad)])


def test_long_blocks_keep_their_format():
    r = np.random.default_rng(5)
    blocks = [(r.geometric(0.01, 40_000) % 50_000).astype(np.uint32), np.tile(np.arange(40, dtype=np.uint32), 200), r.integers(0, 1 << 32, 5000, np.uint32)]
    assert zlib.crc32(b"".join(range_coder.encode_blocks(blocks))) == 322706747


def test_lanes_of_a_long_block_learn_together(monkeypatch):
    """A long block takes no more than some hundred steps, and fewer bytes than the same ids in blocks that learn alone."""
    from levelscope.llm import long_blocks

    r = np.random.default_rng(6)
    follows = r.integers(0, 3000, (3000, 4))
    ids = np.empty(60_000, np.uint32)
    ids[0] = 1
    for k, (a, b) in enumerate(zip(r.integers(0, 4, len(ids)), r.random(len(ids)), strict=True)):
        ids[k] = follows[ids[k - 1], a if b < 0.3 else 0]
    steps, settle = [], long_blocks._Encoder.end
    monkeypatch.setattr(long_blocks._Encoder, "end", lambda self, *x: steps.append(1) or settle(self, *x))
    long = len(range_coder.encode_blocks([ids])[0])
    assert 0 < len(steps) < 300
    assert long < 0.8 * sum(map(len, range_coder.encode_blocks(np.array_split(ids, 15))))
    # orders 2, 1 and 0 all count: shuffled, only order 0 is left; even, not even that
    shuffled = len(range_coder.encode_blocks([r.permutation(ids)])[0])
    assert long < 0.7 * shuffled


def test_blocks_of_like_length_are_coded_together(monkeypatch):
    """No task codes a few blocks at a time while it could code many, and long ones don't hold up short ones."""
    import pandas as pd

    r, lanes, runs = random.Random(4), 4, []
    lengths = [r.choice([5, 90]) for _ in range(22)]
    monkeypatch.setattr(range_coder, "encode_blocks", lambda blocks, f=range_coder.encode_blocks: runs.append([len(b) for b in blocks]) or f(blocks))
    texts = pd.DataFrame({"doc_id": range(22), "text": [" a" * n for n in lengths]})
    rows = pd.concat(token_binary.coded_blocks([texts], 0, vocabulary("byte_bpe_50k.json"), 2, block_ids=100, lanes=lanes))
    assert all(len(x) == lanes for x in runs[:-1]) and sum(max(x) for x in runs) < 1.3 * sum(max(x) for x in np.array_split(sorted(rows["n_ids"]), len(runs)))
    rows = rows.sort_values("block")
    assert rows["block"].tolist() == list(range(len(rows))) and rows["part_start"].tolist() == (rows["n_ids"].cumsum() - rows["n_ids"]).tolist()


def test_token_binary(spark, corpus, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    path = new_path(spark, "ids")
    token_binary.write_ids(corpus, path, vocabulary("byte_bpe_50k.json"), 2, block_ids=512, lanes=8)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["start"], bytes(r["ids"])) for r in token_binary.read_documents(spark, path).collect())
    at = 0
    for (doc_id, start, blob), (d, text) in zip(got, sorted(texts, key=lambda x: (-1 if x[0] is None else x[0], x[1] or "")), strict=True):
        want = np.array(ids(t, text) + [2], "<u4").tobytes()
        assert (doc_id, start, blob) == (-1 if d is None else d, at, want)
        at += len(want) // 4
    assert token_binary.written_and_read(corpus.limit(0), vocabulary("byte_bpe_50k.json"), 2).count() == 0


def test_token_binary_digests(spark, corpus):
    """Crc32 from the worker that decodes is that of the ids themselves, of split documents too."""
    path = new_path(spark, "ids")
    token_binary.write_ids(corpus, path, vocabulary("byte_bpe_50k.json"), 2, block_ids=512, lanes=8)
    ids = token_binary.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    got = token_binary.read_documents(spark, path, digests=True)
    assert got.columns == ids.columns and sorted(map(str, got.collect())) == sorted(map(str, ids.collect()))
    assert ids.where("n_tokens > 512").count() > 0 and ids.where("n_tokens < 512").count() > 0


def test_token_binary_decodes_a_block_once(spark, corpus):
    """Counted by the blocks that go to Python, over split and whole documents."""
    path = new_path(spark, "ids")
    token_binary.write_ids(corpus, path, vocabulary("byte_bpe_50k.json"), 2, block_ids=512, lanes=8)
    blocks, asked = spark.read.parquet(path), []
    read = token_binary.read_fragments
    token_binary.read_fragments = lambda s, p, having=None: asked.append(having) or read(s, p, having)
    try:
        n = token_binary.read_documents(spark, path).count()
    finally:
        token_binary.read_fragments = read
    each = [blocks.where(F.lit(True) if h is None else h).count() for h in asked]
    assert n == corpus.count() and sum(each) == blocks.count() and min(each) > 0


def linked(texts, size, percent):
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        if d is not None:
            sets.setdefault(d, []).append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    low = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    return low


def test_near_dedup(corpus, texts):
    for size, percent in ((3, 85), (5, 80)):
        want = linked(texts, size, percent)
        rows = near_dedup.near_duplicates(corpus, size, percent).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])
    kept = near_dedup.deduplicated(corpus)
    assert kept.columns == corpus.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*{linked(texts, 5, 80)[d] for d, _ in texts if d is not None}, None])


def test_near_dedup_mutated_family(spark):
    """Copies that drift apart, so that buckets hold linked and unlinked classes."""
    from .conftest import prose

    base, r, rows = prose(500, 150).split(), random.Random(3), []
    for k in range(60):
        w = list(base)
        for _ in range(k // 5):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == linked(rows, 3, 85)
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_near_dedup_repeated_doc_id_ties_its_classes(spark, monkeypatch, most):
    from .conftest import prose

    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", most)

    x, y, z = (prose(k, 60) for k in (700, 701, 702))
    rows = [(1, x), (5, x), (5, y), (2, y), (7, y), (7, z), (3, z), (9, prose(703, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == linked(rows, 5, 80) == {1: 1, 5: 1, 2: 1, 7: 1, 3: 1, 9: 9}
    assert sorted(r["doc_id"] for r in near_dedup.deduplicated(docs).collect()) == [1, 9]


def test_near_dedup_of_a_hidden_base(spark):
    """Copies of a text that isn't there itself, some past the threshold to all others and some with one another's changes."""
    from .conftest import prose

    base, r, rows = prose(900, 120).split(), random.Random(8), []
    changes = [(r.randrange(len(base)), f"seen{k}") for k in range(12)]
    for k in range(90):
        w = list(base)
        for at, word in r.sample(changes, r.randrange(1, 5)):
            w[at] = word
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"own{r.randrange(10**6)}"
        rows.append((k, " ".join(w[: r.choice([120, 120, 110])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(df, size, percent).collect()}
        assert got == linked(rows, size, percent)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(25)]
    low = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(low[n] == c for n, c in got.items()) and set(got) >= {n for a, b in edges if a != b for n in (a, b)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(1, 5)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(0, 30))
def test_fullest_is_the_best_sum(items, room):
    lengths, counts = [a for a, _ in items], [b for _, b in items]
    reach = {0}
    for a, n in items:
        reach = {x + a * k for x in reach for k in range(n + 1) if x + a * k <= room}
    chosen = bin_packing.fullest(lengths, counts, room)
    assert sum(lengths[k] * n for k, n in chosen) == max(reach) and all(n <= counts[k] for k, n in chosen)


def test_packing(spark, corpus, texts, tokenizer):
    name, t = tokenizer
    rows = bin_packing.pack_documents(corpus, vocabulary(name), 0, 512).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want: Counter = Counter()
    for d, text in texts:
        x = ids(t, text) + [0]
        want.update((d, k, k * 512, len(x[k * 512 : k * 512 + 512]), zlib.crc32(np.array(x[k * 512 : k * 512 + 512], "<u4").tobytes())) for k in range(math.ceil(len(x) / 512)))
    assert got == want
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / 512) + 2
    assert bin_packing.pack_documents(corpus.limit(0), vocabulary(name), 0).count() == 0


def test_kneser_ney(spark, corpus, texts):
    train = [(d, t) for d, t in texts if zlib.crc32(str(d if d is not None else "").encode()) % 5 != 1]
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    model = kneser_ney.train(corpus.where(~held))
    tok = [(t or "").encode().lower().split() + ["</s>"] for _, t in train]
    big, uni = Counter(), Counter()
    for w in tok:
        uni.update(w)
        big.update(zip(["<s>", *w[:-1]], w, strict=True))
    n_total, v = sum(uni.values()), len(uni)
    before = Counter(b for _, b in big)
    disc2 = kneser_ney.discounts(*[sum(x == k for x in big.values()) for k in (1, 2, 3, 4)])
    disc1 = kneser_ney.discounts(*[sum(x == k for x in before.values()) for k in (1, 2, 3, 4)])
    d = lambda t, c: t[min(c, 3) - 1] if c else 0.0
    after: dict = {}
    for (a, _), c in big.items():
        after.setdefault(a, []).append(c)
    spare = sum(d(disc1, c) for c in before.values()) / len(big)

    def p1(w):
        return max(before[w] - d(disc1, before[w]), 0) / len(big) + spare / (v + 1)

    def p2(a, w):
        if a not in after:
            return p1(w)
        total = sum(after[a])
        return max(big[a, w] - d(disc2, big[a, w]), 0) / total + sum(d(disc2, c) for c in after[a]) / total * p1(w)

    assert sum(p1(w) for w in uni) + p1("<unseen>") == pytest.approx(1) and sum(p2("the", w) for w in uni) + p2("the", "<unseen>") == pytest.approx(1)
    rows = Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in kneser_ney.score(corpus, model).collect())
    want: Counter = Counter()
    for doc_id, t in texts:
        w = (t or "").encode().lower().split() + ["</s>"]
        base = sum(math.log10((uni[x] + 0.5) / (n_total + 0.5 * (v + 1))) for x in w)
        want[doc_id, len(w), sum(x in uni for x in w), round(base, 5), round(sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)), 5)] += 1
    assert rows == want
    empty = kneser_ney.train(corpus.limit(0))
    assert kneser_ney.score(corpus, empty).where("n_known > 0").count() == 0
