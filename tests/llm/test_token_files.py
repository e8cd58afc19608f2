import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from rebasis.llm import token_files as t


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(t.VOCABULARY))


def expected(rows, tokenizer):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out, start = [], 0
    for i, text, _ in order:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("shard_ids", [t.SHARD_IDS, 50])
def test_documents(frame, edge_rows, tokenizer, shard_ids):
    rows = edge_rows + [(100 + i, " ".join(f"w{k * k % (i + 2)}" for k in range(i)), "a") for i in range(200)]
    got = t.read_shards(t.write_shards(frame(rows), shard_ids=shard_ids))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert collect(got) == expected(rows, tokenizer)


def test_empty(frame):
    assert t.read_shards(t.write_shards(frame([]))).count() == 0


TEXTS = st.text(st.one_of(
    st.sampled_from(list("aAbzß É'sté.,!$%&|<>0٣ \t\n\x0b\x1c\x85\xa0́ﬁİΣς漢😀")), st.characters(exclude_categories=["Cs"])),
    max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_encoder_equals_the_library(tokenizer, texts):
    ids, counts = t.encoder(None)(pa.array(texts))
    want = [tokenizer.encode(x, add_special_tokens=False).ids + [1] for x in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))


def test_encoder_forgets(tokenizer, monkeypatch):
    monkeypatch.setattr(t, "CACHE_WORDS", 3)
    encode = t.WordEncoder()
    for x in ["one two three four", "five six", "one two seven", None]:
        ids, counts = encode(pa.array([x], pa.string()))
        assert ids.tolist() == tokenizer.encode(x or "", add_special_tokens=False).ids + [1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5) | st.integers(0, 49407), max_size=400), st.integers(1, 4), st.integers(1, 6))
def test_repair_round_trip(ids, repeat, uses):
    ids = np.array(ids * repeat, np.uint32)
    symbols, rules = t.repair(ids, 5, uses)
    assert t.expand(symbols, rules).tolist() == ids.tolist()
    assert (rules[:, :2].astype(int) < (t.BASE + np.arange(len(rules)))[:, None]).all()
    sizes = [len(t.expand(np.array([t.BASE + i]), rules)) for i in range(len(rules))]
    assert rules[:, 2].tolist() == sizes


def uses_left(symbols):
    """How often the most frequent pair is found without overlap."""
    found, last = {}, {}
    for i, pair in enumerate(zip(symbols.tolist(), symbols.tolist()[1:])):
        if last.get(pair) != i - 1:
            found[pair], last[pair] = found.get(pair, 0) + 1, i
    return max(found.values(), default=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3) | st.integers(0, 49407), max_size=300), st.integers(1, 6), st.integers(2, 6))
def test_repair_leaves_no_frequent_pair(ids, repeat, uses):
    ids = np.array(ids * repeat, np.uint32)
    symbols, rules = t.repair(ids, min_uses=uses)
    assert t.expand(symbols, rules).tolist() == ids.tolist() and uses_left(symbols) < uses


def test_repair_of_a_full_shard_is_exact():
    # many more distinct pairs than hashed slots, among them a passage of 50 ids and a document with many copies
    rng = np.random.default_rng(5)
    passage, document = rng.integers(0, 49408, 50), rng.integers(0, 49408, 700)
    ids = np.concatenate([x for i in range(400) for x in (
        rng.integers(0, 49408, 1500), passage if i % 40 == 1 else [], document if i % 4 == 0 else [])]).astype(np.uint32)
    symbols, rules = t.repair(ids)
    assert (t.expand(symbols, rules) == ids).all() and uses_left(symbols) < t.MIN_USES
    assert rules[:, 2].max() >= 700 - 2 and (rules[:, 2] == 50).any()


def test_random_access_and_size():
    rng = np.random.default_rng(2)
    phrases = [rng.integers(0, 49408, 9) for _ in range(30)]
    ids = np.concatenate([phrases[i] for i in rng.integers(0, 30, 3000)]).astype(np.uint32)
    counts = [0 + 1000] * 27
    raw, n = t.write_image(list(range(26)) + [None], counts, ids)
    image = t.Image(raw)
    assert n < len(ids) / 4 and image.doc_ids == list(range(26)) + [None]
    assert (image.all() == ids).all()
    for a, b in [(0, 1), (17, 18), (999, 1001), (5, 26_000), (26_999, 27_000), (10, 10)]:
        assert image.read(a, b).tolist() == ids[a:b].tolist()
    assert image.document(3).tolist() == ids[3000:4000].tolist()
    with pytest.raises(ValueError):
        t.Image(b"nope" + raw)


def test_words_of_plain_letters_skip_the_pattern(tokenizer, monkeypatch):
    """Words of ASCII letters alone need no pattern match, and words are read from Arrow without a scalar each."""
    class Counted:
        def __init__(self):
            self.seen = []

        def fullmatch(self, word):
            self.seen.append(word)
            return plain.fullmatch(word)

    plain, counted = t.PLAIN, Counted()
    monkeypatch.setattr(t, "PLAIN", counted)
    texts = ["Plain WORDS alone", "marks, too! naïve 42 Ünder", None, ""]
    ids, sizes = t.WordEncoder()(pa.array(texts))
    want = [tokenizer.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    assert sorted(counted.seen) == sorted(w.encode() for w in ["", "marks,", "too!", "naïve", "42", "Ünder"])


def test_new_words_are_stored_once(tokenizer):
    """A stem is not stored again for each word that has it, nor a word that is its own stem twice."""
    stored = []

    class Known(dict):
        def __setitem__(self, word, ids):
            stored.append(word)
            super().__setitem__(word, ids)

    encode = t.WordEncoder()
    encode.known = Known()
    words = [b"forlyened", b"forlyened,", b"Forlyened", b"\xc3\xbcber.", b"42", b""]
    encode.learn(words)
    assert sorted(stored) == sorted([b"forlyened", b"forlyened,", b"Forlyened", b"\xc3\xbcber", b"\xc3\xbcber."])
    for word in words:
        want = tokenizer.encode(word.decode(), add_special_tokens=False).ids
        assert np.frombuffer(encode.known[word], np.uint32).tolist() == want
