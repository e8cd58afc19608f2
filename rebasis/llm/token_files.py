"""Token ids as files, compressed by Re-Pair.

Documents are sorted by id (range partitions, then a sort inside), encoded, and
packed into shards of about ``shard_ids`` ids; a document is never split. A
shard is one binary image, a row of a Parquet table: Spark's committer makes a lost task's
shards appear once, in any store. Images are read back one by one.

Re-Pair, per shard: count the adjacent pairs, replace those found at least
``min_uses`` times by new symbols, left to right without overlap, and repeat on the
result until no pair is found that often. Counts are exact; the frequent pairs of a round are replaced together. Rules hold two older symbols each and the length of their
expansion, so any range of ids is decoded by locating it in the running sum of lengths
and expanding the symbols that cover it.

Image, little-endian: magic ``RPT1``; uint32 documents, rules, symbols, flags; per
document int64 id, uint8 id is null, uint32 ids; per rule uint32 left, uint32 right,
uint32 expansion length; uint24 symbols. Symbols below 65536 are ids.

The encoder splits at ASCII white space, which this tokenizer drops and never merges
across, and remembers the ids of frequent words in a bounded table; results are the library's.

Null and empty texts hold the end id alone. Null ids come first; repeated ids are
ordered by text. An empty table gives no shards.
"""

from __future__ import annotations

import ctypes
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rebasis.llm.common import small, stored

LIBC = ctypes.CDLL(None)
MAGIC = b"RPT1"
BASE = 1 << 16
SHARD_IDS = 1 << 20
MAX_SYMBOLS = 1 << 24
ROUNDS = None  # until no pair is frequent
MIN_USES = 8
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
HASH = np.uint64(0x9E3779B97F4A7C15)
END_ID = 1
CACHE_WORDS = 350_000
GROUP_BYTES = 1 << 23
# Letters that lower-case and normalise one by one, in UTF-8, then marks the tokenizer parts from letters.
LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
PLAIN = re.compile(rb"([A-Za-z]+(?:%b[A-Za-z]*)*|(?:%b[A-Za-z]*)+)([.,;:!?%%$#&*|]{0,8})" % (LATIN, LATIN))
# byte-level vocabularies show a byte as itself if it is printable, else as the next free character from 256
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
VOCABULARY = "word_bpe_49k.json"

IMAGE_SCHEMA = "part int, no int, n_docs int, n_ids bigint, n_symbols bigint, image binary"


class WordEncoder:
    """Ids of texts, batch by batch: each distinct word is looked up once, and encoded once while it is remembered.

    The tokenizer lower-cases, and parts letters and digits from other marks, so an unknown word
    of Latin letters and marks is its lower-case stem and its marks. The stem is one word to the
    library's model, which is asked for it directly; all else takes the whole way.
    """

    def __init__(self, path: str | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.model = self.tokenizer.model
        # words seen lately, and those seen before; a word found in the second moves to the first
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def library(self, words: list[bytes]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in done]

    def stem_ids(self, stem: bytes) -> bytes:
        """Ids of a lower-case stem, by the model alone."""
        text = stem.decode()
        if not text.isascii():
            text = text.lower().encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def learn(self, words: list[bytes]) -> None:
        known, older, marked, plain, stem_ids = self.known, self.older, self.marks, PLAIN.fullmatch, self.stem_ids
        ask: list[bytes] = []
        for word in words:
            if word.isalpha():  # ASCII letters alone, as most words are
                stem, marks = word.lower(), b""
            elif (found := plain(word)) is None:
                ask.append(word)
                continue
            else:
                stem, marks = found.groups()
                stem = stem.lower()
            ids = known.get(stem)
            if ids is None:
                ids = known[stem] = older.get(stem) or stem_ids(stem)
            if marks:
                if marks not in marked:
                    marked[marks] = self.library([marks])[0]
                ids += marked[marks]
            if stem != word:
                known[word] = ids
        known.update(zip(ask, self.library(ask)))

    def rest(self) -> None:
        """Keep only what was seen lately, and give freed memory back, while the worker waits for its next task."""
        self.turn()
        pa.default_memory_pool().release_unused()
        if hasattr(LIBC, "malloc_trim"):
            LIBC.malloc_trim(0)

    def turn(self) -> None:
        self.known, self.older, self.marks = {}, self.known, {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and how many each text has."""
        if len(self.known) > CACHE_WORDS:
            self.turn()
        known, older = self.known, self.older
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(known.get, words))
        if new := [n for n, ids in enumerate(found) if ids is None]:
            unknown = []
            for n in new:
                if (ids := older.get(words[n])) is None:
                    unknown.append(words[n])
                else:
                    known[words[n]] = ids
            self.learn(unknown)
            for n in new:
                found[n] = known[words[n]]
        table = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        starts = np.cumsum(size, dtype=np.int32) - size
        codes = coded.indices.to_numpy()
        each = size[codes]
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        total = int(ends[-1])
        kind = np.int32 if total < 1 << 31 else np.int64
        place = np.repeat((starts[codes] - ends[:-1]).astype(kind), each)
        place += np.arange(total, dtype=kind)
        ids = table[place]
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return np.insert(ids, bounds[1:], END_ID), np.diff(bounds) + 1


_encoders: dict[str | None, WordEncoder] = {}


def encoder(path: str | None) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def frequent(pairs: np.ndarray, min_uses: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, codes, counts) of the pairs found ``min_uses`` times: where they stand in ``pairs``, as which pair, how often each.

    Counts are exact. Hashed slots go before the sort, only to drop pairs whose whole slot has too few.
    """
    places = np.arange(len(pairs))
    if len(pairs) > 1 << 12:
        slot = ((pairs * HASH) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        places = np.flatnonzero((np.bincount(slot, minlength=SLOTS) >= min_uses)[slot])
    order = np.argsort(pairs[places])
    places = places[order]
    ordered = pairs[places]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else places
    counts = np.diff(first, append=len(ordered))
    enough = counts >= min_uses
    places = places[np.repeat(enough, counts)]
    counts = counts[enough]
    return places, np.repeat(np.arange(len(counts)), counts), counts


def repair(ids: np.ndarray, rounds: int | None = ROUNDS, min_uses: int = MIN_USES) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rules are rows (left, right, expansion length), numbered from ``BASE``.

    Each round counts all pairs without overlap and replaces every second place of a run of frequent ones. If
    so each pair gets too few, the more frequent of two neighbours goes first (of equal ones by a hash, which keeps
    rules shallow), so the most frequent pair is replaced whole. Without a limit of ``rounds`` no
    pair is left that is found ``min_uses`` times.

    Symbols stay where they are, linked to their neighbours, and a pair that was too rare stays too
    rare. A round therefore looks only at pairs of the last round's symbols and at those left over.
    """
    n = len(ids)
    seq = np.append(ids.astype(np.uint32), np.uint32(0))
    # links of the machine's own width index fastest; those of a very long sequence are kept narrow
    kind = np.int32 if 1 << 24 < n < (1 << 31) - 2 else np.intp
    after, before = np.arange(1, n + 2, dtype=kind), np.arange(-1, n, dtype=kind)
    gone = np.zeros(n + 1, bool)
    gone[n] = True
    tables: list[np.ndarray] = []
    sizes = np.ones(BASE, np.uint32)
    at = np.arange(max(n - 1, 0))  # in order; a place is the first of its pair
    while len(at) and (rounds is None or len(tables) < rounds):
        room = MAX_SYMBOLS - len(sizes)
        if room <= 0:
            break
        pairs = (seq[at].astype(np.uint64) << np.uint64(24)) | seq[after[at]]
        # of a run of one symbol every second pair counts
        same = np.zeros(len(at), bool)
        alike = np.flatnonzero(pairs[1:] == pairs[:-1])
        same[alike[after[at[alike]] == at[alike + 1]] + 1] = True
        odd = np.zeros(len(at), bool)
        if same.any():
            order = np.arange(len(at))
            odd = ((order - np.maximum.accumulate(np.where(same, 0, order))) & 1) == 1
        if odd.any():
            free = np.flatnonzero(~odd)
            places, codes, counts = frequent(pairs[free], min_uses)
            places = free[places]
        else:
            places, codes, counts = frequent(pairs, min_uses)
        if not len(counts):
            break
        code = np.full(len(at), -1, np.int64)
        code[places] = codes
        value = np.zeros(len(counts), np.uint64)
        value[codes] = pairs[places]
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((value * HASH, counts))] = np.arange(1, len(counts) + 1)
        # the other pairs of a run stay for later rounds if their pair is frequent
        left = odd.copy()
        left[1:] &= (code[:-1] >= 0)
        hot = np.flatnonzero(code >= 0)
        where, code = at[hot], code[hot]
        stay, every = where, code
        # of a run of neighbouring places every second one is taken, once more without the pairs that get too few
        for last in (False, True):
            run = np.zeros(len(where), bool)
            run[1:] = after[where[:-1]] == where[1:]
            order = np.arange(len(where))
            take = ((order - np.maximum.accumulate(np.where(run, 0, order))) & 1) == 0
            uses = np.bincount(code[take], minlength=len(counts))
            if not last:
                some = uses[code] >= min_uses
                where, code = where[some], code[some]
        if not (uses >= min_uses).any():  # then each place that outranks its neighbours: the most frequent pair has all its own
            where, code = stay, every
            weight, run = rank[code], after[where[:-1]] == where[1:]
            take = np.ones(len(where), bool)
            take[1:] &= ~run | (weight[1:] > weight[:-1])
            take[:-1] &= ~run | (weight[:-1] > weight[1:])
            uses = np.bincount(code[take], minlength=len(counts))
        named = np.flatnonzero(uses >= min_uses)
        named = named[np.argsort(-rank[named])][:room]
        number = np.zeros(len(counts), np.uint32)
        number[named] = len(sizes) + np.arange(len(named))
        take &= number[code] > 0
        where, code = where[take], code[take]
        ends = seq[where], seq[after[where]]
        one = np.zeros(len(counts), np.int64)
        one[code] = np.arange(len(code))
        a, b = ends[0][one[named]], ends[1][one[named]]
        size = sizes[a] + sizes[b]
        tables.append(np.stack([a, b, size], axis=1))
        sizes = np.concatenate([sizes, size])
        second = after[where]
        seq[where] = number[code]
        gone[second] = True
        after[where] = after[second]
        before[after[where]] = where
        touched = before[where]
        at = np.concatenate([stay, at[left], where, touched[touched >= 0]])
        if len(at) > n >> 5:
            mark = np.zeros(n + 1, bool)
            mark[at] = True
            at = np.flatnonzero(mark)
        else:
            at = np.unique(at)
        at = at[~gone[at] & (after[at] < n)]
    return seq[~gone], np.concatenate(tables) if tables else np.zeros((0, 3), np.uint32)


class Grammar:
    """Rules with their expansions laid end to end, for expanding many symbols at once."""

    def __init__(self, rules: np.ndarray) -> None:
        self.sizes = np.concatenate([np.ones(BASE, np.int64), rules[:, 2]])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.zeros(int(self.sizes.sum()), np.uint32)
        self.flat[:BASE] = np.arange(BASE)
        # shorter rules first: both halves of a rule are shorter than the rule
        order = np.argsort(rules[:, 2], kind="stable")
        for of_size in np.split(order, np.flatnonzero(np.diff(rules[order, 2])) + 1):
            for symbol, side in ((rules[of_size, 0], 0), (rules[of_size, 1], 1)):
                shift = self.sizes[rules[of_size, 0]] if side else 0
                self._copy(symbol, self.starts[BASE + of_size] + shift)

    def _places(self, symbols: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.sizes[symbols]
        ahead = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        return np.repeat(self.starts[symbols] - ahead, size) + step, np.repeat(to - ahead, size) + step

    def _copy(self, symbols: np.ndarray, to: np.ndarray) -> None:
        source, target = self._places(symbols, to)
        self.flat[target] = self.flat[source]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        size = self.sizes[symbols]
        ahead = np.cumsum(size) - size
        return self.flat[np.repeat(self.starts[symbols] - ahead, size) + np.arange(int(size.sum()))]


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for."""
    return Grammar(rules).expand(symbols)


def write_image(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, rounds: int | None = ROUNDS) -> tuple[bytes, int]:
    """A shard image and its number of symbols."""
    symbols, rules = repair(ids, rounds)
    return b"".join([
        MAGIC, struct.pack("<4I", len(doc_ids), len(rules), len(symbols), 0),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(counts, "<u4").tobytes(), rules.astype("<u4").tobytes(),
        symbols.astype("<u4").view("u1").reshape(-1, 4)[:, :3].tobytes(),
    ]), len(symbols)


class Image:
    """A shard image, opened: documents, and any range of ids without decoding the rest."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a shard image")
        docs, rules, symbols, _ = struct.unpack_from("<4I", raw, 4)
        at = 20
        ids = np.frombuffer(raw, "<i8", docs, at)
        nulls = np.frombuffer(raw, "u1", docs, at := at + 8 * docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, nulls)]
        self.counts = np.frombuffer(raw, "<u4", docs, at := at + docs).astype(np.int64)
        self.rules = np.frombuffer(raw, "<u4", 3 * rules, at := at + 4 * docs).reshape(-1, 3)
        packed = np.frombuffer(raw, "u1", 3 * symbols, at + 12 * rules).reshape(-1, 3).astype(np.uint32)
        self.symbols = packed[:, 0] | packed[:, 1] << 8 | packed[:, 2] << 16
        self.starts = np.cumsum(self.counts) - self.counts
        self.grammar = Grammar(self.rules)

    def all(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, expanding only the symbols that cover them."""
        ends = np.cumsum(self.grammar.sizes[self.symbols])
        first = int(np.searchsorted(ends, start, "right"))
        last = int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[first - 1]) if first else 0
        return self.grammar.expand(self.symbols[first:last])[start - before: stop - before]

    def document(self, n: int) -> np.ndarray:
        return self.read(int(self.starts[n]), int(self.starts[n] + self.counts[n]))


def groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts hold about ``most`` bytes, one row at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for n, k in enumerate(size.tolist()):
        held += k
        if held >= most:
            yield lo, n + 1
            lo, held = n + 1, 0
    if lo < len(size):
        yield lo, len(size)


def _writer(path: str | None, shard_ids: int, rounds: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # imported by name: what is pickled with the task would start without the worker's encoder
        from rebasis.llm.token_files import encoder

        encode = encoder(path)
        doc_ids, counts, parts, total, no, part = [], [], [], 0, 0, 0

        def image() -> pa.RecordBatch:
            raw, symbols = write_image(doc_ids, counts, np.concatenate(parts), rounds)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([len(doc_ids)], pa.int32()),
                 pa.array([total], pa.int64()), pa.array([symbols], pa.int64()), pa.array([raw], pa.binary())],
                ["part", "no", "n_docs", "n_ids", "n_symbols", "image"])

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            part = batch.column("part")[0].as_py() if len(keys) else part
            for lo, hi in groups(texts):
                ids, sizes = encode(texts.slice(lo, hi - lo))
                start, at, first = 0, 0, lo
                for n, size in enumerate(sizes.tolist(), lo + 1):
                    at += size
                    if total + at - start >= shard_ids or n == hi:
                        doc_ids += keys[first:n]
                        counts += sizes[first - lo: n - lo].tolist()
                        parts.append(ids[start:at])
                        total += at - start
                        start, first = at, n
                        if total >= shard_ids:
                            yield image()
                            doc_ids, counts, parts, total, no = [], [], [], 0, no + 1
        if doc_ids:
            yield image()
        encode.rest()

    return run


def write_shards(docs: DataFrame, path: str | None = None, shard_ids: int = SHARD_IDS, rounds: int | None = ROUNDS) -> DataFrame:
    """Encode and write all documents; the stored table of shard images (part, no, ...)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_first()
    ordered = rows.repartitionByRange(order).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    images = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_writer(path, shard_ids, rounds), IMAGE_SCHEMA)
    return stored(images, "shards")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, no, raw in zip(batch.column("part").to_pylist(), batch.column("no").to_pylist(), batch.column("image")):
            image = Image(raw.as_py())
            ids = image.all().astype("<u4", copy=False)
            sums = [zlib.crc32(ids[a: a + n]) for a, n in zip(image.starts.tolist(), image.counts.tolist())]
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([no] * n, pa.int32()), pa.array(image.doc_ids, pa.int64()),
                 pa.array(image.starts, pa.int64()), pa.array(image.counts, pa.int64()), pa.array(sums, pa.int64())],
                ["part", "no", "doc_id", "within", "n_tokens", "ids_crc32"])


def read_shards(images: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the images.

    Shard offsets are sums by partition, then by shard inside it.
    """
    sizes = images.select("part", "no", "n_ids")
    inside = Window.partitionBy("part").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    by_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", (F.sum("n").over(along) - F.col("n")).alias("base"))
    offsets = sizes.withColumn("shard_start", F.sum("n_ids").over(inside) - F.col("n_ids")).join(by_part, "part").select(
        "part", "no", (F.col("base") + F.col("shard_start")).alias("base"))
    docs = images.select("part", "no", "image").mapInArrow(
        _reader, "part int, no int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(small(offsets, images.count()), ["part", "no"]).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
