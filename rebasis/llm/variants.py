"""Spelling variants grouped through a variable-length gram (VGRAM) index.

Words come from letter runs of the texts. Their near words (one inserted, deleted or replaced
code point) are found without comparing all pairs:

1. **Gram dictionary.** All grams of ``Q_MIN`` code points that occur in words, and grams up
   to ``Q_MAX`` whose one shorter prefix is in the dictionary and occurs in at least ``T``
   words (frequency pruning: only frequent grams are worth extending). ``T`` is a share of all
   words, so the dictionary behaves alike at every size.
2. **Decomposition.** At each position of a word the longest dictionary gram starting there is
   a candidate; a candidate lying inside an earlier one is dropped. The rest, with an occurrence
   number for repeats, are the word's grams.
3. **Affected-gram bound.** One edit at position i can change a gram of ``s`` code points at p
   only if i is one of them, or the place behind them and the dictionary holds a longer gram that
   starts with it, or one of the ``Q_MAX - s`` places before p, from where a changed gram could
   cover it. The largest number of the word's grams that one i can change is NAG; a word within one
   edit shares at least ``b = grams - NAG`` grams with it. This bound is never too high.
4. **List merging.** Grams are ordered by their frequency over all words, rarest first. Two
   words within one edit, both with ``b >= 1``, share at least ``max(b)`` grams, so they share
   a gram among the first ``grams - b + 1`` of each (prefix filtering over the bound). Grams that
   the edit leaves alone keep their start, or move by the difference of the lengths if they lie
   behind it. The lists of the prefix grams, per gram, word length and start, are merged by a join.
   Candidates whose letters differ by more than one edit can make them, as seen in a 64-bit mask, are
   left out; the others pass an exact edit-distance check where they meet, and then the count filter.
5. **The rest, exactly.** A word whose bound is 0 or less (short words, whose window covers all
   their grams) cannot be pruned by grams: it would probe with all its grams, and the lists of
   frequent grams would meet nearly whole. Pairs with such a word meet through one-deletion
   variants instead (a word and every string it gives by deleting one code point), which two
   words within one edit always share: its variants against those of all words. They are then
   checked alike.

Per word: ``n`` occurrences, ``n_near`` near words, ``form`` (the near word of largest ``n``,
ties by code-point order, if that ``n`` is at least ``FORM_RATIO`` times the word's), ``form_n``
and ``root`` (forms followed to the end). Every step is a join or an aggregate; no group is
collected and no pair list is built per gram beyond the prefix lists.

Edge cases: null or empty texts give no runs; a null ``doc_id`` is hashed as the empty text;
repeated rows count each time; words are distinct, so ties in ``n`` are decided by code point.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rebasis.llm.common import stored

# Fixed values of the operator's contract.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
DROP_EVERY = 31
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10
LONGEST = 1 << 30

# Parameters of the index.
Q_MIN = 2
Q_MAX = 4
FREQ_SHARE = 0.002


def spelled_words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): runs lower-cased in A-Z, one code point dropped where the hash says, counted."""
    # a text is lower-cased whole, which moves no run's ends; one of ASCII alone has no other capitals
    given = F.coalesce(F.col(text), F.lit(""))
    plain = F.octet_length(given) == F.char_length(given)
    lower = F.when(plain, F.lower(given)).otherwise(F.translate(given, UPPER, LOWER))
    low = docs.select(F.col(key).alias("_k"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), 0)).alias("low"))
    h = F.crc32(F.concat(F.coalesce(F.col("_k").cast("string"), F.lit("")), F.lit(":"), F.col("low")).cast("binary"))
    at = (h % F.char_length("low")).cast("int")
    dropped = F.concat(F.col("low").substr(F.lit(1), at), F.col("low").substr(at + 2, F.lit(LONGEST)))
    word = F.when(h % DROP_EVERY == 0, dropped).otherwise(F.col("low"))
    counted = low.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.char_length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT))


def _grams_at(word: Column, q: int) -> Column:
    """Every gram of ``q`` code points with its start: array<struct<p, g>>."""
    return F.transform(F.sequence(F.lit(0), F.char_length(word) - q),
                       lambda p: F.struct(p.alias("p"), word.substr(p + 1, F.lit(q)).alias("g")))


def dictionary(words: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX, share: float = FREQ_SHARE) -> DataFrame:
    """The gram dictionary (gram string), frequency-pruned: extend a gram only if it is frequent."""
    n_words = words.count()
    threshold = max(2, int(share * n_words))
    freq = None
    for q in range(q_min, q_max + 1):
        grams = (words.select("word", F.explode(F.array_distinct(F.transform(
            F.filter(_grams_at(F.col("word"), q), lambda s: F.char_length(s["g"]) == q), lambda s: s["g"]))).alias("g"))
            .groupBy("g").agg(F.count("*").alias("f"), F.lit(q).alias("q")))
        if freq is None:
            level = grams
        else:
            frequent = freq.where((F.col("q") == q - 1) & (F.col("f") >= threshold)).select(F.col("g").alias("prefix"))
            level = grams.join(frequent, F.substring("g", 1, q - 1) == F.col("prefix"), "left_semi")
        level = stored(level, f"vgram-dict-{q}")
        freq = level if freq is None else freq.unionByName(level)
    return freq.select("g", "q", "f")


def split_word(word: str, grams: set[str], longer: set[str], q_min: int = Q_MIN,
               q_max: int = Q_MAX) -> tuple[list[str], list[int], int]:
    """The tokens ``gram#k`` of a word (k-th repeat of the gram), their starts and the bound ``b``.

    At each position the longest dictionary gram starting there is a candidate; one that ends
    no later than an earlier candidate is covered and dropped. ``longer`` holds the grams that
    begin a longer one of the dictionary. ``b`` = tokens minus the most that one edit can change.
    """
    tokens, starts, reach = [], [], -1
    seen: dict[str, int] = {}
    change = [0] * (len(word) + 2)  # of the number of changed tokens, from one edit place to the next
    for p in range(len(word) - q_min + 1):
        size = next((q for q in range(min(q_max, len(word) - p), q_min - 1, -1) if word[p : p + q] in grams), 0)
        if size and p + size > reach:
            reach = p + size
            g = word[p:reach]
            k = seen.get(g, 0)
            seen[g] = k + 1
            tokens.append(f"{g}#{k}")
            starts.append(p)
            change[max(0, p - (q_max - size))] += 1
            change[reach + (g in longer)] -= 1
    return tokens, starts, len(tokens) - max(accumulate(change))


def letter_mask(word: str) -> int:
    """A bit for each letter, by its code point modulo 64; one edit changes two bits at most."""
    mask = 0
    for c in set(word):
        mask |= 1 << (ord(c) & 63)
    return mask - (1 << 64) if mask >> 63 else mask


def decompose(words: DataFrame, dic: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX) -> DataFrame:
    """Per word: its kept grams as tokens ``gram#k`` (k-th repeat), their starts, the bound ``b`` and the letter mask.

    The dictionary is broadcast: its size is bounded by construction (all grams of ``q_min``
    letters, and for each longer size at most ``1 / FREQ_SHARE`` frequent prefixes per gram
    of a word, times the alphabet), not by the data. Words are split in Arrow batches.
    """
    grams = {r.g for r in dic.select("g").collect()}
    shared = words.sparkSession.sparkContext.broadcast((grams, {g[:-1] for g in grams}))

    @pandas_udf("tokens array<string>, starts array<int>, b int, mask long")
    def split(batch: pd.Series) -> pd.DataFrame:
        held, longer = shared.value
        parts = [split_word(w, held, longer, q_min, q_max) for w in batch]
        return pd.DataFrame({"tokens": [t for t, _, _ in parts], "starts": [s for _, s, _ in parts],
                             "b": [b for _, _, b in parts], "mask": [letter_mask(w) for w in batch]})

    return words.select("word", split("word").alias("s")).select("word", "s.*")


def _deletions(word: Column) -> Column:
    """The word and every string made by deleting one of its code points."""
    return F.array_union(F.array(word), F.transform(
        F.sequence(F.lit(1), F.char_length(word)),
        lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.lit(LONGEST)))))


def near_pairs(words: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX, share: float = FREQ_SHARE) -> DataFrame:
    """Ordered pairs (word, other) of words one edit apart, both directions, each once."""
    dic = dictionary(words, q_min, q_max, share)
    idx = stored(decompose(words, dic, q_min, q_max), "vgram-words")
    bounded = idx.where(F.col("b") >= 1)
    tok = bounded.select("word", "b", "mask", F.explode(F.arrays_zip("tokens", "starts")).alias("x")).select(
        "word", "b", "mask", F.substring_index("x.tokens", "#", 1).alias("g"), F.col("x.starts").alias("p"))
    freq = tok.groupBy("g").agg(F.count("*").alias("tf"))
    ranked = tok.join(freq, "g").groupBy("word", "b", "mask").agg(
        F.sort_array(F.collect_list(F.struct("tf", "g", "p"))).alias("r"))
    plen = F.size("r") - F.col("b") + 1
    size = F.char_length("word")
    prefix = stored(ranked.select("word", "mask", size.alias("len"), F.explode(F.slice("r", 1, plen)).alias("x"))
                    .select("word", "mask", "len", "x.g", "x.p"), "vgram-prefix")
    # near words differ in length by one at most, and a shared gram's start by that difference or not
    # at all: the shorter word looks up the longer one. Two lists of one hash only add candidates
    places = [("len", "p", True), (F.col("len") + 1, "p", False), (F.col("len") + 1, F.col("p") + 1, False)]
    probe = prefix.select(F.col("word").alias("a"), F.col("mask").alias("ma"), F.explode(F.array(*(
        F.struct(F.xxhash64("g", n, p).alias("t"), F.lit(same).alias("same")) for n, p, same in places))).alias("x")
    ).select("a", "ma", "x.t", "x.same")
    build = prefix.select(F.col("word").alias("c"), F.col("mask").alias("mc"), F.xxhash64("g", "len", "p").alias("t"))
    one_edit = F.levenshtein("a", "c", 1) == 1
    by_grams = (probe.join(build, "t")
                .where((F.bit_count(F.col("ma").bitwiseXOR(F.col("mc"))) <= 2) & (~F.col("same") | (F.col("a") < F.col("c")))
                       & one_edit)
                .select("a", "c").distinct())
    both = idx.select(F.col("word").alias("a"), F.col("tokens").alias("ta"), F.col("b").alias("ba"))
    other = idx.select(F.col("word").alias("c"), F.col("tokens").alias("tc"), F.col("b").alias("bc"))
    checked = (by_grams.join(both, "a").join(other, "c")
               .where(F.size(F.array_intersect("ta", "tc")) >= F.greatest("ba", "bc"))
               .select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("c")))
    keys = idx.select("word", (F.col("b") < 1).alias("loose"), F.explode(_deletions(F.col("word"))).alias("k"))
    by_deletions = (keys.where("loose").alias("x").join(keys.alias("y"), "k")
                    .where((F.col("x.word") != F.col("y.word")) & (~F.col("y.loose") | (F.col("x.word") < F.col("y.word"))))
                    .select(F.least("x.word", "y.word").alias("a"), F.greatest("x.word", "y.word").alias("c"))
                    .where(one_edit))
    pairs = checked.unionByName(by_deletions).distinct()
    return pairs.select(F.col("a").alias("word"), F.col("c").alias("other")).unionByName(
        pairs.select(F.col("c").alias("word"), F.col("a").alias("other")))


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts."""
    words = stored(spelled_words(docs, text, key), "vgram-counts")
    near = near_pairs(words)
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = (near.join(counts, "other").groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("neg"), "other")).alias("top")))
    forms = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("top.neg") >= FORM_RATIO * F.col("n"), F.col("top.other")).alias("form"),
        F.when(-F.col("top.neg") >= FORM_RATIO * F.col("n"), -F.col("top.neg")).cast("long").alias("form_n"))
    forms = stored(forms, "vgram-forms")
    # Forms strictly raise n tenfold, so chains are short: follow them until nothing moves.
    step = forms.where(F.col("form").isNotNull()).select(F.col("word").alias("root"), F.col("form").alias("next"))
    roots = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        moved = roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                      F.col("next").isNotNull().alias("moved"))
        moved = stored(moved, "vgram-roots")
        if moved.where("moved").limit(1).count() == 0:
            break
        roots = moved.select("word", "root")
    return forms.join(moved.select("word", "root"), "word").select(
        "word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", "form_n")
