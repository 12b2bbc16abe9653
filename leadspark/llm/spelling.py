"""Spelling variants by blocked Gram matrices of letter counts.

Words that one inserted, deleted or replaced letter parts have letter counts at a squared distance of one or two. Counts of
a block's words make a matrix; its product with that of a block of equally long words, or of those one letter longer,
gives all squared distances at once; pairs at most two apart are verified letter by letter.

Blocks begin as the words of one length (and those one longer). A block of more than `tile` words is split exactly: the
edit lies in the first or in the second half of its window, so words meet in two blocks, each with one half of the window
and all letters outside of it equal; halves go on until blocks are small or one letter wide. A pair is taken in the one
block whose window holds its first differing place, so no pair is lost or counted twice, and no block grows with the corpus.

Per word only counts and the best near word leave a block. Forms point to words at least twice as frequent, so chains are
short, and roots are found by pointer jumping.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import discard, materialize, meet, slices

RUN = re.compile("[a-zÀ-ÿ]+")
TILE = 1000


def _runs(damage: int, flush: int = 1_000_000):
    """Occurrences of runs, added up per task; a table of over flush runs is sent on and begun anew."""
    def run(batches):
        import pyarrow as pa

        def table(counts):
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        counts: Counter[str] = Counter()
        for batch in batches:
            for part in slices([batch]):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    own = Counter(RUN.findall(text.encode().lower().decode()))
                    if damage:
                        begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                        for word in list(own):
                            h = zlib.crc32(word.encode(), begun)
                            if h % damage == 0:
                                at = h % len(word)
                                cut = word[:at] + word[at + 1:]
                                counts[cut] += own.pop(word)
                    counts.update(own)
                if len(counts) > flush:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)
    return run


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, damage: int = 0) -> DataFrame:
    """Runs of Latin letters of docs (doc_id, text), A-Z lower-cased, of min_length letters and min_count occurrences or more: word, n.

    With damage d, a run whose crc32 of `<doc_id>:<run>` d divides loses the letter at crc32 % length first, so that
    variants exist. A null doc_id is written as nothing; null texts have no runs; repeated rows count each time.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_runs(damage), "word string, n long")
    return runs.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _letters(words: list[str], width: int) -> np.ndarray:
    """Code points, a row a word, zeros behind its end."""
    out = np.zeros((len(words), width), np.uint32)
    joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(width) < lengths[:, None]] = joined
    return out


def near(words: list[str], base: int, low: int, high: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of words of base and base + 1 letters that one edit parts, whose first differing place is in low..high (the end of the word goes with the last window).

    Pairs of words of base letters have i before j; the longer word of another pair is j.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = _letters(words, base + 1)
    alphabet, ids = np.unique(letters, return_inverse=True)
    ids = ids.reshape(letters.shape)
    counts = np.zeros((len(words), len(alphabet)), np.float32)
    np.add.at(counts, (np.arange(len(words))[:, None], ids), 1)
    counts = counts[:, alphabet != 0]
    squares = (counts * counts).sum(1)
    short, long = np.flatnonzero(lengths == base), np.flatnonzero(lengths == base + 1)
    found_i, found_j = [], []

    def take(i, j):
        """The pairs that are near and belong to this window."""
        a, b = letters[i], letters[j]
        differs = a != b
        place = np.where(differs.any(1), differs.argmax(1), base)
        same = lengths[j] == base
        ok = np.where(same, differs.sum(1) == 1, False)
        # the longer word without the letter at the first differing place is the other
        moved = (a[:, :base] != b[:, 1:]) & (np.arange(base) >= place[:, None])
        ok |= ~same & ~moved.any(1)
        ok &= (place >= low) & ((place < high) | ((high == base) & (place == base)))
        found_i.append(i[ok])
        found_j.append(j[ok])

    for x in range(0, len(short), tile):
        left = short[x:x + tile]
        for others, begin in ((short, x), (long, 0)):
            for y in range(begin, len(others), tile):
                right = others[y:y + tile]
                distance = squares[left, None] + squares[right] - 2 * (counts[left] @ counts[right].T)
                i, j = np.nonzero(distance <= 2)
                if others is short and y == x:
                    i, j = i[i < j], j[i < j]
                for at in range(0, len(i), 200_000):
                    take(left[i[at:at + 200_000]], right[j[at:at + 200_000]])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64),) * 2


FOUND = "word string, near long, best_n long, best string"


def _near(tile: int):
    """Blocks of words to (word, number of near words, the most frequent of them)."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for base, low, high, members in zip(*(batch.column(c).to_pylist() for c in ("base", "low", "high", "members")), strict=True):
                members.sort(key=lambda m: m["word"])
                words, n = [m["word"] for m in members], np.array([m["n"] for m in members], np.int64)
                i, j = near(words, base, low, high, tile)
                of, to = np.concatenate([i, j]), np.concatenate([j, i])
                # the most frequent first; words are in order, so of equals the smallest index
                order = np.lexsort((to, -n[to], of))
                of, to = of[order], to[order]
                firsts = np.flatnonzero(np.diff(of, prepend=-1))
                if len(firsts):
                    sizes = np.diff(firsts, append=len(of))
                    yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in of[firsts]], pa.string()), pa.array(sizes, pa.int64()), pa.array(n[to[firsts]], pa.int64()), pa.array([words[k] for k in to[firsts]], pa.string())], ["word", "near", "best_n", "best"])
    return run


def _blocks(words: DataFrame, tile: int, max_broadcast: int = 200_000) -> DataFrame:
    """Blocks of words (word, n): base length, window low..high, members. Blocks of over tile words are split until their window is one letter."""
    length = F.length("word")
    open_ = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("base"), F.lit(0).alias("low")).withColumn("high", F.col("base"))
    left, right = F.expr("substring(word, 1, low)"), F.expr("substring(word, length(word) - (base - high) + 1)")
    key, done, held = ["base", "low", "high", "outside"], [], []
    while True:
        open_ = materialize(open_.withColumn("outside", F.concat(left, F.when(F.col("high") < F.col("base"), right).otherwise(""))), "windows")
        held.append(open_)
        large = materialize(open_.where("high - low > 1").groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > tile).drop("size"), "large")
        held.append(large)
        many = large.count()
        if not many:
            done.append(open_)
            break
        marked = large.hint("broadcast") if many <= max_broadcast else large
        done.append(open_.join(marked, key, "left_anti"))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        half = F.explode(F.array(F.struct(F.col("low").alias("l"), middle.alias("h")), F.struct(middle.alias("l"), F.col("high").alias("h"))))
        open_ = open_.join(marked, key, "left_semi").withColumn("half", half).select("word", "n", "base", F.col("half.l").alias("low"), F.col("half.h").alias("high"))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    blocks = rows.groupBy(*key).agg(F.collect_list(F.struct("word", "n")).alias("members"), F.min(F.length("word")).alias("shortest"), F.count("*").alias("size"))
    out = blocks.where("size > 1 and shortest = base").select("base", "low", "high", "members")
    out.held = held
    return out


def variants(words: DataFrame, ratio: int = 2, tile: int = TILE) -> DataFrame:
    """For each of words (word, n, distinct and not null): form, root, n, n_near and form_n.

    n_near: words that exactly one inserted, deleted or replaced letter parts from it. form: the most frequent of them
    (of equals the smallest), if ratio times as frequent at least, else null. root: the end of the chain of forms.
    Any characters will do; other columns are not read; an empty table gives no rows.
    """
    words = materialize(words.select("word", "n"), "words")
    blocks = _blocks(words, tile)
    found = blocks.mapInArrow(_near(tile), FOUND)
    # of equally frequent words the smallest: the frequency first, then the minimum among those
    per_word = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("top"))
    near_words = materialize(per_word.select("word", "n_near", (-F.col("top.less")).alias("near_n"), F.col("top.best").alias("near")), "near")
    discard(*blocks.held)
    joined = words.join(near_words, "word", "left")
    formed = F.col("near_n") >= ratio * F.col("n")
    out = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "forms")
    discard(near_words, words)
    chains = _roots(out.where("form is not null").select("word", F.col("form").alias("root")))
    return out.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """The last word of each chain of links (word, root), by pointer jumping: half as many steps are left after each round."""
    links = materialize(links, "links")
    while True:
        sizes = links.groupBy(F.col("root").alias("_at")).agg(F.count("*").alias("_n"))
        steps = materialize(sizes.join(links.select(F.col("word").alias("_at"), F.col("root").alias("_to")), "_at"), "steps")
        if not steps.limit(1).count():
            discard(steps)
            return links
        moved = meet(links.withColumnRenamed("root", "_at"), steps, ["_at"], "_n", ["word"]).select("word", F.col("_to").alias("root"))
        new = materialize(moved.unionByName(links.join(steps.select(F.col("_at").alias("root")), "root", "left_anti").select("word", "root")), "links")
        discard(links, steps)
        links = new


def report(docs: DataFrame) -> DataFrame:
    """Variants among the words of docs after every 97th of a document's runs has lost a letter."""
    return variants(vocabulary(docs, damage=97))
