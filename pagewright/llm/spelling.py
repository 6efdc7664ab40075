"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped under the most frequent form.

1. Texts become counts of their words; a task adds up what it has seen before it sends anything on.
2. Every word gives integer keys, taken from its prefix and suffix polynomial hashes without building a string: for each
   letter, a key of the word without it and of the place it stood at (two words of one length that differ in that letter
   share it), the key of the word without it, and the key of the whole word (a word and one a letter longer share it).
3. Keys are dealt by their leading bits and sorted; keys that no two words share go. What is left meets its strings and is
   verified on them, so hashes that agree by chance do no harm.
4. All words that share a key are near each other, so a key's members get counts and the best two of the key, and no
   pairs are built. A key has as many members as the alphabet (times the word's length) has letters, at most.
5. A word's form is its near word of largest count, if that has `ratio` times its own count. Each form is so much more
   frequent than its word that paths are short (14 steps for a count of 10 billion); roots come by doubling pointers.

Defined cases: null and empty texts have no words; texts with a null id count (an `edit` gets None); repeated rows count
each; equal counts are settled by code-point order; very long words and texts are handled whole (a word sends numbers,
not copies of itself); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import shingles as sh
from pagewright.llm.common import Scratch

LETTERS = "A-Za-zÀ-ÿ"
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
#: Words that a task holds before it sends their counts on, and letters whose keys are made at once.
HELD, KEYED = 100_000, 1 << 17
#: What a key stands for: a word without a letter, the whole word, or a word without a letter and the place it stood at.
SHORTER, WHOLE, PLACED = 0, 1, 2
PLACE = np.uint64(0xD6E8FEB86659FD93)


def _counts(min_length: int, edit: Callable[[int | None], Callable[[str], str]] | None):
    word = re.compile(f"[{LETTERS}]{{{min_length},}}")  # shorter runs can't become words; an edit never lengthens a run

    def flush(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if not raw.is_valid:
                    continue
                text = raw.as_py().translate(LOWER).decode()
                found = Counter(word.findall(text)) if len(text) < 1 << 20 else Counter(m[0] for m in word.finditer(text))
                change = edit(doc) if edit else None
                for w, n in found.items():
                    if change and len(w := change(w)) < min_length:
                        continue
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield flush(held)
                    held = {}
        if held:
            yield flush(held)

    return run


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, edit: Callable[[int | None], Callable[[str], str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters of `min_length` or more that occur `min_count` times or more.

    `edit`, if given, takes a document's id and returns what changes each of its runs; it must not lengthen them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counts(min_length, edit), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def deletion_keys(words: list[str], min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, index of the word, kind, place of the letter left out) of all keys of the words."""
    size = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    end = np.cumsum(size)
    start = end - size
    power, inverse = sh._power(len(letters) + 2)
    total = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(sh.mix((letters.astype(np.uint64) + np.uint64(1)) * sh.BASE) * power[: len(letters)], out=total[1:])
    whole = (total[end] - total[start]) * inverse[start]
    of, at = np.repeat(np.arange(len(words)), size), np.arange(len(letters))
    without = (total[at] - total[start[of]]) * inverse[start[of]] + (total[end[of]] - total[at + 1]) * inverse[start[of] + 1]
    place = at - start[of]
    again = np.zeros(len(letters), bool)
    again[1:] = (letters[1:] == letters[:-1]) & (of[1:] == of[:-1])  # the same string as without the letter before
    shorter = np.flatnonzero(~again & (size[of] > min_length))
    key = np.concatenate([sh.mix(without[shorter]), sh.mix(whole), sh.mix(without + (place.astype(np.uint64) + np.uint64(1)) * PLACE)])
    kind = np.repeat(np.array([SHORTER, WHOLE, PLACED], np.int8), [len(shorter), len(words), len(at)])
    return key.view(np.int64), np.concatenate([of[shorter], np.arange(len(words)), of]), kind, np.concatenate([place[shorter], np.zeros(len(words), np.int64), place])


def _keys(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends = np.cumsum([len(w) for w in words])
            i = 0
            while i < len(words):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + KEYED, "right")))
                key, of, kind, place = deletion_keys(words[i:j], min_length)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[i:j][of]), pa.array(kind), pa.array(place, pa.int32())], names=["key", "id", "kind", "place"])
                i = j

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by the leading 16 bits of their keys, and sorted by key."""
    return rows.repartition(F.expr("shiftrightunsigned(key, 48)")).sortWithinPartitions("key")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a partition sorted by its first column, cut only where that column changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if held and (cut or held[-1].column(0)[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key another row has too, unless all of them only lack a letter."""
    for table in whole_groups(batches):
        key, kind = table.column("key").to_numpy(), table.column("kind").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        useful = (count > 1) & (np.maximum.reduceat(kind, first) > SHORTER)
        yield from table.filter(pa.array(np.repeat(useful, count))).combine_chunks().to_batches()


def _of_key(members: list[tuple[int, int, int, str, int]]) -> Iterator[tuple[int, int, int, str]]:
    """(word, its near words here, the best one's count, the best one) for the rows (kind, place, id, word, n) of one key."""
    rank = lambda m: (-m[4], m[3])
    same: dict[tuple, list] = {}
    for m in members:
        kind, place, _, word, _ = m
        same.setdefault((kind == PLACED and place, word if kind == WHOLE else word[:place] + word[place + 1 :]), []).append(m)
    for (placed, _), group in same.items():
        if placed is not False:
            best = sorted(group, key=rank)[:2]
            sides = [(m, len(group) - 1, best[m is best[0]]) for m in group] if len(group) > 1 else []
        else:
            whole, longer = [m for m in group if m[0] == WHOLE], [m for m in group if m[0] == SHORTER]
            sides = [(whole[0], len(longer), min(longer, key=rank)), *((m, 1, whole[0]) for m in longer)] if whole and longer else []
        for m, near, best_one in sides:
            yield m[2], near, best_one[4], best_one[3]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches):
        rows = zip(*(table.column(c).to_pylist() for c in ("key", "kind", "place", "id", "word", "n")))
        out = [r for _, group in groupby(rows, key=lambda r: r[0]) for r in _of_key([m[1:] for m in group])]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["id", "near", "best_n", "best"])


def variants(counts: DataFrame, min_length: int = 6, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words of `min_length` letters or more."""
    scratch = Scratch(counts.sparkSession, "spelling")
    words = scratch.table("words", counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    keys = words.select("id", "word").mapInArrow(_keys(min_length), "key long, id long, kind byte, place int")
    shared = scratch.table("shared", _dealt(keys).mapInArrow(_shared, "key long, id long, kind byte, place int"))
    met = _dealt(shared.join(words, "id").select("key", "kind", "place", "id", "word", "n"))
    near = met.mapInArrow(_near, "id long, near long, best_n long, best string").groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("best"))
    form = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    formed = words.join(near, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form["best"].alias("form"), (-form["n"]).alias("form_n"))
    formed = scratch.table("formed", formed)

    # A form has `ratio` times its word's count, so a path is no longer than a count can grow.
    most, least = formed.agg(F.max("n"), F.min("n")).first()
    longest = 0
    while most and ratio > 1 and least * ratio ** (longest + 1) <= most:
        longest += 1
    ends = formed.filter("form is not null").select("word", F.col("form").alias("end"))
    for i in range(max(0, longest - 1).bit_length()):
        ends = scratch.table(f"ends-{i}", ends)
        beyond = ends.select(F.col("word").alias("end"), F.col("end").alias("next"))
        ends = ends.join(beyond, "end", "left").select("word", F.coalesce("next", "end").alias("end"))
    out = formed.join(ends, "word", "left")
    scratch.drop("shared")
    return out.select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
