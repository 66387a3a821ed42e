"""Spelling variants: words that differ by one letter, found by automata on tries.

Words are counted over whole texts, summed in each task before they are shuffled. The vocabulary is cut along its order into
shards of at most SHARD_WORDS words and SHARD_LETTERS letters, and each becomes a compact trie: in breadth-first order a
node needs its letter and its number of children. Tries are broadcast in rounds of at most ROUND_BYTES, so what a broadcast
holds doesn't grow with the vocabulary; only the number of rounds does. In every round each word's automaton for distance
one runs over every shard: the exact path is followed down, and at each node of it an inserted, a deleted or a replaced
letter opens paths on which the rest must match; these are run to their ends before the exact path goes deeper. Equal
results of several edits are met once: a letter is not inserted before its like, and of a run of equal letters only the
last is deleted. What a word accepts is reduced on the spot to a count and the best form.

All letters lie in U+0041 to U+00FF, so that texts are looked at as Latin-1, where a code point is a byte.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import common

#: Letters of a run after A-Z are lower-cased, and the divisor that picks runs that lose a letter.
RUN, LOSES = rb"[a-z\xc0-\xff]{%d,}", 199
SHARD_WORDS, SHARD_LETTERS = 32_768, 1 << 19
#: Words that a task takes down the tries.
TASK_WORDS = 8192
#: Bytes of tries that one broadcast holds at most, unless a single shard (one very long word) has more.
ROUND_BYTES = 32 << 20
#: Words that go down a trie together, and words that a task counts before it hands them on.
BLOCK, HELD = 2048, 300_000


def _counted(texts: Iterator[tuple[int | None, str]], shortest: int, total: Counter) -> None:
    """Adds the words of some (doc_id, text) to total, as Latin-1 bytes."""
    runs = re.compile(RUN % shortest)
    for doc_id, text in texts:
        before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for run, n in Counter(runs.findall(text.encode("latin-1", "replace").lower())).items():
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
            if h % LOSES == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < shortest:
                    continue
            total[run] += n


def counts(docs: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters that occur at least ``least`` times over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for at in range(batch.num_rows):
                raw = texts[at].as_py()
                if raw:
                    _counted([(ids[at].as_py(), raw.decode("utf-8", "replace"))], shortest, total)
                if len(total) >= HELD:
                    yield flush()
        if total:
            yield flush()

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return some.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _trie(words: list[bytes], n: list[int]) -> bytes:
    """A compact trie of sorted distinct words: sizes, letters and numbers of children of nodes, where words end, their counts."""
    lengths = np.array([len(w) for w in words])
    shared = np.zeros(len(words), np.int64)
    for k in range(1, len(words)):
        a, b = words[k - 1], words[k]
        most = min(len(a), len(b))
        i = 0
        while i < most and a[i] == b[i]:
            i += 1
        shared[k] = i
    letters, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
    ends = np.zeros(len(words), np.int32)
    labels, children = [np.zeros(1, np.uint8)], []
    above, first = np.zeros(1, np.int64), 0  # the words that made the nodes of a level, and the level's first node
    alive = np.arange(len(words))
    for depth in range(int(lengths.max())):
        alive = alive[lengths[alive] > depth]
        made = alive[shared[alive] <= depth]
        parents = np.searchsorted(above, made, "right") - 1
        children.append(np.bincount(parents, minlength=len(above)).astype(np.uint8))
        labels.append(letters[starts[made] + depth])
        first += len(above)
        above = made
        done = alive[lengths[alive] == depth + 1]
        ends[done] = first + np.searchsorted(above, done, "right") - 1
    children.append(np.zeros(len(above), np.uint8))
    label = np.concatenate(labels)
    head = np.array([len(label), len(words)], np.int64)
    return head.tobytes() + np.array(n, np.int64).tobytes() + ends.tobytes() + label.tobytes() + np.concatenate(children).tobytes()


class Trie:
    def __init__(self, raw: bytes):
        nodes, words = np.frombuffer(raw, np.int64, 2).tolist()
        self.counts = np.frombuffer(raw, np.int64, words, 16)
        ends = np.frombuffer(raw, np.int32, words, 16 + 8 * words)
        self.labels = np.frombuffer(raw, np.uint8, nodes, 16 + 12 * words)
        self.children = np.frombuffer(raw, np.uint8, nodes, 16 + 12 * words + nodes).astype(np.int64)
        self.first = 1 + np.cumsum(self.children) - self.children
        # in breadth-first order the edges are sorted by node and letter, and edge k leads to node k + 1
        self.parents = np.repeat(np.arange(nodes), self.children)
        self.edges = (self.parents << 8) | self.labels[1:]
        self.word = np.full(nodes, -1, np.int32)
        self.word[ends] = np.arange(words)
        self.ends = ends

    def down(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, or 0."""
        want = (node << 8) | letter
        at = np.minimum(np.searchsorted(self.edges, want), len(self.edges) - 1)
        return np.where(self.edges[at] == want, at + 1, 0)

    def spelled(self, word: int) -> bytes:
        node, out = int(self.ends[word]), bytearray()
        while node:
            out.append(self.labels[node])
            node = int(self.parents[node - 1])
        return bytes(reversed(out))


def _accepted(trie: Trie, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word of the trie) that differ by exactly one edit, each once.

    letters holds the queries end to end, with one more byte at its end.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def edited(q: np.ndarray, node: np.ndarray, at: np.ndarray) -> None:
        while len(q):
            over = at == lengths[q]
            if over.any():
                word = trie.word[node[over]]
                found.append((q[over][word >= 0], word[word >= 0]))
                q, node, at = q[~over], node[~over], at[~over]
            node = trie.down(node, letters[starts[q] + at])
            q, node, at = q[node > 0], node[node > 0], at[node > 0] + 1

    q = np.arange(len(starts))
    node, at = np.zeros(len(q), np.int64), 0  # on the exact path the position is the depth
    while len(q):
        left = lengths[q] - at
        some = left > 0
        here = letters[starts[q] + at]
        gone = some & ((left == 1) | (here != letters[np.minimum(starts[q] + at + 1, len(letters) - 1)]))
        edited(q[gone], node[gone], np.full(int(gone.sum()), at + 1))
        n = trie.children[node]
        who = np.repeat(np.arange(len(q)), n)
        child = np.repeat(trie.first[node], n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        same = some[who] & (trie.labels[child] == here[who])
        other, by = child[~same], who[~same]
        edited(q[by], other, np.full(len(by), at))
        swap = some[by]
        edited(q[by[swap]], other[swap], np.full(int(swap.sum()), at + 1))
        q, node, at = q[who[same]], child[same], at + 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[a for a, _ in found]]), np.concatenate([none, *[b for _, b in found]])


def _neighbours(words: list[bytes], shards: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """For each word the number of near words in the shards, the largest count and the smallest word that has it."""
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    letters = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
    near, most = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    forms: list[bytes | None] = [None] * len(words)
    for raw in shards:  # in code-point order, so that of equal counts the first stays
        trie = Trie(raw)
        q, word = _accepted(trie, letters, starts, lengths)
        if not len(q):
            continue
        near += np.bincount(q, minlength=len(words))
        n = trie.counts[word]
        order = np.lexsort((word, -n, q))
        q, word, n = q[order], word[order], n[order]
        best = np.concatenate([[True], q[1:] != q[:-1]])
        for i, k, m in zip(q[best].tolist(), word[best].tolist(), n[best].tolist()):
            if m > most[i]:
                most[i], forms[i] = m, trie.spelled(k)
    return near, most, forms


def _shards(vocabulary: DataFrame, words: int) -> DataFrame:
    """(first, size, trie) of the vocabulary along its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        n: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            trie = _trie(held, n)
            return pa.RecordBatch.from_arrays([pa.array([held[0].decode("latin-1")]), pa.array([len(trie)], pa.int64()), pa.array([trie], pa.binary())], names=["first", "size", "trie"])

        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = word.encode("latin-1")
                if held and (len(held) >= SHARD_WORDS or size + len(raw) > SHARD_LETTERS):
                    yield flush()
                    held, n, size = [], [], 0
                held.append(raw)
                n.append(count)
                size += len(raw)
        if held:
            yield flush()

    ranges = max(1, -(-words // SHARD_WORDS))
    return common.stage(vocabulary.repartitionByRange(ranges, "word").sortWithinPartitions("word").mapInArrow(run, "first string, size long, trie binary"))


def _round(vocabulary: DataFrame, words: int, shards: list[bytes]) -> DataFrame:
    """(word, n, near, form): what the vocabulary finds in some shards."""
    spark = vocabulary.sparkSession
    sent = spark.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                near, most, forms = _neighbours([w.encode("latin-1") for w in piece.column(0).to_pylist()], sent.value)
                spelled = pa.array([None if f is None else f.decode("latin-1") for f in forms], pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(near), pa.array(most), spelled], names=["word", "n", "near", "most", "form"])

    # few bytes, but much work: the number of tasks follows the words
    dealt = vocabulary.repartition(-(-words // TASK_WORDS))
    out = common.stage(dealt.mapInArrow(run, "word string, n long, near long, most long, form string"))
    sent.unpersist()
    return out


def _rounds(shards: DataFrame) -> Iterator[list[bytes]]:
    """The tries in order, at most ROUND_BYTES of them at a time."""
    sizes = shards.select("first", "size").orderBy("first").collect()
    at = 0
    while at < len(sizes):
        to, held = at, 0
        while to < len(sizes) and (to == at or held + sizes[to]["size"] <= ROUND_BYTES):
            held += sizes[to]["size"]
            to += 1
        part = shards.filter(F.col("first").between(sizes[at]["first"], sizes[to - 1]["first"]))
        yield [bytes(r["trie"]) for r in part.select("first", "trie").orderBy("first").collect()]
        at = to


def _rooted(links: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms of forms, twice as far in each round.

    A form occurs several times as often as its word, so that paths have no circles and at most some thirty steps.
    """
    links = common.cut(links)
    while True:
        up = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        links = common.cut(links.join(up, links["root"] == up["_w"], "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.drop("moved")


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the whole texts of docs (doc_id, text).

    A word is a run of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case, without the letter at h modulo its
    length where 199 divides h, the crc32 of doc_id, a colon and the run; it counts with at least ``shortest`` letters and
    ``least`` occurrences. Near words differ by one inserted, deleted or replaced letter. The form is the near word with
    most occurrences (the smallest of several) if these are at least ``factor`` times the word's; the root is where forms
    of forms end, or the word itself. Null and empty texts have no words, a null doc_id counts as the empty text in h,
    repeated rows count each, and other columns are ignored. Without words there are no rows.
    """
    vocabulary = common.stage(counts(docs, shortest, least))
    words, found = vocabulary.count(), None
    for tries in _rounds(_shards(vocabulary, words)):
        part = _round(vocabulary, words, tries)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vocabulary.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(0).cast("long").alias("most"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("most")).alias("less"), "form")))
    merged = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= factor * F.col("n")
    merged = common.stage(merged.select("word", "n", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    roots = _rooted(merged.filter("form is not null").select("word", F.col("form").alias("root")))
    return merged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
