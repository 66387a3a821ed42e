"""Prediction by partial matching: code lengths of texts under a byte-context trie trained on part of the corpus.

The trie's deepest nodes are contexts of ``order`` bytes; their symbol counts come from all training texts. In a shorter
context a symbol counts once for each longer one that it was seen in (update exclusion). A symbol's probability starts at the
longest context seen in training; one that the context hasn't seen escapes to the next shorter context, at a chance of
``DISCOUNT`` times the distinct symbols over the total, which the seen symbols give up; symbols seen in the longer context
are excluded there from counts and escape alike. Below order 0, unseen bytes are equally likely. So the probabilities of
all texts sum to 1. What is coded is the whole text, byte by byte as it stands, and its end. Byte 0xFF, which UTF-8 never
has, stands before a text and ends it.

Texts stay in packs (see packs). A pack sends its distinct symbols-in-context with their training counts to buckets, and
gets back the log-probability of each; words for the base score go the same way. A pack has a row for each bucket that it
has keys for, so rows never outnumber keys. Contexts of three bytes and more are resolved where all that end in the same
three bytes meet: at order 5 such a group has at most 2**24 symbols-in-context, whatever the corpus. Counts in contexts of
up to two bytes are at most 256 each, and are one table of at most 2**24 entries (6 bytes each) that all tasks get.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import common, packs, tokens

_U = np.uint64
_END = _U(0xE0D0F0E0D0F00001)
_PAD = 0xFF
#: What each seen symbol gives up for the escape; of 0.3, 0.5 and 0.7 the one with the shortest codes on held-back training texts.
DISCOUNT = 0.3
#: Distinct contexts grow slower than texts, so large packs ask less; inside, they are worked on in slices.
PACK_BYTES, SLICE_BYTES = 16 << 20, 1 << 19


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sums of their values, and the place of each key among them."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, values, len(distinct)), inverse


def _mask(k: int) -> np.uint64:
    """The bits of a symbol and k bytes before it."""
    return _U((1 << 8 * (k + 1)) - 1)


class _Level:
    """Counts of symbols in contexts of one length; keys are distinct and sorted."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.contexts, self.of = np.unique(keys >> _U(8), return_inverse=True)
        self.totals = np.bincount(self.of, counts, len(self.contexts))
        self.kinds = np.bincount(self.of, counts > 0, len(self.contexts))

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)

    def _of_contexts(self, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(self.contexts):
            return np.zeros(len(keys))
        contexts = keys >> _U(8)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[at] == contexts, values[at], 0.0)

    def shorter(self, k: int) -> _Level:
        """The level of contexts of k bytes: a symbol counts once for each longer context that has it."""
        keys, counts, _ = _sums(self.keys & _mask(k), (self.counts > 0).astype(float))
        return _Level(keys, counts)

    def steps(self, keys: np.ndarray, longer: _Level | None, longer_keys: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, mass and kinds for each key, less what the longer context excludes."""
        mass, kinds = self._of_contexts(self.totals, keys), self._of_contexts(self.kinds, keys)
        if longer is not None:
            here = np.where(longer.counts > 0, self.count(longer.keys & _mask(k)), 0.0)
            mass = mass - longer._of_contexts(np.bincount(longer.of, here, len(longer.contexts)), longer_keys)
            kinds = kinds - longer._of_contexts(longer.kinds, longer_keys)
        return self.count(keys), mass, kinds


def resolve(grams: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """log10 of the probability of each symbol in its context of ``order`` bytes, 3 at least.

    grams are distinct and sorted and hold, for every three-byte context in them, all that ends in it; short has the
    distinct symbols in contexts of two bytes of the whole corpus, sorted, and their counts.
    """
    levels = {order: _Level(grams, counts)}
    for k in range(order - 1, 2, -1):
        levels[k] = levels[k + 1].shorter(k)
    levels[2] = _Level(short[0].astype(_U), short[1].astype(float))
    for k in (1, 0):
        levels[k] = levels[k + 1].shorter(k)
    out, done, longer, longer_keys = np.zeros(len(grams)), np.zeros(len(grams), bool), None, None
    for k in range(order, -1, -1):
        keys = grams & _mask(k)
        seen, mass, kinds = levels[k].steps(keys, longer, longer_keys, k)
        live = ~done & (mass > 0)
        hit = live & (seen > 0)
        out[hit] += np.log10((seen[hit] - DISCOUNT) / mass[hit])
        escape = live & ~hit
        out[escape] += np.log10(kinds[escape] * DISCOUNT / mass[escape])
        done |= hit
        longer, longer_keys = levels[k], keys
    out[~done] -= np.log10(max(256 - len(levels[0].keys), 1))
    return out


def _flat(lists: pa.Scalar, field: str, kind: type, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """What the buckets answered, for each key that was asked."""
    out = np.zeros(len(keys), kind)
    given = {x["bucket"]: x[field] for x in lists.as_py() or ()}
    for b, at in enumerate(packs.by_bucket(keys, n_buckets)):
        if len(at):
            out[at] = np.frombuffer(given[b], kind)
    return out


class _Slice:
    """Whole texts of a pack, for their words."""

    def __init__(self, rows: pa.RecordBatch):
        column = lambda name: rows.column(rows.schema.get_field_index(name))
        self.ids, self.train = column("doc_id"), column("train").to_numpy(zero_copy_only=False)
        self.data, self.offsets = tokens.text_buffer(column("text"))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, an end after each text's, and the borders between texts."""
        starts, ends, first = tokens.word_spans(self.data, self.offsets)
        hashed = tokens.hash_words(self.data, starts, ends, lower=True)
        return np.insert(hashed, first[1:], _END), first + np.arange(len(first))

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        keys, borders = self.words()
        return _counted(keys, np.repeat(self.train, np.diff(borders)))


class _Stream:
    """A pack's texts end to end, each with its mark and its end, looked at in chunks that pay no heed to texts."""

    def __init__(self, rows: pa.RecordBatch, order: int):
        self.order, self.train = order, rows.column(rows.schema.get_field_index("train")).to_numpy(zero_copy_only=False)
        data, offsets = tokens.text_buffer(rows.column(rows.schema.get_field_index("text")))
        n = len(offsets) - 1
        self.marks, self.borders = offsets[:-1] + 2 * np.arange(n), offsets + np.arange(n + 1)
        self.stream = np.full(len(data) + 2 * n, _PAD, np.uint8)
        inside = np.ones(len(self.stream), bool)
        inside[self.marks] = inside[offsets[1:] + 2 * np.arange(n) + 1] = False
        self.stream[inside] = data

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Context and symbol of each byte and end, as one integer each, and how many of them are each text's."""
        for at in range(0, len(self.stream), SLICE_BYTES):
            end, low = min(at + SLICE_BYTES, len(self.stream)), max(0, at - self.order)
            part = self.stream[low:end]
            marks = self.marks[np.searchsorted(self.marks, low) : np.searchsorted(self.marks, end)] - low
            keys = np.zeros(len(part), _U)
            for k in range(self.order, 0, -1):
                keys <<= _U(8)
                keys[k:] |= part[:-k]
                keys[:k] |= _U(_PAD)
                for ahead in range(k):  # what lies before a text's mark isn't seen, but more marks
                    near = marks + ahead
                    keys[near[near < len(part)]] |= _U(_PAD)
            keys <<= _U(8)
            keys |= part
            keep = np.ones(len(part), bool)
            keep[marks] = False
            keep[: at - low] = False
            first, last = at - np.searchsorted(self.marks, at), end - np.searchsorted(self.marks, end)
            yield keys[keep], np.diff(np.clip(self.borders, first, last))

    def counted(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for keys, of_text in self.chunks():
            yield _counted(keys, np.repeat(self.train, of_text))


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each stands in training texts."""
    known, n = np.unique(keys[train], return_counts=True)
    every = tokens.distinct(np.concatenate([known, tokens.distinct(keys[~train])]))
    out = np.zeros(len(every), np.int64)
    out[np.searchsorted(every, known)] = n
    return every, out


def _slices(rows: pa.RecordBatch) -> list[_Slice]:
    return [_Slice(piece) for piece in tokens.slices(rows, most=SLICE_BYTES)]


def _asked(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts, sorted, and the sums of their counts."""
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[]]

    def merged(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([k for k, _ in some]), np.concatenate([c for _, c in some])
        if not len(counts):  # none are asked for
            return tokens.distinct(keys), counts
        keys, counts, _ = _sums(keys, counts)
        return keys, counts.astype(np.int64)

    for part in parts:  # four by four, so that never all parts' keys are held
        levels[0].append(part)
        for at in range(len(levels)):
            if len(levels[at]) == 4:
                if at + 1 == len(levels):
                    levels.append([])
                levels[at + 1].append(merged(levels[at]))
                levels[at] = []
    return merged([part for level in levels for part in level] or [(np.zeros(0, _U), np.zeros(0, np.int64))])


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences, which compress well."""
    return np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_steps(raw: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(raw.as_buffer(), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(_U).ravel(), dtype=_U)


def scored(docs: DataFrame, order: int = 5) -> DataFrame:
    """Scores every row of docs (doc_id, text) under a model of those whose crc32(doc_id as text) mod 7 is not 2.

    Columns: doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in training), train_tokens, base_score
    (log10, add-one over single tokens), score (log10 of the whole text's probability by partial matching) and n_bytes. A
    null text is empty: one token, its end. A null doc_id counts as the empty text, which trains. Repeated rows train and are
    scored each. Other columns are ignored; an empty table gives no rows, and without training rows bytes are equally likely.
    ``order`` is from 3 to 6.
    """
    if not 3 <= order <= 6:
        raise ValueError("contexts have from 3 to 6 bytes")
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), train.alias("train"))
    packed = packs.packed(docs, PACK_BYTES)
    n_buckets = packs.buckets_for(common.text_bytes(docs))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts = _asked(s.counted() for s in _slices(packs.unpacked(rows)))
                yield packs.questions(name, keys, n_buckets, 8, counts.astype(np.uint32))

    asked = packed.mapInArrow(ask_words, "pack long, bucket int, keys binary, more0 binary")

    def total_words(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_buffer(), _U) for x in table.column("keys")]
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("more0")]).astype(np.int64)
        _, sums, at = _sums(np.concatenate(keys), counts)
        given = np.split(sums[at].astype(np.int64), np.cumsum([len(k) for k in keys])[:-1])
        n, ones = table.num_rows, np.ones(table.num_rows, np.int64)
        columns = [table.column("pack"), table.column("bucket"), tokens.blobs([g.astype(np.uint32).tobytes() if sums.max(initial=0) < 1 << 32 else g.tobytes() for g in given])]
        wide = pa.array(np.full(n, sums.max(initial=0) >= 1 << 32))
        return pa.table([*columns, wide, pa.array(ones * int(sums.sum())), pa.array(ones * int((sums > 0).sum()))], names=["pack", "bucket", "counts", "wide", "n", "v"])

    word_counts = common.stage(asked.groupBy("bucket").applyInArrow(total_words, "pack long, bucket int, counts binary, wide boolean, n long, v long"))
    sizes = word_counts.groupBy("bucket").agg(F.max("n").alias("n"), F.max("v").alias("v")).agg(F.sum("n"), F.sum("v")).first()
    n_train, n_kinds = (sizes[0] or 0, sizes[1] or 0) if sizes else (0, 0)

    def ask_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts = _asked(_Stream(packs.unpacked(rows), order).counted())
                places = [(b, at) for b, at in enumerate(packs.by_bucket(tokens.mix(keys), n_buckets)) if len(at)]
                columns = [pa.array([name] * len(places), pa.int64()), pa.array([b for b, _ in places], pa.int32())]
                columns += [tokens.blobs([_steps(keys[at]) for _, at in places]), tokens.blobs([counts[at].astype(np.uint32).tobytes() for _, at in places])]
                yield pa.RecordBatch.from_arrays(columns, names=["pack", "bucket", "keys", "counts"])

    # asked twice, for the counts and for the probabilities
    grams = common.stage(packed.mapInArrow(ask_grams, "pack long, bucket int, keys binary, counts binary"))

    def total_grams(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_from_steps(x) for x in table.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")])
        distinct, sums, _ = _sums(keys, counts)
        return pa.table({"gram": distinct.view(np.int64), "n": sums.astype(np.int64)})

    model = common.stage(grams.groupBy("bucket").applyInArrow(total_grams, "gram long, n long"))
    # a gram has at most seven bytes and is not negative; each row counts one context of three bytes
    threes = model.filter("n > 0").select((F.col("gram") % (1 << 32)).alias("gram")).distinct()
    twos = threes.groupBy((F.col("gram") % (1 << 24)).cast("int").alias("gram")).agg(F.count("*").cast("short").alias("n")).toArrow()
    sorted_ = np.argsort(twos.column("gram").to_numpy())
    short = twos.column("gram").to_numpy()[sorted_].astype(np.uint32), twos.column("n").to_numpy()[sorted_]

    def resolved(table: pa.Table) -> pa.Table:
        keys, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        at = np.argsort(keys)
        keys = keys[at].view(_U)
        logs = resolve(keys, n[at].astype(float), short, order)
        bucket = ((tokens.mix(keys) >> _U(32)) % _U(n_buckets)).astype(np.int32)
        return pa.table({"bucket": bucket, "gram": keys.view(np.int64), "log": logs})

    tail = F.shiftright("gram", 8) % (1 << 24)
    probabilities = model.withColumn("tail", F.pmod(F.xxhash64(tail), F.lit(n_buckets))).groupBy("tail").applyInArrow(resolved, "bucket int, gram long, log double")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, logs = right.column("gram").to_numpy().view(_U), right.column("log").to_numpy()
        order_ = np.argsort(keys)
        keys, logs = keys[order_], logs[order_]
        given = [logs[np.searchsorted(keys, _from_steps(x))].tobytes() for x in left.column("keys")]
        return pa.table([left.column("pack"), left.column("bucket"), tokens.blobs(given)], names=["pack", "bucket", "logs"])

    answers = grams.select("pack", "bucket", "keys").groupBy("bucket").cogroup(probabilities.groupBy("bucket")).applyInArrow(answer, "pack long, bucket int, logs binary")
    of_grams = answers.groupBy("pack").agg(F.collect_list(F.struct("bucket", "logs")).alias("grams"))
    of_words = word_counts.groupBy("pack").agg(F.collect_list(F.struct("bucket", "counts", "wide")).alias("words"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, of_word, of_gram in zip(batch.column(1), batch.column(2), batch.column(3)):
                texts = packs.unpacked(rows)
                stream = _Stream(texts, order)
                keys = _asked((tokens.distinct(k), np.zeros(0, np.int64)) for k, _ in stream.chunks())[0]
                logs = _flat(of_gram, "logs", np.float64, tokens.mix(keys), n_buckets)
                scores = np.zeros(len(stream.train))
                for chunk, of_text in stream.chunks():
                    own, at = np.unique(chunk, return_inverse=True)
                    scores += np.bincount(np.repeat(np.arange(len(scores)), of_text), logs[np.searchsorted(keys, own)][at], len(scores))
                slices = _slices(texts)
                words_, _ = _asked(s.counted() for s in slices)
                kind = np.int64 if any(x["wide"] for x in of_word.as_py() or ()) else np.uint32
                counts = _flat(of_word, "counts", kind, words_, n_buckets).astype(np.float64)
                of_token, done = np.log10((counts + 1) / (n_train + n_kinds + 1)), 0
                for part in slices:
                    hashed, first = part.words()
                    at = np.searchsorted(words_, hashed)
                    base = np.add.reduceat(of_token[at], first[:-1])
                    known = np.add.reduceat((counts > 0).astype(np.int64)[at], first[:-1])
                    own = scores[done : done + len(part.ids)]
                    done += len(part.ids)
                    columns = [part.ids, pa.array(~part.train), pa.array(np.diff(first)), pa.array(known), pa.array(np.full(len(part.ids), n_train)), pa.array(base), pa.array(own), pa.array(np.diff(part.offsets))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

    final = packed.join(of_words, "pack").join(of_grams, "pack").select("pack", "rows", "words", "grams")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return final.mapInArrow(score, schema)
