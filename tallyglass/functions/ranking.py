"""Postings of a block of documents against a block of queries: sums of weights, of which the best of each query are kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What rounding to nine digits can make equal.
NEAR = 2e-9


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's values, null being one, and the values by number."""
    whole = column.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    coded = pc.dictionary_encode(whole, null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def best(query_id, asked, idf, term, name, part, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(query, id, score) of the k best ids of each query, and of those that rounding can make their equals.

    ``query_id``, ``asked`` and ``idf`` are the queries' terms; ``term``, ``name`` and ``part`` the postings. A score is the sum of
    idf * part; of equal sums the k smallest ids are kept.
    """
    (queries, query_values), (terms, term_values), (names, name_values) = _coded(query_id), _coded(term), _coded(name)
    of_query, of_id, sums, size = [], [], [], len(name_values)
    if len(terms):
        key = terms * size + names
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        part = np.add.reduceat(part.to_numpy()[order], first)  # an id may have a term at several lengths
        names, ends = key[first] % size, np.searchsorted(key[first], np.arange(len(term_values) + 1) * size)
        rank = np.empty(size, np.int64)
        rank[pc.sort_indices(name_values, null_placement="at_start").to_numpy()] = np.arange(size)
        words, weights = pc.fill_null(pc.index_in(asked, value_set=term_values), -1).to_numpy(), idf.to_numpy()
        order = np.lexsort((words, queries))
        order = order[words[order] >= 0]
        cuts = np.searchsorted(queries[order], np.arange(len(query_values) + 1))
        for q in range(len(query_values)):
            score, seen = np.zeros(size), np.zeros(size, bool)
            for i in order[cuts[q] : cuts[q + 1]]:
                run = slice(ends[words[i]], ends[words[i] + 1])
                score[names[run]] += weights[i] * part[run]
                seen[names[run]] = True
            at = np.flatnonzero(seen)
            if len(at) > k:
                at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k] - NEAR]
            at = at[np.lexsort((rank[at], -score[at]))]
            new = np.diff(score[at], prepend=np.inf) != 0
            at = at[np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) < k]
            of_query.append(np.full(len(at), q))
            of_id.append(at)
            sums.append(score[at])
    whole = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return query_values.take(pa.array(whole(of_query, np.int64))), name_values.take(pa.array(whole(of_id, np.int64))), pa.array(whole(sums, np.float64))
