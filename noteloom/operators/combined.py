"""N-grams counted where their documents are read, before anything is shuffled: documents and occurrences alike.

A shuffle of n-grams by document is many times the size of the texts. Here all rows of a document meet in one task
(one shuffle of the texts), so that a task knows in how many documents a phrase is. What it has counted over many
documents leaves it in columns, compressed, by buckets of phrases; each bucket is put together by itself."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import folded_form, primary_form, six_places
from noteloom.operators.mining import tokens
from noteloom.session import ship

#: Tokens that a task counts at once; a document of more is counted in parts, which are put together later.
CHUNK_TOKENS = 750_000
#: Bytes of text for each bucket of phrases, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 4_000_000, 24
BATCH_ROWS = 20_000
SCHEMA = "language string, primary string, token_count int, folded string, display string, occurrence_count long, document_frequency long, most long, note_type_counts map<string, long>"
_ARROW = pa.schema(
    [
        ("language", pa.string()), ("primary", pa.string()), ("token_count", pa.int32()), ("folded", pa.string()), ("display", pa.string()), ("occurrence_count", pa.int64()),
        ("document_frequency", pa.int64()), ("most", pa.int64()), ("note_type_counts", pa.map_(pa.string(), pa.int64())),
    ]
)


def _coded(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers for the values of a column (null is one of them), and the values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    encoded = column.dictionary_encode(null_encoding="encode")
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def _numbered(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the different values."""
    return pd.factorize(values)[0].astype(np.int64)


def _is_plain(piece: str) -> bool:
    """A token or gap that is the same in the primary form, whatever stands beside it."""
    return piece.isascii() and primary_form(f"x{piece}x") == f"x{piece}x"


# --- what a task has counted, as bytes -------------------------------------------------------------------------------


def _numbers(values: np.ndarray) -> tuple[str, bytes]:
    small = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return small.dtype.str, small.tobytes()


def _read_numbers(stored: tuple[str, bytes]) -> np.ndarray:
    return np.frombuffer(stored[1], stored[0]).astype(np.int64)


def _texts(values: pa.Array) -> tuple:
    if not len(values):
        return _numbers(np.zeros(0, dtype=np.int64)), b""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return _numbers(np.diff(ends).astype(np.int64)), data[int(ends[0]) : int(ends[-1])].to_pybytes() if data is not None else b""


def _read_texts(stored: tuple) -> pa.Array:
    lengths = _read_numbers(stored[0])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(stored[1]))


def counted(rows: pa.Table, shortest: int, longest: int, buckets: int, part: str | None) -> Iterator[tuple[int, bytes]]:
    """(bucket, counts) of sentences ``doc_id, language, note_type, tokens, gaps``: for each surface its occurrences by
    note type; on one surface of each phrase the phrase's documents and the most occurrences in one of them.

    With ``part`` the sentences are a part of that document, and documents and most are left open."""
    lists = rows.column("tokens").combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(row))  # tokens from here to the end of the sentence
    token, token_values = _coded(lists.flatten())
    gap, gap_values = _coded(rows.column("gaps").combine_chunks().flatten())
    gap = gap[np.arange(len(row)) + row]  # the gap before each token; a sentence has one gap more than tokens
    language, languages = _coded(rows.column("language"))
    note, notes = _coded(rows.column("note_type"))
    document = _coded(rows.column("doc_id"))[0][row]
    language, note = language[row], note[row]
    token_plain, gap_plain = (np.array([_is_plain(v) for v in values.to_pylist()], dtype=bool) for values in (token_values, gap_values))
    # every surface gets a number from the number of its beginning and of what it goes on with: no two share one
    step = _numbered(gap * len(token_values) + token)
    steps = int(step.max(initial=0)) + 1
    at, number = np.arange(len(row)), language * len(token_values) + token
    found: list[tuple] = []
    for n in range(1, longest + 1):
        if n > 1:
            goes_on = left[at] >= n
            at, number = at[goes_on], number[goes_on]
            number = number * steps + step[at + n - 1]
        if not len(at):
            break
        number = _numbered(number)
        if n < shortest:
            continue
        first = np.empty(int(number.max()) + 1, dtype=np.int64)
        first[number[::-1]] = at[::-1]
        pieces, plain = [token_values.take(pa.array(token[first]))], token_plain[token[first]]
        for k in range(1, n):
            pieces += [gap_values.take(pa.array(gap[first + k])), token_values.take(pa.array(token[first + k]))]
            plain &= gap_plain[gap[first + k]] & token_plain[token[first + k]]
        surface = primary = pc.binary_join_element_wise(*pieces, "") if n > 1 else pieces[0]
        phrase = np.arange(len(first))
        if not plain.all():
            primary = pc.replace_with_mask(surface, pa.array(~plain), pa.array([primary_form(v) for v in surface.filter(pa.array(~plain)).to_pylist()], pa.string()))
            if not primary.equals(surface):
                codes, values = _coded(primary)
                phrase = _numbered(language[first] * len(values) + codes)
        phrases = int(phrase.max()) + 1
        documents = most = np.zeros(len(first), dtype=np.int64)
        if part is None:
            met, times = np.unique(document[at] * phrases + phrase[number], return_counts=True)
            met %= phrases
            documents, most, one = np.bincount(met, minlength=phrases), np.zeros(phrases, dtype=np.int64), np.zeros(len(first), dtype=bool)
            np.maximum.at(most, met, times)
            one[np.unique(phrase, return_index=True)[1]] = True
            documents, most = np.where(one, documents[phrase], 0), np.where(one, most[phrase], 0)
        cell, times = np.unique(number * len(notes) + note[at], return_counts=True)
        found.append((primary, surface, language[first], token[first], np.full(len(first), n), documents, most, cell // len(notes), cell % len(notes), times))
    if not found:
        return
    sizes = np.cumsum([0, *(len(f[0]) for f in found)])
    primary, surface = (pa.concat_arrays([f[i] for f in found]) for i in (0, 1))
    language, token, count, documents, most = (np.concatenate([f[i] for f in found]) for i in range(2, 7))
    owner, note, times = np.concatenate([f[7] + begin for f, begin in zip(found, sizes)]), *(np.concatenate([f[i] for f in found]) for i in (8, 9))
    bucket = (pd.util.hash_array(primary.to_numpy(zero_copy_only=False), categorize=False) % buckets).astype(np.int64)
    # phrases that begin alike stand together, which compresses well
    order = np.argsort((bucket * len(languages) + language) * len(token_values) + token, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    cells = np.argsort(place[owner], kind="stable")
    owner, note, times = place[owner][cells], note[cells], times[cells]
    primary, surface = primary.take(pa.array(order)), surface.take(pa.array(order))
    bucket, language, count, documents, most = (a[order] for a in (bucket, language, count, documents, most))
    other = pc.not_equal(primary, surface).to_numpy(zero_copy_only=False)
    codec, names = pa.Codec("zstd", 3), (languages.to_pylist(), notes.to_pylist())
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:]):
        c, d = np.searchsorted(owner, [a, b])
        changed = np.flatnonzero(other[a:b])
        plain = pickle.dumps(
            (
                part, names, _texts(primary.slice(a, b - a)), _numbers(changed), _texts(surface.take(pa.array(changed + a))), *(_numbers(x[a:b]) for x in (language, count, documents, most)),
                _numbers(np.bincount(owner[c:d] - a, minlength=b - a)), _numbers(note[c:d]), _numbers(times[c:d]),
            )
        )
        yield int(bucket[a]), len(plain).to_bytes(8, "big") + codec.compress(plain, asbytes=True)


def put_together(stored: list[bytes], least: int) -> pa.Table:
    """``SCHEMA`` of one bucket: the phrases in at least so many documents."""
    codec = pa.Codec("zstd")
    blobs = [pickle.loads(codec.decompress(s[8:], int.from_bytes(s[:8], "big"), asbytes=True)) for s in stored]
    primary, surface, language, note, part = [], [], [], [], []
    for p, (languages, notes), texts, changed, others, spoken, _, _, _, _, noted, _ in blobs:
        primary.append(_read_texts(texts))
        mask = np.zeros(len(primary[-1]), dtype=bool)
        mask[_read_numbers(changed)] = True
        surface.append(pc.replace_with_mask(primary[-1], pa.array(mask), _read_texts(others)) if mask.any() else primary[-1])
        language.append(pa.array(languages, pa.string()).take(pa.array(_read_numbers(spoken))))
        note.append(pa.array(notes, pa.string()).take(pa.array(_read_numbers(noted))))
        part.append(pa.array([p], pa.string()).take(pa.array(np.zeros(len(mask), dtype=np.int64))))
    primary, surface, language, note, part = (pa.concat_arrays(x) for x in (primary, surface, language, note, part))
    count, documents, most, cells, times = (np.concatenate([_read_numbers(blob[i]) for blob in blobs]) for i in (6, 7, 8, 9, 11))
    spoken, languages = _coded(language)
    codes, _ = _coded(primary)
    phrase, rows = pd.factorize((codes * len(languages) + spoken) * (int(count.max()) + 1) + count)
    phrase = phrase.astype(np.int64)
    size = len(rows)
    first = np.empty(size, dtype=np.int64)
    first[phrase[::-1]] = np.arange(len(phrase))[::-1]
    frequency, top = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    np.add.at(frequency, phrase, documents)
    np.maximum.at(top, phrase, most)
    owner = np.repeat(np.arange(len(phrase)), cells)
    if part.null_count < len(part):
        # documents that were counted in parts: each is one more, with what all its parts have
        parts, names = _coded(part)
        open_ = ~part.is_null().to_numpy(zero_copy_only=False)[owner]
        pairs, inverse = np.unique(phrase[owner][open_] * len(names) + parts[owner][open_], return_inverse=True)
        sums = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(sums, inverse, times[open_])
        np.add.at(frequency, pairs // len(names), 1)
        np.maximum.at(top, pairs // len(names), sums)
    kept = np.flatnonzero(frequency >= least)
    if not len(kept):
        return _ARROW.empty_table()
    rank = np.full(size, -1, dtype=np.int64)
    rank[kept] = np.arange(len(kept))
    of = rank[phrase[owner]]
    owner, times, note, of = owner[of >= 0], times[of >= 0], note.filter(pa.array(of >= 0)), of[of >= 0]

    def added(values: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Occurrences by phrase and value: phrase, value, occurrences, in the order of both."""
        codes, names = _coded(values)
        by_name = pc.sort_indices(names).to_numpy()
        place = np.empty(len(names), dtype=np.int64)
        place[by_name] = np.arange(len(names))
        pairs, inverse = np.unique(of * len(names) + place[codes], return_inverse=True)
        sums = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(sums, inverse, times)
        return pairs // len(names), names.take(pa.array(by_name[pairs % len(names)])), sums

    noted, types, type_sums = added(note)
    shown, surfaces, surface_sums = added(surface.take(pa.array(owner)))
    best = np.lexsort((np.arange(len(shown)), -surface_sums, shown))
    best = best[np.flatnonzero(np.diff(shown[best], prepend=-1))]
    occurrences = np.zeros(len(kept), dtype=np.int64)
    np.add.at(occurrences, of, times)
    chosen = pa.array(first[kept])
    primary = primary.take(chosen)
    offsets = pa.array(np.searchsorted(noted, np.arange(len(kept) + 1)).astype(np.int32))
    columns = [
        language.take(chosen), primary, pa.array(count[first[kept]].astype(np.int32)), pa.array([folded_form(p) for p in primary.to_pylist()], pa.string()), surfaces.take(pa.array(best)),
        pa.array(occurrences), pa.array(frequency[kept]), pa.array(top[kept]), pa.MapArray.from_arrays(offsets, types, pa.array(type_sums)),
    ]
    return pa.Table.from_arrays(columns, schema=_ARROW)


def _chunks(stream: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, str | None]]:
    """Sentences in order of their documents, as tables of whole documents, or with its name as a part of one that
    has more than ``most`` tokens."""

    def name(held: pa.Table, row: int) -> str:
        value = held.column("doc_id")[row].as_py()
        return "" if value is None else f"={value}"

    def cut(held: pa.Table) -> tuple[pa.Table, str | None]:
        """What begins with more of an open document, up to that document's end."""
        ends = same(held, 0) if open_as is not None and name(held, 0) == open_as else 0
        return (held.slice(0, ends), open_as) if ends else (held, None)

    def same(held: pa.Table, row: int) -> int:
        codes = _coded(held.column("doc_id"))[0]
        return int((codes == codes[row]).sum())  # a document's rows follow each other

    batches: list[pa.RecordBatch] = []
    size, open_as = 0, None
    for batch in stream:
        batches.append(batch)
        size += len(batch.column("tokens").flatten())
        if size < most:
            continue
        held = pa.Table.from_batches(batches)
        more, named = cut(held)
        if named is not None:
            yield more, named
            held = held.slice(len(more))
        whole = len(held) - same(held, -1) if len(held) else 0
        if whole:
            yield held.slice(0, whole), None
            open_as = None
            held = held.slice(whole)
        elif len(held):
            open_as = name(held, -1)
            yield held, open_as
            held = held.slice(len(held))
        batches = held.to_batches()
        size = sum(len(b.column("tokens").flatten()) for b in batches)
    if any(len(b) for b in batches):
        held = pa.Table.from_batches(batches)
        more, named = cut(held)
        if named is not None:
            yield more, named
            held = held.slice(len(more))
        if len(held):
            yield held, None


def aggregates(documents: DataFrame, shortest: int = 1, longest: int = 4, min_document_frequency: int = 1) -> DataFrame:
    """:func:`~noteloom.operators.mining.phrase_aggregates` of a corpus; rows of a document may be repeated."""
    ship(documents.sparkSession)
    total, size = documents.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets, most = LEAST_BUCKETS + size // BUCKET_BYTES, CHUNK_TOKENS

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, part in _chunks(stream, most):
            for bucket, stored in counted(rows, shortest, longest, buckets, part):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([stored], pa.binary())], names=["bucket", "stored"])

    def finish(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, s) for batch in stream for b, s in zip(*(batch.column(i).to_pylist() for i in range(2))))
        for _, own in groupby(rows, key=lambda x: x[0]):
            yield from put_together([s for _, s in own], min_document_frequency).to_batches(max_chunksize=BATCH_ROWS)

    together = documents.select("doc_id", "language", "note_type", "text").repartition("doc_id").sortWithinPartitions("doc_id")
    rows = tokens(together).where(F.size("tokens") >= max(shortest, 1)).select("doc_id", "language", "note_type", "tokens", "gaps")
    stored = rows.mapInArrow(count, "bucket long, stored binary").repartition("bucket").sortWithinPartitions("bucket")
    score = (1 + F.log("most")) * (F.log((F.lit(total) + 1) / (F.col("document_frequency") + 1)) + 1)
    return stored.mapInArrow(finish, SCHEMA).withColumn("max_sublinear_tf_idf", six_places(score)).drop("most")
