"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix, with bounds taken from sizes.

`similarity_classes(docs)` has a row for each document whose set of word n-grams has a Jaccard index of THRESHOLD or more with another document's:
doc_id, class_id (the least doc_id of all that such links connect, through others too), copies (documents with exactly its set, itself included) and
links (other documents at the threshold or above, copies included). `similar_sets(docs)` has the links themselves, between different sets.

1. N-grams that HOT documents or more have (a millionth of all n-grams, where that is more) are found in a first pass. They aren't shuffled by columns: that many documents share them is known.
2. The incidence matrix is shuffled once in blocks of columns. Columns with a single document can't contribute and end there.
3. The others go back to their documents. A pair at the threshold has at least THRESHOLD * size n-grams in common, so a document
   with fewer n-grams in shared columns is dropped with all its pairs. Equal sets become one, however many documents have it.
4. The same bound says that two similar sets share one of their rarest size - ceil(THRESHOLD * size) + 1 n-grams. The product over
   these columns alone, with pairs of too unequal sizes discarded, gives the candidates.
5. Candidates are gathered in blocks of sets; the sparse product of a block's rows with their candidates' rows accumulates the exact overlaps.
6. Where more than RUN sets have an n-gram among their rarest, their pairs aren't candidates: they would grow with the square of the sets. All sets that such n-grams
   connect are a group, and a group is multiplied with itself, tile by tile: every pair of it is counted exactly, once and nowhere else, and
   only each set's number of links and a spanning forest leave a tile.

Documents shorter than n words have one n-gram, of all their words. Null texts and texts without words have no n-grams and
no links. Rows without doc_id can't be named and are left out. Rows that agree in doc_id are one document: never linked with itself, in one class, and
with the links of each of its different texts. An empty table gives no rows. Only doc_id and text are read. Word hashes have 64 bits, n-grams 48 bits and those
of the block of columns: about 1 in 10^8 n-grams is taken for another one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, materialise, mix, ngrams, text_bytes, words_of

NGRAM, THRESHOLD = 5, 0.5
#: N-grams in a block of columns, bytes of text in a block of rows, documents in a tile of the last product.
COLUMNS, ROWS, TILE = 1_200_000, 5_000_000, 3000
#: Documents of an n-gram that isn't shuffled by columns; pairs held at once.
HOT, PAIRS = 500_000, 2_000_000
#: Sets with an n-gram among their rarest beyond which they are a group; sets, and bytes of n-grams, in a tile of a group.
RUN, GROUP_TILE, GROUP_BYTES = 100, 2000, 4_000_000
#: Blocks of columns that the upper 16 bits of an n-gram tell apart; beyond them the next 8 bits split each block.
SPLIT = 1 << 16
BLOCKS = "bucket int, block long, docs binary, grams binary"
EPS = 1e-9


def grams_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The sorted set of a document's n-grams."""
    return np.unique(ngrams(hashes, min(n, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def _pack6(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack6(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _batch(schema: str, **columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[t]) for n, t in (c.split() for c in schema.split(", "))], names=[c.split()[0] for c in schema.split(", ")])


def _by_bucket(bucket: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions in each bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(count + 1))
    for b in range(count):
        if bounds[b] < bounds[b + 1]:
            yield b, order[bounds[b] : bounds[b + 1]]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")


def hot_grams(docs: DataFrame, n: int, rows: int, size: int) -> np.ndarray:
    """Sorted n-grams that `hot` documents or more have, two million at most. Tasks pass on what is frequent enough among their own documents, with its count; what they don't is less than half of that."""
    hot = max(HOT, size // 6_000_000)
    share = hot / 2 / max(1, rows)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def frequent() -> pa.RecordBatch:
            grams, often = np.unique(np.concatenate(held), return_counts=True)
            some = often > share * number
            return pa.RecordBatch.from_arrays([pa.array(grams[some].view(np.int64)), pa.array(often[some])], ["gram", "n"])

        if share >= 1:  # fewer documents than that in all
            return
        for batch in batches:
            for first, end, words in words_of(batch.column(0)):
                held += [grams_of(words.hashes[a:b], n) for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())]
                size, number = size + len(words.data), number + end - first
                if size >= 2 * ROWS:
                    yield frequent()
                    held, size, number = [], 0, 0
        if held:
            yield frequent()

    found = _texts(docs).select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot // 2)
    return np.sort(np.array([r["gram"] for r in found.collect()], np.int64).view(np.uint64))


def incidence(docs: DataFrame, n: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Blocks of the matrix: a block of rows (bucket < 0: ids, sizes and signatures of its documents, and their hot n-grams) or a block of rows and columns (uint32 row, 48 bits of column)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows, grams, held = [], [], 0
            for first, end, words in words_of(batch.column(1)):
                for i in range(end - first):
                    g = grams_of(words.hashes[words.bounds[i] : words.bounds[i + 1]], n)
                    if len(g):
                        rows.append(ids[first + i])
                        grams.append(g)
                held += len(words.data)
                if rows and (held >= ROWS or end == len(ids)):
                    yield _matrix_block(block, rows, grams, buckets, hot)
                    block, rows, grams, held = block + 1, [], [], 0
            if rows:
                yield _matrix_block(block, rows, grams, buckets, hot)
                block += 1

    return _texts(docs).mapInArrow(cut, BLOCKS)


def _split(buckets: int) -> tuple[int, int]:
    """Blocks by the upper bits, and parts of each."""
    return min(buckets, SPLIT), min(256, -(-buckets // SPLIT))


def _matrix_block(block: int, rows: list, grams: list, buckets: int, hot: np.ndarray) -> pa.RecordBatch:
    sizes = np.array([len(g) for g in grams], "<i8")
    every, row = np.concatenate(grams), np.repeat(np.arange(len(rows), dtype=np.uint32), sizes)
    small = np.uint16 if len(rows) < 1 << 16 else np.uint32
    with np.errstate(over="ignore"):  # equal sets, and hardly others, have equal signatures
        sig = mix(np.add.reduceat(mix(every ^ np.uint64(0x5555555555555555)), np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
    is_hot = hot[np.minimum(np.searchsorted(hot, every), len(hot) - 1)] == every if len(hot) else np.zeros(len(every), bool)
    head = np.array(rows, "<i8").tobytes() + sizes.tobytes() + sig.tobytes()
    out = {"bucket": [-1 - block % buckets], "block": [block], "docs": [np.int64(len(rows)).tobytes() + head + row[is_hot].astype("<u4").tobytes()], "grams": [every[is_hot].tobytes()]}
    every, row = every[~is_hot], row[~is_hot]
    whole, parts = _split(buckets)
    bucket = ((every >> np.uint64(48)).astype(np.int64) * whole >> 16) * parts + (((every >> np.uint64(40)) & np.uint64(255)).astype(np.int64) * parts >> 8)
    for b, at in _by_bucket(bucket, whole * parts):
        out["bucket"].append(b)
        out["block"].append(block)
        out["docs"].append(row[at].astype(small).tobytes())
        out["grams"].append(_pack6(every[at]))
    return _batch(BLOCKS, **out)


def _rows(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * count else np.uint32)


SHARED = "block long, docs binary, grams binary, often binary, bucket int"


def shared_columns(part: pa.Table) -> pa.Table:
    """A block of columns: only those with two rows or more go on, each with its number of rows."""
    bucket, blocks = part.column("bucket")[0].as_py(), part.column("block").to_pylist()
    docs, grams = part.column("docs").to_pylist(), part.column("grams").to_pylist()
    if bucket < 0:
        return pa.Table.from_batches([_batch(SHARED, block=blocks, docs=docs, grams=grams, often=grams, bucket=[bucket] * len(blocks))])
    values = [_unpack6(g) for g in grams]
    every = np.concatenate(values)
    order = np.argsort(every)
    new = np.concatenate(([True], every[order[1:]] != every[order[:-1]]))
    starts = np.flatnonzero(new)
    often = np.empty(len(every), np.uint16)
    often[order] = np.minimum(np.repeat(np.diff(np.append(starts, len(every))), np.diff(np.append(starts, len(every)))), 65535)
    out, at = {"block": [], "docs": [], "grams": [], "often": []}, 0
    for block, d, v in zip(blocks, docs, values):
        count = often[at : at + len(v)]
        keep = count > 1
        at += len(v)
        if keep.any():
            out["block"].append(block)
            out["docs"].append(_rows(d, len(v))[keep].tobytes())
            out["grams"].append(_pack6(v[keep]))
            out["often"].append(count[keep].tobytes())
    return pa.Table.from_batches([_batch(SHARED, **out, bucket=[bucket] * len(out["block"]))])


SETS = "doc_id long, size long, sig long, grams binary"


def bounded_rows(threshold: float, parts: int = 1):
    def keep(part: pa.Table) -> pa.Table:
        """A block of rows, with its n-grams in shared columns: documents that can have a partner, their n-grams rarest first."""
        ids = None
        row, gram, often = [], [], []
        for bucket, d, g, o in zip(*(part.column(c).to_pylist() for c in ("bucket", "docs", "grams", "often"))):
            if bucket < 0:
                count = int(np.frombuffer(d, np.int64, 1)[0])
                ids, sizes, sigs = np.frombuffer(d, "<i8", 3 * count, 8).reshape(3, count)
                gram.append(np.frombuffer(g, np.uint64))
                row.append(np.frombuffer(d, "<u4", offset=8 + 24 * count).astype(np.int64))
                often.append(np.full(len(gram[-1]), 65535, np.uint16))
            else:
                v = _unpack6(g)
                gram.append(v | np.uint64(bucket // parts) << np.uint64(48))
                row.append(_rows(d, len(v)).astype(np.int64))
                often.append(np.frombuffer(o, np.uint16))
        out = {"doc_id": [], "size": [], "sig": [], "grams": []}
        if ids is not None:
            row, gram, often = np.concatenate(row), np.concatenate(gram), np.concatenate(often)
            order = np.lexsort((gram, often, row))
            gram = gram[order]
            bounds = np.searchsorted(row[order], np.arange(len(ids) + 1))
            for i in np.flatnonzero(np.diff(bounds) >= np.maximum(1, threshold * sizes - EPS)):
                out["doc_id"].append(int(ids[i]))
                out["size"].append(int(sizes[i]))
                out["sig"].append(int(sigs[i]))
                out["grams"].append(gram[bounds[i] : bounds[i + 1]].tobytes())
        return pa.Table.from_batches([_batch(SETS, **out)])

    return keep


HEADS = np.dtype([("sig", "<i8"), ("size", "<i8"), ("grp", "<i8")])


def prefixes(sets: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """Blocks of the matrix that have each set's rarest n-grams only, with its group if it has one. N-grams in columns of its own are the rarest of all, and not here."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.empty(batch.num_rows, HEADS)
            heads["sig"], heads["size"], heads["grp"] = (batch.column(c).to_numpy() for c in (0, 1, 3))
            parts = []
            for size, g in zip(heads["size"].tolist(), batch.column(2).to_pylist()):
                g = np.frombuffer(g, np.uint64)
                parts.append(g[: max(0, len(g) - int(np.ceil(threshold * size - EPS)) + 1)])
            every, row = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p) for p in parts])
            out = {"bucket": [], "block": [], "docs": [], "grams": []}
            for b, at in _by_bucket((mix(every) >> np.uint64(33)).astype(np.int64) * buckets >> 31, buckets):
                used, local = np.unique(row[at], return_inverse=True)
                out["bucket"].append(b)
                out["block"].append(len(used))
                out["docs"].append(heads[used].tobytes() + local.astype(np.uint32).tobytes())
                out["grams"].append(every[at].tobytes())
            yield _batch(BLOCKS, **out)

    return sets.select("sig", "size", "grams", "grp").mapInArrow(cut, BLOCKS)


def _connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (each group's least position) after the links a, b are added."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (label != (further := label[label])).any():
            label = further
    return label


def _pairs_in_runs(item: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, groups: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """Codes i * len(sizes) + j of the pairs i < j within runs of `item`, sizes near enough, not of one group (0: of none); some millions at a time, each of these once."""
    starts = np.cumsum(lengths) - lengths
    n = len(sizes)

    def tiles() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for m in np.unique(lengths[lengths > 1]).tolist():
            at = starts[lengths == m]
            i, j = np.triu_indices(m, 1)
            step = max(1, 1_000_000 // len(i))
            for k in range(0, len(at), step):
                runs = item[at[k : k + step, None] + np.arange(m)]
                yield runs[:, i].ravel(), runs[:, j].ravel()

    found, waiting = [], 0
    for a, b in tiles():
        a, b = np.minimum(a, b), np.maximum(a, b)
        sa, sb = sizes[a], sizes[b]
        fits = (a != b) & (np.minimum(sa, sb) >= threshold * np.maximum(sa, sb) - EPS) & ((groups[a] != groups[b]) | (groups[a] == 0))
        found.append(np.unique(a[fits] * n + b[fits]))
        waiting += len(found[-1])
        if waiting > PAIRS:
            found = [np.unique(np.concatenate(found))]
            waiting = len(found[0])
            if waiting > PAIRS // 2:
                yield found.pop()
                waiting = 0
    if found:
        yield np.unique(np.concatenate(found))


def _runs(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of a block of columns, each once, and runs of them by n-gram with their lengths."""
    heads, rows, grams, at = [], [], [], 0
    for batch in batches:
        for count, d, g in zip(*(batch.column(c).to_pylist() for c in ("block", "docs", "grams"))):
            heads.append(np.frombuffer(d, HEADS, count))
            rows.append(np.frombuffer(d, np.uint32, offset=count * HEADS.itemsize).astype(np.int64) + at)
            grams.append(np.frombuffer(g, np.uint64))
            at += count
    heads, rows, grams = np.concatenate(heads), np.concatenate(rows), np.concatenate(grams)
    _, first, of = np.unique(heads["sig"], return_index=True, return_inverse=True)
    order = np.lexsort((of[rows], grams))
    g = grams[order]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return heads[first], of[rows[order]], np.diff(np.append(starts, len(g)))


def _edges(sig: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(sig[at]), pa.array(sig[label[at]])], ["a", "b"])


def crowded(run: int):
    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block of columns: a spanning forest of the sets that n-grams of more than `run` sets connect."""
        heads, item, lengths = _runs(batches)
        starts = np.cumsum(lengths) - lengths
        many = lengths > run
        inside = np.repeat(many, lengths)
        yield _edges(heads["sig"], _connect(np.arange(len(heads)), item[inside], item[np.repeat(starts[many], lengths[many])]))

    return connect


def candidates(threshold: float, run: int):
    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The product over a block of columns: pairs of sets with an overlap and sizes that allow the threshold, but for those within a group, in which n-grams of more than `run` sets have all of theirs."""
        heads, item, lengths = _runs(batches)
        few = lengths <= run
        for codes in _pairs_in_runs(item[np.repeat(few, lengths)], lengths[few], heads["size"], heads["grp"], threshold):
            yield pa.RecordBatch.from_arrays([pa.array(heads["sig"][codes // len(heads)]), pa.array(heads["sig"][codes % len(heads)])], ["a", "b"])

    return product


LINKS = "a long, b long, overlap long, jaccard double, copies_a long, copies_b long"


def overlaps(threshold: float):
    def product(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        """Exact overlaps of the pairs of a tile: each row of the tile is spread over its columns once and multiplied by the rows of its candidates."""
        kinds = [np.int64, np.int64, np.int64, np.float64, np.int64, np.int64]
        names = [c.split()[0] for c in LINKS.split(", ")]
        if not pairs.num_rows or not sets.num_rows:
            return pa.table({c: np.zeros(0, k) for c, k in zip(names, kinds)})
        sig = sets.column("s_sig").to_numpy()
        order = np.argsort(sig)
        sig = sig[order]
        size, copies = sets.column("s_size").to_numpy()[order], sets.column("s_copies").to_numpy()[order]
        blobs = sets.column("s_grams").combine_chunks() if sets.column("s_grams").num_chunks != 1 else sets.column("s_grams").chunk(0)
        grams = [np.frombuffer(blobs[i].as_buffer(), np.uint64) for i in order.tolist()]
        every, ends = np.concatenate(grams), np.cumsum([len(g) for g in grams])
        _, column, often = np.unique(every, return_inverse=True, return_counts=True)
        in_two = often[column] > 1
        ends = np.concatenate(([0], np.cumsum(in_two)))[np.concatenate(([0], ends))]
        column = (np.cumsum(often > 1) - 1)[column[in_two]].astype(np.int32)
        a, b = (np.searchsorted(sig, pairs.column(c).to_numpy()) for c in ("p_a", "p_b"))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        overlap = np.zeros(len(a), np.int64)
        spread = np.zeros(int((often > 1).sum()), np.uint8)
        rows = [column[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(a)]):
            spread[rows[a[x]]] = 1
            for k in range(x, y, 2000):
                others = [rows[j] for j in b[k : min(k + 2000, y)].tolist()]
                sums = np.concatenate(([0], np.cumsum(spread[np.concatenate(others)], dtype=np.int64)))
                to = np.cumsum([len(o) for o in others])
                overlap[k : k + len(others)] = sums[to] - sums[np.concatenate(([0], to[:-1]))]
            spread[rows[a[x]]] = 0
        union = size[a] + size[b] - overlap
        fits = (overlap > 0) & (overlap >= threshold * union - EPS)
        a, b, overlap, union = a[fits], b[fits], overlap[fits], union[fits]
        return pa.table(dict(zip(names, (sig[a], sig[b], overlap, overlap / np.maximum(union, 1), copies[a], copies[b]))))

    return product


def _dense_overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlaps of all rows of one tile with all of another: frequent columns as a dense product, others by pairs of their rows."""
    n, m = len(left), len(right)
    row = np.concatenate((np.repeat(np.arange(n), [len(g) for g in left]), n + np.repeat(np.arange(m), [len(g) for g in right])))
    _, column = np.unique(np.concatenate(left + right), return_inverse=True)
    in_left = row < n
    width = int(column.max()) + 1
    f, h = np.bincount(column[in_left], minlength=width), np.bincount(column[~in_left], minlength=width)
    out = np.zeros((n, m), np.float32)  # exact up to 2^24 n-grams
    dense = np.flatnonzero(f * h * 200 > n * m)
    place = np.full(width, -1)
    place[dense] = np.arange(len(dense))
    for k in range(0, len(dense), 1024):
        at = np.flatnonzero((place[column] >= k) & (place[column] < k + 1024))
        block = np.zeros((n + m, min(1024, len(dense) - k)), np.float32)
        block[row[at], place[column[at]] - k] = 1
        out += block[:n] @ block[n:].T
    rest = (place[column] < 0) & (f * h > 0)[column]
    order = np.lexsort((row[rest], column[rest]))
    row, column = row[rest][order], column[rest][order]
    sparse = np.unique(column)
    start, f, h = np.searchsorted(column, sparse), f[sparse], h[sparse]
    pairs = np.cumsum(f * h)
    at = 0
    while at < len(sparse):  # some million pairs at a time
        end = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + 1_000_000, "right")))
        of = np.repeat(np.arange(at, end), (f * h)[at:end])
        k = np.arange(len(of)) - np.repeat(np.cumsum((f * h)[at:end]) - (f * h)[at:end], (f * h)[at:end])
        np.add.at(out, (row[start[of] + k // h[of]], row[start[of] + f[of] + k % h[of]] - n), 1)
        at = end
    return out


DEGREES = "sig long, n long, a long, b long"


def within_groups(threshold: float, expand: bool):
    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two tiles of a group, or one with itself: the links between them, or each set's number of links to documents and a spanning forest."""
        part = pa.Table.from_batches(list(batches))
        sig, size, copies, tile = (part.column(c).to_numpy() for c in ("sig", "size", "copies", "tile"))
        grams = [np.frombuffer(g, np.uint64) for g in part.column("grams").to_pylist()]
        order = np.argsort(tile, kind="stable")
        sig, size, copies, tile, grams = sig[order], size[order], copies[order], tile[order], [grams[i] for i in order.tolist()]
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        n, to = int((tile == i).sum()), int((tile == i).sum()) if i != j else 0
        if not n or to == len(sig):
            return
        overlap = _dense_overlaps(grams[:n], grams[to:])
        degree, label = np.zeros(len(sig), np.int64), np.arange(len(sig))
        step = max(1, 500_000 // (len(sig) - to))
        for k in range(0, n, step):
            both = overlap[k : k + step].astype(np.int64)
            union = size[k : min(k + step, n), None] + size[None, to:] - both
            fits = (both > 0) & (both >= threshold * union - EPS)
            if i == j:
                fits &= np.arange(k, k + len(both))[:, None] < np.arange(n)
            a, b = np.nonzero(fits)
            if expand:
                x, y, o, u = a + k, b + to, both[a, b], union[a, b]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (sig[x], sig[y], o, o / u, copies[x], copies[y])], [c.split()[0] for c in LINKS.split(", ")])
                continue
            degree[k : k + len(both)] += fits @ copies[to:]
            degree[to:] += copies[k : k + len(both)] @ fits
            label = _connect(label, a + k, b + to)
        if not expand:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (sig, degree, sig, sig[label])], [c.split()[0] for c in DEGREES.split(", ")])

    return product


def _groups(sets: DataFrame, threshold: float, buckets: int) -> DataFrame | None:
    """sig, grp of the sets in groups, where there are any."""
    run = RUN
    edges = materialise(prefixes(sets.withColumn("grp", F.lit(0).cast("long")), threshold, buckets).groupBy("bucket").applyInArrow(crowded(run), "a long, b long"), "crowded")
    if edges.isEmpty():
        return None
    # 0 stands for no group; a set of that signature has a name of its own as a group.
    return materialise(components(edges).select(F.col("doc").alias("sig"), F.when(F.col("grp") == 0, F.lit(1)).otherwise(F.col("grp")).alias("grp")), "groups")


def _tiles(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """The sets of groups, once for each pair of tiles i <= j of its group that has its own one."""
    held = sets.join(groups, "sig")
    many = held.groupBy("grp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP_TILE, F.sum(F.octet_length("grams")) / GROUP_BYTES)).cast("int").alias("tiles"))
    placed = held.join(many, "grp").withColumn("tile", F.pmod(F.xxhash64("sig"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    return placed.select("grp", "sig", "size", "copies", "grams", "tile", other).select("grp", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "sig", "size", "copies", "grams", "tile")


def _linked(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame | None, DataFrame, DataFrame]:
    """Links between different sets that aren't of one group; the tiles of the groups, if there are any; sets and members."""
    count, size = text_bytes(docs)
    buckets = buckets_for(size / 6, COLUMNS)
    back = incidence(docs, n, buckets, hot_grams(docs, n, count, size)).groupBy("bucket").applyInArrow(shared_columns, SHARED)
    every = materialise(back.groupBy("block").applyInArrow(bounded_rows(threshold, _split(buckets)[1]), SETS), "rows")
    members = every.select("doc_id", "sig").distinct()
    held = members.groupBy("sig").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # Equal sets have equal blobs, so which one stays doesn't matter; tasks keep one of each before they shuffle.
    once = every.groupBy("sig").agg(F.first("size").alias("size"), F.first("grams").alias("grams"))
    sets = materialise(once.join(held, "sig"), "sets")
    blocks = max(6, buckets // 8)
    groups = _groups(sets, threshold, blocks)
    grouped = sets.withColumn("grp", F.lit(0).cast("long")) if groups is None else sets.join(groups, "sig", "left").withColumn("grp", F.coalesce("grp", F.lit(0)))
    pairs = materialise(prefixes(grouped, threshold, blocks).groupBy("bucket").applyInArrow(candidates(threshold, RUN), "a long, b long").distinct(), "candidates")
    # Near copies mostly share their least neighbour, so a block around it has most of their pairs, and their sets once.
    centre = pairs.groupBy("b").agg(F.min("a").alias("least")).select(F.col("b").alias("a"), "least")
    blocked = pairs.join(centre, "a", "left").withColumn("centre", F.coalesce("least", "a")).drop("least")
    in_block = blocked.select("centre", F.explode(F.array("a", "b")).alias("sig")).distinct()
    tiles = in_block.groupBy("centre").agg(F.ceil(F.count("sig") / TILE).cast("int").alias("tiles"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("tiles"))
    tiled = blocked.join(tiles, "centre").select("centre", F.col("a").alias("p_a"), F.col("b").alias("p_b"), F.least(part("a"), part("b")).alias("i"), F.greatest(part("a"), part("b")).alias("j"))
    tiled = materialise(tiled, "tiles")
    wanted = tiled.select("centre", "i", "j", F.explode(F.array("p_a", "p_b")).alias("s_sig")).distinct()
    # Merged at every size: broadcast while the candidates are few, this join would only begin to shuffle as they grow.
    rows = sets.select(F.col("sig").alias("s_sig"), F.col("size").alias("s_size"), F.col("copies").alias("s_copies"), F.col("grams").alias("s_grams")).hint("merge")
    placed = wanted.join(rows, "s_sig").select(F.col("centre").alias("s_centre"), F.col("i").alias("s_i"), F.col("j").alias("s_j"), "s_sig", "s_size", "s_copies", "s_grams")
    links = tiled.groupBy("centre", "i", "j").cogroup(placed.groupBy("s_centre", "s_i", "s_j")).applyInArrow(overlaps(threshold), LINKS)
    return materialise(links, "links"), None if groups is None else _tiles(sets, groups), sets.select("sig", "size", "least", "copies"), members


def similar_sets(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links a, b, overlap, jaccard, copies_a, copies_b between different sets, named by signatures; sets sig, size, least (doc_id), copies; and members doc_id, sig. Only sets that may have a partner are here. Links within groups are made as they are read."""
    links, tiles, sets, members = _linked(docs, n, threshold)
    if tiles is not None:
        links = links.unionByName(tiles.groupBy("grp", "i", "j").applyInArrow(within_groups(threshold, True), LINKS))
    return links, sets, members


def linked_sets(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """sig, n (documents with other sets that it is linked to); edges a, b that connect what links connect; sets and members as in `similar_sets`. No row for each link of a group is made."""
    links, tiles, sets, members = _linked(docs, n, threshold)
    ends = links.select(F.col("a").alias("sig"), F.col("copies_b").alias("n")).unionByName(links.select(F.col("b").alias("sig"), F.col("copies_a").alias("n")))
    edges = links.select("a", "b")
    if tiles is not None:
        within = materialise(tiles.groupBy("grp", "i", "j").applyInArrow(within_groups(threshold, False), DEGREES), "within-groups")
        ends, edges = ends.unionByName(within.select("sig", "n")), edges.unionByName(within.select("a", "b").filter("a <> b"))
    return ends.groupBy("sig").agg(F.sum("n").alias("n")), edges, sets, members


def classes(links: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, sig, class_id of every member; a set without links is a class with its copies, and one document's sets are in one class."""
    several = members.groupBy("doc_id").agg(F.min("sig").alias("b"), F.max("sig").alias("a")).filter("a <> b")
    edges = links.select("a", "b").unionByName(members.join(several.select("doc_id", "b"), "doc_id").select(F.col("sig").alias("a"), "b"))
    grouped = sets.join(components(edges).select(F.col("doc").alias("sig"), "grp"), "sig", "left").select("sig", "least", F.coalesce("grp", "sig").alias("grp"))
    named = grouped.groupBy("grp").agg(F.min("least").alias("class_id"))
    return members.join(grouped.join(named, "grp").select("sig", "class_id"), "sig")


def similarity_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    degree, edges, sets, members = linked_sets(docs, n, threshold)
    counted = sets.join(degree, "sig", "left").select("sig", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")).filter("links > 0")
    placed = classes(edges, sets, members).join(counted, "sig")
    return placed.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("copies").alias("copies"), F.sum("links").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """doc, group (the least doc of its connected component) for every doc of the edges (a, b), a > b. Rounds of joins that hook each document's neighbours to the least of them and then shorten the paths, until nothing changes; each round is written to the shared folder."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        # Large star: larger neighbours of a document are hooked to its least neighbour, itself included; small star: the same for smaller ones.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = materialise(large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("doc"), F.col("b").alias("grp")).unionByName(edges.select(F.col("b").alias("doc"), F.col("b").alias("grp")).distinct())


def without_near_copies(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, of each class only the one with the least doc_id. Rows that agree in doc_id are one document. Rows without doc_id stay. Columns are carried whatever their names."""
    gone = classes(*linked_sets(docs, n, threshold)[1:]).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")


#: The same by joins of n-grams as strings.
ORACLE = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_\\x{{80}}-\\x{{10ffff}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {NGRAM} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {NGRAM} + 2), lambda i: array_to_string(w[i : i + {NGRAM - 1}], ' ')) END) AS g FROM words WHERE len(w) > 0),
numbered AS (SELECT g, row_number() OVER () AS gram FROM grams GROUP BY g HAVING count(*) > 1),
held AS (SELECT doc_id, gram FROM grams JOIN numbered USING (g)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM held a JOIN held b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b, s.n = x.n AND s.n = y.n AS equal FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE s.n >= {THRESHOLD} * (x.n + y.n - s.n) - {EPS}),
reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, CAST(1 + count(*) FILTER (equal) AS BIGINT) AS copies, CAST(count(*) AS BIGINT) AS links FROM class JOIN links ON links.a = doc_id GROUP BY doc_id, class_id"""
