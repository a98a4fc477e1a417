"""Best-fit packing of tokenized documents by hierarchical residual packing.

Every partition tokenizes its documents and packs them by best fit, longest first. Bins that are
nearly full are emitted; the emptiest ones go up a tree of merges as items, where they are packed
again by best fit, eight groups at a time, until one group is left. After a round at most one bin
of a group is half full or less, so a merge needs few of the others: a group passes on at most
``PASSED`` bins and emits the rest as they stand.

Defined cases: a NULL or empty text is the end token alone; a document longer than ``size`` is cut
into pieces of ``size`` tokens and a shorter last one; repeated rows are packed like others; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.frames import released
from kymo.session import materialized

PASSED, FAN_IN = 64, 8
#: Words that a worker remembers; beyond half of that it forgets those not met since the last time.
WORDS = 250_000
#: Bytes of text that are encoded at a time.
SLICE = 2 << 20
#: A letter and the mark behind it; not "|", which ends the names of added tokens.
MARKED = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,;:!?%$&*#])"
SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?%$&*#|]*)")


class WordIds:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    No token of the tokenizer crosses a space or a line feed, so a text is the sequence of its
    chunks between them, and each chunk is encoded once. Chunks of Latin letters with punctuation
    behind them, whose normal form is their lower case, go through the model many at a time; the
    token that ends a word tells them apart. All others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        known, older = self.known, self.older
        simple, hard, words = [], [], set()
        for chunk in chunks:
            if m := SIMPLE.fullmatch(chunk):
                word, marks = m.groups()
                word = word.lower()
                if word not in known:
                    if (code := older.get(word)) is None:
                        words.add(word)
                    else:
                        known[word] = code
                if word != chunk:
                    simple.append((chunk, word, marks))
                    if marks not in known:
                        hard.append(marks)
            else:
                hard.append(chunk)
        for chunk, code in zip(hard, self.whole.encode_batch_fast(hard, add_special_tokens=False), strict=True):
            known[chunk] = np.array(code.ids, dtype="<u4").tobytes()
        fresh = list(words)
        for at in range(0, len(fresh), 250):
            some = fresh[at : at + 250]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            code = ids.tobytes()
            lo = 0
            for word, hi in zip(some, ends.tolist(), strict=True):
                known[word] = code[lo:hi]
                lo = hi
        for chunk, word, marks in simple:
            known[chunk] = known[word] + known[marks]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        # marks behind a letter are chunks of their own, with the same tokens; Arrow finds the distinct chunks
        spaced = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), MARKED, r"\1 \2")
        lists = pc.split_pattern(spaced, " ")
        coded = lists.flatten().dictionary_encode()
        codes = self._codes(coded.dictionary.to_pylist())
        # the ids of all occurrences, gathered from those of the distinct chunks
        sizes = np.array([len(c) for c in codes], np.int64) // 4
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(codes), "<u4")[np.arange(n.sum()) + np.repeat(starts[at] - ends + n, n)].tobytes()
        bounds = np.concatenate([[0], 4 * ends])[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])]
        return [ids[lo:hi] for lo, hi in itertools.pairwise(bounds.tolist())]

    def _codes(self, chunks: list[str]) -> list[bytes]:
        if len(self.known) > WORDS // 2:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        unknown = []
        for chunk in chunks:
            if chunk not in known:
                if (code := older.get(chunk)) is None:
                    unknown.append(chunk)
                else:
                    known[chunk] = code
        self._learn(unknown)
        return [known[c] for c in chunks]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The coder of this worker process: tokenizers and the memory of words serve all its tasks."""
    return WordIds(path)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Longest first, each into the fullest bin that has room: bin and offset of each item, fill of
    each bin. A set bit of ``open_`` says that a bin with that much room exists."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    open_ = 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_ ^= 1 << room
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        room -= n
        if room:
            by_room[room].append(b)
            open_ |= 1 << room
    return bins, offsets, fills


def _passed(fills: np.ndarray, size: int) -> np.ndarray:
    """The bins that go up the tree: the emptiest, without those that are nearly full."""
    emptiest = np.argsort(fills, kind="stable")[:PASSED]
    return emptiest[fills[emptiest] < size - size // 128]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``SLICE`` bytes of text, a longer text with others before it."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    place = (np.cumsum(sizes) - sizes) // SLICE
    bounds = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
    for lo, hi in itertools.pairwise(bounds):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _local(path: str, size: int, end: int, id_type: pa.DataType):
    schema = pa.schema(
        [
            ("id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
            ("ids_crc32", pa.int64()), ("part", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()),
            ("fill", pa.int64()), ("passed", pa.bool_()),
        ]
    )
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        ids, rows = [], []
        for batch in batches:
            for some in _slices(batch):
                owners = []
                for j, code in enumerate(coder.encode(some.column(1))):
                    code += tail
                    for k, cut in enumerate(range(0, len(code), 4 * size)):
                        piece = code[cut : cut + 4 * size]
                        owners.append(j)
                        rows.append((k, cut // 4, len(piece) // 4, zlib.crc32(piece)))
                ids.append(some.column(0).take(pa.array(owners, pa.int32())))
        if not rows:
            return
        piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        bins, offsets, fills = best_fit(length, size)
        fill = np.array(fills)
        up = np.zeros(len(fill), bool)
        up[_passed(fill, size)] = True
        part = np.full(len(length), TaskContext.get().partitionId(), np.int64)
        table = pa.table(
            [
                pa.chunked_array(ids, id_type), piece.astype(np.int32), start, length, crc, part, bins, offsets,
                fill[bins], up[bins],
            ],
            schema=schema,
        )
        yield from table.to_batches(50_000)

    return run, schema


def _merge(size: int, last: bool):
    """Pack the open bins of one group. Rows are the local bins, ``root`` the bin they are in so
    far; a bin that is not passed on gets ``open`` false and stays as it is."""

    def run(table: pa.Table) -> pa.Table:
        frame = table.to_pandas()
        live = frame[frame["open"]]
        roots = live.drop_duplicates("root")
        bins, offsets, fills = best_fit(roots["root_fill"].to_numpy(), size)
        fill = np.array(fills)
        up = np.zeros(len(fill), bool)
        if not last:
            up[_passed(fill, size)] = True
        new_root = roots.groupby(bins)["root"].transform("min").to_numpy()
        for name, value in (("root", new_root), ("shift", offsets), ("root_fill", fill[bins]), ("open", up[bins])):
            at = live["root"].map(dict(zip(roots["root"], value, strict=True)))
            frame.loc[live.index, name] = frame.loc[live.index, name] + at if name == "shift" else at
        frame = frame.astype({"root": "int64", "shift": "int64", "root_fill": "int64", "open": "bool"})
        return pa.Table.from_pandas(frame, schema=table.schema, preserve_index=False)

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a vocabulary file whose tokens never cross white space; ``end`` is
    the id that closes each document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.limit(0).toArrow().schema.field("id").type
    run, schema = _local(tokenizer, size, end, id_type)
    kind = rows.schema["id"].dataType.simpleString()
    local = materialized(
        rows.mapInArrow(
            released(run),
            f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, "
            "fill long, passed boolean",
        ),
        "packed",
    )
    parts = (local.agg(F.max("part")).first()[0] or 0) + 1
    root = F.col("part") * F.lit(1 << 32) + F.col("bin")
    # a handful of bins from each partition
    bins = (
        local.where("passed")
        .select("part", "bin", root.alias("root"), F.lit(0).cast("long").alias("shift"), F.col("fill").alias("root_fill"), F.lit(True).alias("open"))
        .distinct()
    )
    width = 1
    while width < parts:
        width *= FAN_IN
        bins = bins.groupBy(F.floor(F.col("part") / width)).applyInArrow(_merge(size, width >= parts), bins.schema)
    return (
        local.join(bins.select("part", "bin", "root", "shift"), ["part", "bin"], "left")
        .select(
            F.col("id").alias(id_col),
            "piece",
            "start",
            "length",
            "ids_crc32",
            F.coalesce("root", root).alias("sequence_id"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    )
