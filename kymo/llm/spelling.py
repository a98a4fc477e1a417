"""Spelling variants: words one edit apart, and the frequent form that each rare one leads to.

A word is a vector of letter counts, one for each letter group of ``GROUPS``. Words stand in a trie
by these counts, one group a level. Two words one edit apart differ by a surplus of at most one letter
and a deficit of at most one, so a depth-first search from the root carries both budgets and leaves a
branch as soon as one is overspent; what reaches a leaf is verified letter by letter.

The trie's first levels are the rows' partitioning: a word lives in the subtree of its first counts,
and visits the later ones that the budgets allow. The number of levels is the smallest at which no
subtree holds more than ``SUBTREE`` words; a subtree that stays larger is dealt out in blocks, each
with a trie of its own that all visitors search. So a task's trie is bounded and visitors stream.

Defined cases: a NULL text has no words; a row without an id has the empty id when it is decided
which letters are lost; repeated rows count each; very long texts and runs are read whole; ties of n
go to the word that is smaller in code-point order; extra columns are not read, whatever their names;
an empty table gives an empty result.
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

from kymo.llm.frames import small
from kymo.session import materialized

LEAST, RARER = 7, 10
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST)
#: Letters in the order of the trie's levels; others share four groups.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
GROUPS = len(LETTERS) + 4
#: Words of a task's trie; levels by which rows are dealt out; words of a leaf that is not split
#: further; visitors searched at once; word pairs verified at once; words reported and counted at once.
SUBTREE, LEVELS, LEAF, VISITORS, PAIRS, REPORTED, COUNTED = 50_000, (2, 3, 4, 6, 8, 12), 12, 1 << 17, 1 << 18, 50_000, 200_000


def _lower(text: str) -> str:
    """A-Z in lower case, other letters as they are."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def spelled(doc_id, text: str | None, every: int = 31) -> Counter:
    """Words of at least ``LEAST`` letters of a document and their numbers. One run in ``every``
    loses a letter, both by the checksum of the id and the run."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(_lower(text))).items() if text else ():
        h = zlib.crc32(run.encode(), head)
        if not h % every:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST:
                continue
        out[run] += n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def ended():
        words = list(total)
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([total[w] for w in some], pa.int64())], ["word", "n"])
        total.clear()

    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            total.update(spelled(doc_id, text))
            if len(total) >= COUNTED:
                yield from ended()
    yield from ended()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """(word, n) of all words that occur at least ``least`` times; counted in tasks, then summed."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least)


class Spellings:
    """Words of a block with their vectors, in the order of the trie."""

    WIDTH = 24
    _group = {ord(c): i for i, c in enumerate(LETTERS)}

    def __init__(self, words: list[str], n: np.ndarray, ordered: bool = False):
        length = np.array([len(w) for w in words], np.int32)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        groups = np.array([self._group.get(p, len(LETTERS) + p % 4) for p in range(256)], np.int64)[points]
        owner = np.repeat(np.arange(len(words)), length)
        vector = np.bincount(owner * GROUPS + groups, minlength=GROUPS * len(words)).reshape(-1, GROUPS).astype(np.int32)
        order = np.lexsort(vector.T[::-1]) if ordered else np.arange(len(words))
        self.words, self.n, self.length = [words[i] for i in order], n[order], length[order]
        self.vector = np.ascontiguousarray(vector[order])
        # first and last letters, and which groups have an odd count
        starts = np.cumsum(length) - length
        near = np.arange(self.WIDTH)
        at = np.minimum(starts[:, None] + near, len(points) - 1)
        self.left = np.where(near < length[:, None], points[at], 0).astype(np.uint8)[order]
        at = np.maximum((starts + length)[:, None] - 1 - near, 0)
        self.right = np.where(near < length[:, None], points[at], 0).astype(np.uint8)[order]
        self.odd = ((self.vector & 1).astype(np.uint32) << np.arange(GROUPS, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
        self.head = self.left[:, :4].copy().view("<u4").ravel()
        self.tail = self.right[:, :4].copy().view("<u4").ravel() & np.uint32(0xFFFFFF)


def one_edit(a: Spellings, i: np.ndarray, b: Spellings, j: np.ndarray) -> np.ndarray:
    """Whether word ``a[i]`` is one inserted, deleted or replaced letter away from ``b[j]``: what they
    share at the front and at the back covers all but one letter of the longer. The first four or
    the last three letters are then the same, as words have seven."""
    sizes = a.length[i], b.length[j]
    may = (np.bitwise_count(a.odd[i] ^ b.odd[j]) <= 2) & (np.abs(sizes[0] - sizes[1]) <= 1)
    may &= (a.head[i] == b.head[j]) | (a.tail[i] == b.tail[j])
    at = np.flatnonzero(may)
    i, j = i[at], j[at]
    longer, shorter = np.maximum(a.length[i], b.length[j]), np.minimum(a.length[i], b.length[j])

    def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        differ = x[i] != y[j]
        return np.where(differ.any(axis=1), differ.argmax(axis=1), Spellings.WIDTH)

    front = np.minimum(shared(a.left, b.left), shorter)
    back = np.minimum(shared(a.right, b.right), shorter)
    yes = (front + back >= longer - 1) & ~((front == longer) & (longer == shorter))
    for k in np.flatnonzero(longer > Spellings.WIDTH):  # letters beyond the arrays
        yes[k] = _one_edit(a.words[i[k]], b.words[j[k]])
    may[at] = yes
    return may


def _one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def search(trie: Spellings, visitors: Spellings, level: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (word of ``trie``, visitor) of all pairs one edit apart. The search is depth-first over
    the ranges of the ordered words that agree in the counts so far, with the visitors that have not
    overspent a surplus or a deficit of one."""
    leaves: list[tuple[int, int, np.ndarray]] = []
    pending = 0

    def verified():
        nonlocal pending
        sizes = np.array([(hi - lo) * len(v) for lo, hi, v in leaves])
        i = np.concatenate([np.repeat(np.arange(lo, hi), len(v)) for lo, hi, v in leaves]) if len(sizes) else np.zeros(0, np.int64)
        j = np.concatenate([np.tile(v, hi - lo) for lo, hi, v in leaves]) if len(sizes) else i
        leaves.clear()
        pending = 0
        for at in range(0, len(i), PAIRS):
            x, y = i[at : at + PAIRS], j[at : at + PAIRS]
            near = one_edit(trie, x, visitors, y)
            if near.any():
                yield x[near], y[near]

    todo = [(level, 0, len(trie.words), np.arange(len(visitors.words)), np.zeros(len(visitors.words), np.int8), np.zeros(len(visitors.words), np.int8))]
    while todo:
        level, lo, hi, alive, surplus, deficit = todo.pop()
        if hi - lo <= LEAF or level == GROUPS:
            step = max(1, PAIRS // max(1, len(alive)))  # many anagrams: a few words at a time
            for at in range(lo, hi, step):
                end = min(hi, at + step)
                leaves.append((at, end, alive))
                pending += (end - at) * len(alive)
                if pending >= PAIRS:
                    yield from verified()
            continue
        counts = trie.vector[lo:hi, level]
        own = visitors.vector[alive, level]
        edges = [0, *(np.flatnonzero(counts[1:] != counts[:-1]) + 1).tolist(), hi - lo]
        for start, end in zip(edges, edges[1:], strict=False):
            more = counts[start] - own
            up, down = surplus + (more > 0), deficit + (more < 0)
            live = (np.abs(more) <= 1) & (up <= 1) & (down <= 1)
            if live.any():
                todo.append((level + 1, lo + start, lo + end, alive[live], up[live], down[live]))
    yield from verified()


class _Found:
    """Near words of each word, merged as they are found: their number and the best of them."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, of: Spellings, i: np.ndarray, by: Spellings, j: np.ndarray) -> None:
        """``by[j]`` are near words of ``of[i]``."""
        if not len(i):
            return
        order = np.lexsort((-by.n[j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        last = [*first[1:].tolist(), len(i)]
        for lo, hi in zip(first.tolist(), last, strict=True):
            n = by.n[j[lo]]
            ties = j[lo : lo + np.searchsorted(-by.n[j[lo:hi]], -n, "right")]
            self.rows.append((of.words[i[lo]], hi - lo, int(n), min(by.words[k] for k in ties)))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            names = ["word", "near", "near_n", "best"]
            columns = zip(*self.rows, strict=True)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        self.rows = []


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block, role): the words of a trie (role 0), then its visitors, of the
    same subtree (1) or of an earlier one (2)."""
    found = _Found()
    now, trie, part, gathered = None, None, None, []

    def flush():
        nonlocal trie, gathered
        if not gathered:
            return
        words = [w for some, _ in gathered for w in some]
        n = np.concatenate([x for _, x in gathered])
        gathered = []
        role = part[1]
        if role == 0:
            trie = visitors = Spellings(words, n, ordered=True)
        else:
            visitors = Spellings(words, n)
        if trie is None:
            return
        for at in range(0, len(words), VISITORS):
            some = visitors if len(words) <= VISITORS else Spellings(visitors.words[at : at + VISITORS], visitors.n[at : at + VISITORS])
            for i, j in search(trie, some):
                found.add(some, j, trie, i)
                if role == 2:  # a word visits later subtrees only
                    found.add(trie, i, some, j)
                if len(found.rows) >= REPORTED:
                    yield from found.batches()
        yield from found.batches()

    for batch in batches:
        key, block, role = (batch.column(c).to_pylist() for c in ("key", "block", "role"))
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        lo = 0
        for at in range(1, batch.num_rows + 1):
            if at < batch.num_rows and role[at] == role[lo] and block[at] == block[lo] and key[at] == key[lo]:
                continue
            unit = (key[lo], block[lo])
            if part != (unit, role[lo]):
                yield from flush()
                if unit != now:
                    now, trie = unit, None
                part = (unit, role[lo])
            gathered.append((words[lo:at], n[lo:at]))
            if role[lo] and sum(len(w) for w, _ in gathered) >= VISITORS:
                yield from flush()
            lo = at
    yield from flush()


def _count(letter: str):
    return F.length("word") - F.length(F.replace("word", F.lit(letter), F.lit("")))


def _shifts(levels: int) -> list[tuple[int, ...]]:
    """Differences of the first counts within both budgets that lead to a later subtree."""
    out = []
    for up in range(-1, levels):
        for down in range(-1, levels):
            if up != down or up < 0:
                shift = tuple((k == up) - (k == down) for k in range(levels))
                if shift > (0,) * levels:
                    out.append(shift)
    return out


def near_words(words: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """(word, n_near, best_n, best) of all words of ``words`` (word, n) that have a near word; words
    are distinct and have seven letters at least."""
    counts = F.array(*(_count(c) for c in LETTERS[: LEVELS[-1]]))
    words = words.select("word", "n", counts.alias("counts"))
    for levels in LEVELS:
        key = lambda shift, k=levels: F.concat_ws(".", *(F.col("counts")[i] + shift[i] for i in range(k)))
        sizes = words.groupBy(key((0,) * levels).alias("key")).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= subtree:
            break
    sizes = materialized(sizes.select("key", F.ceil(F.col("count") / subtree).alias("blocks")), "subtrees")
    home = F.struct(key((0,) * levels).alias("key"), F.lit(0).alias("role"))
    visits = [F.struct(key(s).alias("key"), F.lit(2).alias("role")) for s in _shifts(levels)]
    rows = words.select("word", "n", F.inline(F.array(home, *visits))).join(small(sizes), "key")
    own = F.pmod(F.xxhash64("word"), "blocks")
    rows = rows.select("key", "word", "n", "role", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    role = F.when((F.col("role") == 0) & (F.col("own") != F.col("block")), 1).otherwise(F.col("role"))
    dealt = rows.select("key", "block", role.alias("role"), "word", "n")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "role")
    met = dealt.mapInArrow(_met, "word string, near long, near_n long, best string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("best").alias("word")))
    found = met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form (word, form). A form is ten times as frequent as its
    word, so chains have 19 links at most; each round doubles the links that a root has followed."""
    state = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = state.join(onward, "root", "left")
        state = materialized(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not state.where("moved").limit(1).count():
            return state.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", subtree: int = SUBTREE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = materialized(vocabulary(docs, id_col, text_col), "words")
    near = materialized(near_words(words, subtree), "near-words")
    rows = words.join(near, "word", "left").withColumn("formed", F.coalesce(F.col("best_n") >= RARER * F.col("n"), F.lit(False)))
    form = F.when(F.col("formed"), F.col("best"))
    rows = rows.select(
        "word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("formed"), F.col("best_n")).alias("form_n")
    )
    rows = materialized(rows, "formed")
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
