"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded whole and once. The tokens' byte lengths give each token's span of code
points, and the spans are joined with the sections' intervals by binary search. A token that crosses
a boundary goes to one section by an explicit rule:

* ``first``: the section that holds the token's first character;
* ``most``: the section that holds most of its characters, the earlier of equals;
* ``share``: every section, in proportion to the characters it holds.

Under ``first`` and ``most`` the counts of sections without gaps and overlaps add up to the
document's tokens. A character whose bytes lie in several tokens counts for each of them.

Defined cases: a NULL text is empty; without sections a document's lines are its sections, each with
its line feed, and an empty text is one empty line; a section that reaches beyond the text is cut; an
empty section has no token; overlapping sections each get the tokens that are theirs alone under
``share``, else the section that begins last before the character owns it; repeated rows come out as
often as they go in; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "most", "share")


class Offsets:
    """Whole-text encoder with the span of code points of each token."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last code point of each token."""
        ends = np.cumsum(self.sizes[self.coder.encode_ordinary(text)])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        if len(raw) == len(text):
            return starts, ends
        at = np.cumsum((raw & 0xC0) != 0x80)  # code points begun up to each byte
        return at[starts] - 1, at[ends - 1]


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feed; at least one."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cuts = np.flatnonzero(raw == 10) + 1
    edges = np.unique(np.concatenate([[0], cuts, [len(raw)]]))
    return (edges[:-1], edges[1:]) if len(edges) > 1 else (np.zeros(1, np.int64), np.zeros(1, np.int64))


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. Tokens are in order, so those that overlap a section are a run."""
    if rule == "share":
        lo = np.searchsorted(last, starts, side="right")
        hi = np.searchsorted(first, ends, side="left")
        run = np.maximum(hi - lo, 0)
        token = np.repeat(lo - np.concatenate([[0], np.cumsum(run)[:-1]]), run) + np.arange(run.sum())
        owner = np.repeat(np.arange(len(starts)), run)
        part = np.minimum(last[token], ends[owner]) - np.maximum(first[token], starts[owner])
        return np.bincount(owner, np.maximum(part, 0) / (last[token] - first[token]), minlength=len(starts))
    order = np.argsort(starts, kind="stable")
    order = order[ends[order] > starts[order]]
    if not len(order):
        return np.zeros(len(starts), np.float64)
    s, e = starts[order], ends[order]

    def owner(position: np.ndarray) -> np.ndarray:
        at = np.searchsorted(s, position, side="right") - 1
        return np.where((at >= 0) & (position < e[np.maximum(at, 0)]), at, -1)

    own = owner(first)
    if rule == "most":
        end = owner(last - 1)
        for i in np.flatnonzero(own != end):  # few: tokens that cross a boundary
            inside = owner(np.arange(first[i], last[i]))
            count = np.bincount(inside[inside >= 0], minlength=1)
            own[i] = int(count.argmax()) if count.any() else -1
    counts = np.zeros(len(starts), np.float64)
    counts[order] = np.bincount(own[own >= 0], minlength=len(order))
    return counts


def section_tokens(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
    rule: str = "first",
) -> DataFrame:
    """One row per section: id, section (its place), name, char_start, char_end, n_tokens.

    ``sections_col`` holds an array of (name, start, end) in code points, end excluded; without it
    a document's lines are its sections, without a name.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, got {rule!r}")
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    if sections_col:
        spans = F.transform(
            sections_col,
            lambda s: F.struct(s["name"].cast("string").alias("name"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")),
        )
        columns.append(F.coalesce(spans, F.array().cast("array<struct<name:string,start:bigint,end:bigint>>")).alias("sections"))
    rows = docs.select(*columns)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = Offsets(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                given = some.column("sections").to_pylist() if sections_col else [None] * some.num_rows
                owner, place, names, lo, hi, n = [], [], [], [], [], []
                for i, (text, sections) in enumerate(zip(some.column("text").to_pylist(), given, strict=True)):
                    text = text or ""
                    if sections is None:
                        starts, ends = line_sections(text)
                        label = [None] * len(starts)
                    else:
                        starts = np.clip(np.array([s["start"] or 0 for s in sections], np.int64), 0, len(text))
                        ends = np.array([len(text) if s["end"] is None else s["end"] for s in sections], np.int64)
                        ends = np.maximum(np.clip(ends, 0, len(text)), starts)
                        label = [s["name"] for s in sections]
                    first, last = offsets.spans(text)
                    owner.append(np.full(len(starts), i))
                    place.append(np.arange(len(starts)))
                    names += label
                    lo.append(starts)
                    hi.append(ends)
                    n.append(attribute(first, last, starts, ends, rule))
                if owner:
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column("id").take(pa.array(np.concatenate(owner))),
                            pa.array(np.concatenate(place).astype(np.int32)),
                            pa.array(names, pa.string()),
                            pa.array(np.concatenate(lo).astype(np.int64)),
                            pa.array(np.concatenate(hi).astype(np.int64)),
                            pa.array(np.concatenate(n).astype(np.float64)),
                        ],
                        ["id", "section", "name", "char_start", "char_end", "n_tokens"],
                    )

    out = rows.mapInArrow(run, f"id {kind}, section int, name string, char_start long, char_end long, n_tokens double")
    return out.withColumnRenamed("id", id_col)
