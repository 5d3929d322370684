"""Fill-in-the-middle rewriting of documents; an indexable skip list over lines finds both cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix

#: The tags of the training format, the seed of the draws, and the shares in hundredths.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
#: One node in four also stands in the next lane.
_THIN = 2


class SkipList:
    """Indexable skip list over the units of a text, each with its width in units, code points and bytes.

    Lane 0 holds the units. A node of an express lane stands for all nodes from its own place up to the next node of that
    lane, and carries their summed widths; ``down`` is its place in the lane below. Heights are drawn from the place of a
    unit, so a list is built the same every time.
    """

    def __init__(self, chars: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        lane = np.stack([np.ones(n, np.int64), chars.astype(np.int64), sizes.astype(np.int64)], axis=1)
        self.lanes, self.down = [lane], [np.empty(0, np.int64)]
        drawn = mix(np.arange(1, n + 1, dtype=np.uint64))
        place, height = np.arange(n), 1
        while len(place) > 1 << _THIN:
            above = drawn[place] & np.uint64((1 << _THIN * height) - 1) == 0
            above[0] = True  # the head stands in every lane
            at = np.flatnonzero(above)
            if len(at) == len(place):
                break
            self.lanes.append(np.add.reduceat(self.lanes[-1], at, axis=0))
            self.down.append(at)
            place, height = place[at], height + 1
        self.total = lane.sum(axis=0)

    def find(self, rank: int) -> tuple[int, int]:
        """Code points and bytes before unit ``rank``: go right while the accumulated width stays within it, then down."""
        seen, chars, size, at = 0, 0, 0, 0
        for level in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[level]
            while at < len(lane) and seen + lane[at, 0] <= rank:
                seen, chars, size, at = seen + int(lane[at, 0]), chars + int(lane[at, 1]), size + int(lane[at, 2]), at + 1
            if level:
                at = int(self.down[level][at]) if at < len(lane) else len(self.lanes[level - 1])
        return chars, size


def line_list(data: bytes) -> SkipList:
    """Skip list over the lines of a UTF-8 text; a line ends behind its line feed or with the text."""
    if not data:
        return SkipList(np.empty(0, np.int64), np.empty(0, np.int64))
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    starts = np.concatenate([[0], ends[:-1]])
    heads = np.add.reduceat(((raw & 0xC0) != 0x80).astype(np.int64), starts)
    return SkipList(heads, ends - starts)


def _rewrite(rate: int, spm_rate: int):
    tags = [t.encode() for t in (PREFIX, SUFFIX, MIDDLE)]

    def one(data: bytes, h1: int, h2: int, h3: int, h4: int):
        lines = line_list(data)
        n = int(lines.total[0])
        if not data or any(t in data for t in tags) or h3 % 100 >= rate:
            return n, "plain", None, None, data
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        (c1, b1), (c2, b2) = lines.find(low), lines.find(high)
        prefix, middle, suffix = data[:b1], data[b1:b2], data[b2:]
        p, s, m = tags
        if h4 % 100 < spm_rate:
            return n, "spm", c1, c2 - c1, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", c1, c2 - c1, b"".join((p, prefix, s, suffix, m, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                draws = zip(*(batch.column(f"h{i}").to_pylist() for i in (1, 2, 3, 4)), strict=True)
                rows = [one(t.as_buffer().to_pybytes(), *h) for t, h in zip(batch.column("text"), draws, strict=True)]
                n, form, p, m, out = zip(*rows, strict=True)
                arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers per document: the first four 8-digit groups of the hex sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars, output (the new text).

    Texts that are empty or hold one of the three tags stay plain, and so do those beyond the ``rate`` drawn; ``spm_rate``
    of 100 others put the suffix first. A null text counts as empty; a null doc_id draws as the empty string; repeated
    rows are rewritten alike; whole texts are cut however long, one at a time; an empty table gives an empty table. Only
    doc_id and text are read, so other columns may have any name. Equal cuts give an empty middle.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *draws(F.col("doc_id"), seed))
    return rows.mapInArrow(_rewrite(rate, spm_rate), f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The original text from a rewritten one. The parts hold no tag, so the three tags part it without doubt."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    first, second, middle = parts[1], parts[2], parts[3]
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
