"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two machines work one after the other.  The outer one cuts a text into pretokens; a piece of text is summarised by what
it does to any state it is entered in (open head, tokens between, open tail), and such summaries compose associatively,
so pieces are counted apart and folded by a prefix scan.  The inner one reads the bytes of a pretoken and annotates each
transition with the tokens it adds, a number that may be negative when a byte merges what stood before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern by which the byte-level pre-tokenizer cuts text.
PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Between a letter and a single space that a letter follows, every state of the outer machine ends its pretoken.
_JOINT = regex.compile(r"(?<=\p{L}) (?=\p{L})")
#: Characters per piece, most states that are compiled, and entries at which a table of known results starts anew.
PIECE, STATES, KNOWN = 1 << 16, 100_000, 300_000


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary: printable ones for themselves, the rest from U+0100 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTransducer:
    """Deterministic transducer over bytes whose outputs sum to the number of BPE tokens.

    A state holds, for every place where a token may still be open, the node that its bytes since have reached in the trie of
    all tokens, the token that ends there and how many tokens lie behind it, relative to now. It rests on a property of
    merge-ordered BPE: a prefix has one last token, the longest that is compatible with the last token before it, and two
    neighbours are compatible if merging their join never comes first. Transitions are compiled where paths meet again:
    each run adds the first one that it lacks and steps through the rest of its bytes without states.
    """

    def __init__(self, vocab: dict[str, int], merges: list):
        letters = _byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        # own numbering: single bytes first, then results of merges by rank, so a smaller number merges earlier
        number = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in pairs:
            a, b = number[spell(left)], number[spell(right)]
            no = number.setdefault(spell(left + right), len(self.halves))
            if no == len(self.halves):
                self.halves.append((a, b))
            self.merged.setdefault((a, b), no)
        # the trie: edges by (node, byte), the token that ends at a node (or -1), and whether it has edges
        self.edges: dict[int, int] = {}
        self.ends, self.inner = [-1], bytearray(1)
        for token, no in number.items():
            node = 0
            for byte in token:
                self.inner[node] = 1
                node = self.edges.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    self.inner.append(0)
            self.ends[node] = no
        self.joins: dict[int, bool] = {}
        start = ((0, -1, 0),)
        self.states: list[tuple] = [start]
        self.ids: dict[tuple, int] = {start: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def compatible(self, left: int, right: int) -> bool:
        """Would BPE leave ``left right`` as two tokens?  Undo merges at the join, latest first, and look for an earlier one across it."""
        limit = len(self.halves)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                return False
            if self.halves[left] is None and self.halves[right] is None:
                return True
            if self.halves[right] is None or (self.halves[left] is not None and left > right):
                limit, left = left, self.halves[left][1]
            else:
                # equal ranks merge from the left, so a join of the rank just undone on the right still comes first
                limit, right = right + 1, self.halves[right][0]

    def _join(self, left: int, right: int) -> bool:
        if len(self.joins) > KNOWN:
            self.joins.clear()
        fits = self.joins[left << 20 | right] = self.compatible(left, right)
        return fits

    def _step(self, places: list[tuple], byte: int) -> list[tuple]:
        """Open places (node, token, tokens up to it) after one more byte; the last of them is the new end."""
        edges, ends, inner, joins = self.edges, self.ends, self.inner, self.joins
        opened, last, total = [], -1, 0
        for node, token, behind in places:  # the oldest place first: the longest token that fits
            node = edges.get(node << 8 | byte)
            if node is None:
                continue
            if last < 0:
                no = ends[node]
                if no >= 0:
                    fits = True if token < 0 else joins.get(token << 20 | no)
                    if fits or (fits is None and self._join(token, no)):
                        last, total = no, behind + 1
            if inner[node]:
                opened.append((node, token, behind))
        opened.append((0, last, total))
        return opened

    def count(self, data: bytes) -> int:
        state = total = 0
        moves = self.moves
        for i, byte in enumerate(data):
            move = moves[state].get(byte)
            if move is None:
                break
            state, added = move
            total += added
        else:
            return total
        places = self._step([(n, t, total + b) for n, t, b in self.states[state]], byte)
        if len(self.states) < STATES:
            now = places[-1][2]
            new = tuple([(n, t, b - now) for n, t, b in places])
            no = self.ids.setdefault(new, len(self.states))
            if no == len(self.states):
                self.states.append(new)
                moves.append({})
            moves[state][byte] = (no, now - total)
        step = self._step
        for byte in data[i + 1 :]:
            places = step(places, byte)
        return places[-1][2]


class _Counts(dict):
    """Tokens per pretoken, computed by the byte machine when first met; kept for one to two times ``KNOWN`` others."""

    def __init__(self, machine: ByteTransducer):
        self.machine, self.old = machine, {}

    def __missing__(self, pretoken: str) -> int:
        n = self.old.get(pretoken)
        if n is None:
            n = self.machine.count(pretoken.encode("utf-8", "replace"))
        if len(pretoken) <= 64:
            if len(self) > KNOWN:
                self.old = dict(self)
                self.clear()
            self[pretoken] = n
        return n


@dataclass(frozen=True)
class PieceMap:
    """What a piece does to any state: ``head`` goes to the pretoken open at entry, ``tail`` is open at exit.

    ``inner`` is None if no joint lies inside; the piece then only lengthens what is open, and ``head`` is all of it.
    """

    head: str
    inner: int | None = None
    tail: str = ""


class TokenTransducer:
    """Counts of whole texts; special tokens of the file are found first, as the library does."""

    def __init__(self, path: str, piece: int = PIECE):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.counts = _Counts(ByteTransducer(spec["model"]["vocab"], spec["model"]["merges"]))
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.piece = piece

    def _closed(self, text: str) -> int:
        counts = self.counts
        return sum([counts[p] for p in PRETOKEN.findall(text)])

    def map_of(self, piece: str) -> PieceMap:
        first = _JOINT.search(piece)
        if first is None:
            return PieceMap(piece)
        last = first.start()
        # the last joint: search a growing end of the piece
        width = 256
        while True:
            begin = max(len(piece) - width, first.start())
            found = [m.start() for m in _JOINT.finditer(piece, begin)]
            if found or begin == first.start():
                last = found[-1] if found else last
                break
            width *= 4
        return PieceMap(piece[: first.start()], self._closed(piece[first.start() : last]), piece[last:])

    def compose(self, a: PieceMap, b: PieceMap) -> PieceMap:
        """The map of two neighbouring pieces; associative up to joints that fall on their border, which stay open."""
        if a.inner is None:
            return PieceMap(a.head + b.head, b.inner, b.tail)
        if b.inner is None:
            return PieceMap(a.head, a.inner, a.tail + b.head)
        return PieceMap(a.head, a.inner + self._closed(a.tail + b.head) + b.inner, b.tail)

    def _plain(self, text: str) -> int:
        if len(text) <= self.piece:
            return self._closed(text)
        maps = [self.map_of(text[i : i + self.piece]) for i in range(0, len(text), self.piece)]
        while len(maps) > 1:  # a tree of compositions
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        whole = maps[0]
        return self._closed(whole.head) + (0 if whole.inner is None else whole.inner + self._closed(whole.tail))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        between = self.special.split(text)
        return len(between) - 1 + sum(self._plain(t) for t in between if t)


_LOADED: dict[str, TokenTransducer] = {}


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # compiled once per Python worker, which serves many tasks
        machine = _LOADED.get(path) or _LOADED.setdefault(path, TokenTransducer(path))
        for batch in batches:
            n = [machine.count(t.as_py()) for t in batch.column("text")]
            columns = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(n, pa.int64())], [*columns, "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``vocabulary`` is the path of a tokenizer file that every executor can open.  Null texts count as empty, with 0 bytes
    and tokens; repeated rows are counted each; only doc_id and text are read; an empty table gives an empty table.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(_counter(vocabulary), f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
