"""Edit-aware token counts.

A document is cut into pre-tokens; its counts are kept in a segment tree whose
leaves hold up to LEAF pre-tokens each and whose nodes hold sums of characters,
tokens and pre-tokens. An edit (at, delete, insert) touches the pre-tokens that
overlap it; these and some context before are cut and encoded anew, going on
until a cut falls on an old one past the edit. Leaves that changed are replaced
and the sums above them updated; nothing else is read or encoded.

Context: the pre-token pattern looks ahead at most REACH characters past a
match, so a pre-token that ends REACH or more before the edit cannot change.

Cases. A null text counts as empty, null edits as none. Places are clipped to
the text as it is when the edit is applied; negative ones count as 0. Rows
without an id are answered with a null id, repeated rows once each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 64
REACH = 3
EDIT = "array<struct<at:int,delete:int,insert:string>>"


class PreTokenizer:
    """Byte-level BPE file of tiktoken's kind: the pattern, and the number of
    tokens of a pre-token, remembered."""

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > 300_000:
                self.known.clear()
            n = self.known[piece] = len(self.bpe.encode_ordinary(piece))
        return n

    def cut(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths and token counts of the pre-tokens."""
        pieces = self.find.findall(text)
        known = self.known
        try:
            return list(map(len, pieces)), [known[p] for p in pieces]
        except KeyError:
            return list(map(len, pieces)), [self.count(p) for p in pieces]


class CountTree:
    """sums[level][node] = (characters, tokens, pre-tokens); level 0 are the leaves."""

    def __init__(self, sizes: list[int], counts: list[int]) -> None:
        self.leaves = [(sizes[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(sizes), LEAF)] or [([], [])]
        self._grow()

    def _grow(self) -> None:
        self.sums = [[(sum(s), sum(c), len(s)) for s, c in self.leaves]]
        while len(self.sums[-1]) > 1:
            low = self.sums[-1]
            self.sums.append([self._plus(low[i : i + 2]) for i in range(0, len(low), 2)])

    @staticmethod
    def _plus(nodes: list) -> tuple[int, int, int]:
        return tuple(map(sum, zip(*nodes, strict=True)))

    @property
    def total(self) -> tuple[int, int, int]:
        return self.sums[-1][0]

    def find(self, at: int) -> tuple[int, int, int]:
        """The leaf of the pre-token that holds character ``at`` (the last leaf,
        if past the end), its first character, its place among pre-tokens."""
        node = chars = before = 0
        for level in range(len(self.sums) - 2, -1, -1):
            node *= 2
            c, _, p = self.sums[level][node]
            if at >= chars + c and node + 1 < len(self.sums[level]):
                node, chars, before = node + 1, chars + c, before + p
        return node, chars, before

    def replace(self, first: int, last: int, sizes: list[int], counts: list[int]) -> None:
        """Leaves first..last become these pre-tokens."""
        n = last - first + 1
        if len(sizes) <= 2 * LEAF * n and (sizes or n == len(self.leaves) == 1):
            step = max(1, -(-len(sizes) // n))
            for k in range(n):
                self.leaves[first + k] = (sizes[k * step : (k + 1) * step], counts[k * step : (k + 1) * step])
            self._update(first, last)
        else:
            new = [(sizes[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(sizes), LEAF)]
            self.leaves[first : last + 1] = new
            self.leaves = self.leaves or [([], [])]
            self._grow()

    def _update(self, first: int, last: int) -> None:
        for k in range(first, last + 1):
            s, c = self.leaves[k]
            self.sums[0][k] = (sum(s), sum(c), len(s))
        for level in range(1, len(self.sums)):
            first, last = first // 2, last // 2
            low = self.sums[level - 1]
            for k in range(first, last + 1):
                self.sums[level][k] = self._plus(low[2 * k : 2 * k + 2])


def apply_edit(tree: CountTree, text: str, at: int, delete: int, insert: str, pre: PreTokenizer) -> tuple[str, int]:
    """Apply an edit to text and tree; the new text and the number of
    pre-tokens that were encoded anew."""
    at = min(max(at, 0), len(text))
    end = min(at + max(delete, 0), len(text))
    new = text[:at] + insert + text[end:]
    shift = len(new) - len(text)
    first, start, _ = tree.find(max(0, at - REACH))
    if start >= max(1, at - REACH) and first:  # the context may begin in the leaf before
        first -= 1
        start -= tree.sums[0][first][0]
    # within the leaf, the last pre-token that begins REACH or more before the edit
    sizes, counts = tree.leaves[first]
    keep, pos = 0, start
    while keep < len(sizes) and pos + sizes[keep] + REACH <= at:
        pos += sizes[keep]
        keep += 1
    head_s, head_c = sizes[:keep], counts[:keep]
    # old cuts after the edit, leaf by leaf
    leaf, place, old = first, keep, pos
    fresh_s: list[int] = []
    fresh_c: list[int] = []
    now = pos
    for m in pre.find.finditer(new, pos):
        while old + shift < now or old < end:  # bring the old cut up to the new one
            while leaf < len(tree.leaves) and place >= len(tree.leaves[leaf][0]):
                leaf, place = leaf + 1, 0
            if leaf >= len(tree.leaves):
                break
            old += tree.leaves[leaf][0][place]
            place += 1
        if old >= end and old + shift == now and now >= at + len(insert) and leaf < len(tree.leaves):
            break
        fresh_s.append(m.end() - m.start())
        fresh_c.append(pre.count(m.group()))
        now = m.end()
    else:
        leaf, place = len(tree.leaves) - 1, len(tree.leaves[-1][0])
    if leaf >= len(tree.leaves):
        leaf, place = len(tree.leaves) - 1, len(tree.leaves[-1][0])
    tail_s, tail_c = tree.leaves[leaf][0][place:], tree.leaves[leaf][1][place:]
    tree.replace(first, leaf, head_s + fresh_s + tail_s, head_c + fresh_c + tail_c)
    return new, len(fresh_s)


@functools.lru_cache(maxsize=2)
def pretokenizer(path: str, pattern: str) -> PreTokenizer:
    return PreTokenizer(path, pattern)


def count_with_edits(docs: DataFrame, path: str, pattern: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_edits, n_pretokens, n_tokens, n_pretokens_after, n_tokens_after,
    n_reencoded): counts before and after the edits of each row, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = pretokenizer(path, pattern)
        names = ["n_edits", "n_pretokens", "n_tokens", "n_pretokens_after", "n_tokens_after", "n_reencoded"]
        for b in batches:
            out = []
            for t, edits in zip(b.column(1), b.column(2), strict=True):
                text, again = t.as_py(), 0
                tree = CountTree(*pre.cut(text))
                _, tokens, pieces = tree.total
                todo = [e for e in edits.as_py() or [] if e is not None]
                for e in todo:
                    text, n = apply_edit(tree, text, e["at"] or 0, e["delete"] or 0, e["insert"] or "", pre)
                    again += n
                out.append((len(todo), pieces, tokens, tree.total[2], tree.total[1], again))
            cols = np.array(out, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[:, k]) for k in range(6))], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(edits_col).cast(EDIT).alias("edits"))
    return rows.mapInArrow(run, "doc_id long, n_edits long, n_pretokens long, n_tokens long, n_pretokens_after long, n_tokens_after long, n_reencoded long")
