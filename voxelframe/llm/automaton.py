"""Tokenization automaton for byte-pair encoding.

The automaton reads tokens and accepts exactly the token sequences that the
merges produce. It starts as one state with an arc to itself for each base
symbol. Each merge (u, v) -> w, in order, is a gadget: the state behind arcs
labelled u is copied without its arc v; arcs labelled u lead to the copy; each
state with an arc u, hence with a path u v, gets an arc w to where v led. The
state behind an arc depends on the label only, so states are named by tokens,
and a gadget is kept as what it changed: the arc it removed, with its time, and
where the new label's arcs and state come from. ``arc`` resolves a transition
through these changes and stores it in the transition table.

A word has one path whose labels spell it. The labels are compiled into a
second table, of transitions by symbols: its states are the beginnings of
labels, each with the longest other beginning that ends it and the labels that
end there, so that one step a symbol gives the labels that end at each place,
longest first. Of these, the one with an arc from the state of the place where
it starts is the path's: so a word is encoded by a step a symbol and a look at
the arc table. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from .wordbpe import WordEncoder, byte_symbols, load_tokenizer


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "") -> None:
        self.end = end
        self.label = {i: s for s, i in vocab.items()}
        n = max(vocab.values(), default=-1) + 1
        self.birth = [-1] * n
        self.left, self.right = [-1] * n, [-1] * n
        self.removed: dict[tuple[int, int], int] = {}
        self.table: dict[tuple[int, int], bool] = {}
        dead = set()
        for time, (a, b) in enumerate(merges):  # one gadget each
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u in dead or v in dead or not self._arc(u, v, time):
                dead.add(w)  # no path u v is left
                self.left[w], self.right[w], self.birth[w] = u, v, time
                continue
            self.left[w], self.right[w], self.birth[w] = u, v, time
            self.removed[u, v] = time
        self._compile({s: i for s, i in vocab.items() if i not in dead})

    def _compile(self, labels: dict[str, int]) -> None:
        """Transitions by symbols. The end mark is a symbol of its own, 0."""
        self.code: dict[str, int] = {}
        self.width = 1 + len({c for s in labels for c in s})
        self.step: dict[int, int] = {}  # state * width + symbol -> state
        self.ends, self.depth, back = [-1], [0], [0]  # label that ends at a state; symbols so far
        order: list[tuple[int, int, int]] = []
        for s, i in labels.items():
            marked = bool(self.end) and s.endswith(self.end)
            at = 0
            for c in [*(self.code.setdefault(c, len(self.code) + 1) for c in (s[: len(s) - len(self.end)] if marked else s)), *([0] if marked else [])]:
                key = at * self.width + c
                to = self.step.get(key)
                if to is None:
                    to = self.step[key] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[at] + 1)
                    back.append(0)
                    order.append((self.depth[to], at, c))
                at = to
            self.ends[at] = i
        self.back = back
        self.first, self.next = [0] * len(back), [0] * len(back)  # nearest states, itself included or not, where a label ends
        for _, at, c in sorted(order):
            to = self.step[at * self.width + c]
            fall = self.back[at]
            while at:
                key = fall * self.width + c
                if key in self.step:
                    self.back[to] = self.step[key]
                    break
                if not fall:
                    break
                fall = self.back[fall]
            self.next[to] = self.first[self.back[to]]
            self.first[to] = to if self.ends[to] >= 0 else self.next[to]
        self.moves: dict[int, int] = {}

    def move(self, state: int, symbol: int) -> int:
        """The transition table, filled where a beginning can't go on."""
        key = state * self.width + symbol
        to = self.step.get(key)
        if to is None:
            to = self.moves.get(key)
            if to is None:
                to = self.move(self.back[state], symbol) if state else 0
                if len(self.moves) > 1_000_000:
                    self.moves.clear()
                self.moves[key] = to
        return to

    def _arc(self, p: int, x: int, time: int) -> bool:
        """Whether, after the first ``time`` gadgets, the state behind p has an arc x."""
        birth, left, right, removed = self.birth, self.left, self.right, self.removed
        while True:
            gone = removed.get((p, x))
            if gone is not None and gone < time:
                return False
            if birth[p] > birth[x]:
                time, p = birth[p], right[p]  # the state was taken over from v's
            elif birth[x] >= 0:
                time, x = birth[x] + 1, left[x]  # the arc stands where u's stood
            else:
                return True

    def arc(self, p: int, x: int) -> bool:
        found = self.table.get((p, x))
        if found is None:
            if len(self.table) > 2_000_000:
                self.table.clear()
            found = self.table[p, x] = self._arc(p, x, 1 << 60)
        return found

    def encode(self, symbols: str) -> list[int]:
        """The labels of the path that spells ``symbols`` (the end mark is implied)."""
        code, step, width, move = self.code, self.step, self.width, self.move
        word = [code.get(c, -1) for c in symbols]
        if self.end and word:
            word.append(0)
        label, start = [-1], [0]
        state = 0
        for i, c in enumerate(word, 1):
            to = step.get(state * width + c) if c >= 0 else 0
            state = move(state, c) if to is None else to
            found, at = -1, self.first[state]
            while at:
                x = self.ends[at]
                j = i - self.depth[at]
                if not j or label[j] >= 0 and self.arc(label[j], x):
                    found = x
                    break
                at = self.next[at]
            label.append(found)
            start.append(j if found >= 0 else 0)
        out, i = [], len(word)
        while i:
            if label[i] < 0:
                raise ValueError("no path spells this word")
            out.append(label[i])
            i = start[i]
        return out[::-1]


class AutomatonCodec:
    """Encoder and decoder for a tokenizer file of the word-level kind: words
    are found as the file says, then each is encoded by the automaton."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.labels = dict(self.automaton.label)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.labels.update({i: s for s, i in self.special.items()})
        self.symbols = byte_symbols()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.library = load_tokenizer(path)  # its normalizer and word rules, for texts beyond Latin-1
        self.words = WordEncoder(self._word, self._piece, self._text, self._joined)

    def _result(self, ids: list[int]) -> tuple[bytes, str, int]:
        return np.array(ids, "<u4").tobytes(), " ".join([self.labels[i] for i in ids]), len(ids)

    @staticmethod
    def _joined(results: list[tuple[bytes, str, int]]) -> tuple[bytes, str, int]:
        parts = [p for p in results if p[2]]
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts]), sum([p[2] for p in parts])

    def _word(self, symbols: str) -> tuple[bytes, str, int]:
        return self._result(self.automaton.encode(symbols))

    def _piece(self, piece: str) -> tuple[bytes, str, int]:
        ids: list[int] = []
        for w in self.pattern.findall(piece):
            ids += self.automaton.encode("".join([self.symbols[b] for b in w.encode()]))
        return self._result(ids)

    def _text(self, text: str) -> tuple[bytes, str, int]:
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    ids += self.automaton.encode(w)
        return self._result(ids)

    def encode(self, text: str) -> tuple[bytes, str, int]:
        """(ids as little-endian 32-bit integers, labels joined by spaces, number of ids)."""
        return self._joined(self.words(text))

    def decode(self, ids: bytes) -> str:
        return " ".join([self.labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(maxsize=2)
def codec(path: str) -> AutomatonCodec:
    return AutomatonCodec(path)


def encode_decode(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """(doc_id, n_tokens, ids: binary, decoded: string) of every row of ``docs``:
    a map over the table, each worker compiling the automaton once. Null and
    empty texts give no ids and the empty text; rows without an id take no part."""
    import pyarrow as pa

    from .common import documents

    def run(batches):
        c = codec(path)
        for b in batches:
            got = [c.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[2] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
