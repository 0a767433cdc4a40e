"""A byte-level BPE tokenizer compiled to deterministic transducers whose transitions carry token counts.

The first transducer cuts a text into pretokens. Its input letters are classes of code points that already say
what the next characters are, where the tokenizer's pattern looks ahead; it has eight states. A chunk of text is
a map from each state before it to the state after it; chunk maps compose in a parallel prefix scan, which gives
every chunk its true start, and the cuts follow.

The second one reads the bytes of a pretoken. A state holds, for the places from which a vocabulary entry could
still be under way, the last token of the tokenization of the text so far and its count relative to now; that is
all that later bytes can ask about. A transition carries the change of the token count. States are compiled when
first met, as the whole machine is far larger than the part that texts use. A long pretoken is cut into chunks; a chunk's
map, from the states before it to the state after it and the change of the count, is kept for those states alone that
come into question, and maps compose in a tree.
"""

from __future__ import annotations

import copy
import json
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np

# Classes of code points, then the classes that depend on what follows.
LETTER, NUMBER, OTHER, SPACE, WHITE, END = range(6)
SHORT, LONG, SPACE_IN, WHITE_IN = range(6, 10)  # 's and 're begin here; white space before more of it or the end
CLASSES = 10
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
STATES = 8
#: After so many characters most chunk maps are constant.
SETTLED = 4
#: Bytes of a chunk of a long pretoken, bytes before it that guess the state that it begins in, longest pretoken remembered.
CHUNK, WARM, REMEMBERED = 4096, 64, 128
#: Contractions of the tokenizer's pattern (fixed values).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """By class and state: the state after it, and whether a pretoken begins at this character."""
    to, cut = np.zeros((CLASSES, STATES), np.uint8), np.ones((CLASSES, STATES), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT: IN_OTHERS, LONG: IN_OTHERS}
    for c in range(CLASSES):
        for s in range(STATES):
            if c == END:
                to[c, s] = START
            elif s in (ONE_MORE, TWO_MORE):  # inside a contraction
                to[c, s], cut[c, s] = (START if s == ONE_MORE else ONE_MORE), False
            elif c in run and (s == run[c] or s == AFTER_SPACE):
                to[c, s], cut[c, s] = run[c], False
            elif c in (SHORT, LONG):
                to[c, s] = ONE_MORE if c == SHORT else TWO_MORE
            elif c in run:
                to[c, s] = run[c]
            elif c == SPACE:  # before a character that is not white: goes with it
                to[c, s] = AFTER_SPACE
            elif c == WHITE:  # the last of its run, on its own
                to[c, s] = START
            else:
                to[c, s], cut[c, s] = IN_WHITE, s != IN_WHITE
    return to, cut


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each code point (0x110000 stands for the end of a text), and the machine, flattened."""
    kind = np.full(0x110001, OTHER, np.uint8)
    for c in range(0x110000):
        g = unicodedata.category(chr(c))[0]
        if g == "L":
            kind[c] = LETTER
        elif g == "N":
            kind[c] = NUMBER
        elif g == "Z" or 9 <= c <= 13 or c == 0x85:
            kind[c] = WHITE
    kind[32], kind[0x110000] = SPACE, END
    to, cut = _machine()
    return kind, to.ravel(), cut.ravel()


def _classes(code: np.ndarray) -> np.ndarray:
    c = _tables()[0][code]
    after = np.append(c[1:], END)
    white = (after == SPACE) | (after == WHITE) | (after == END)
    out = c.copy()
    out[(c == SPACE) & white] = SPACE_IN
    out[(c == WHITE) & white] = WHITE_IN
    at = np.flatnonzero(code == ord("'"))
    if len(at):
        padded = np.append(code, [0x110000, 0x110000])
        one, two = padded[at + 1], padded[at + 2]
        for x in CONTRACTIONS:
            if len(x) == 2:
                out[at[one == ord(x[1])]] = SHORT
            else:
                out[at[(one == ord(x[1])) & (two == ord(x[2]))]] = LONG
    return out


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Of chunk maps, row by row: first, and then the other."""
    return np.take_along_axis(then, first.astype(np.intp), 1)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of chunk maps, in log2(chunks) parallel steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step], out[step:])
        step *= 2
    return out


def cuts(code: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Where pretokens begin in an array of code points in which 0x110000 ends each text."""
    _, to, cut = _tables()
    n = len(code)
    rows = -(-n // chunk)
    c = np.full(rows * chunk, END, np.uint8)
    c[:n] = _classes(code)
    base = np.ascontiguousarray(c.reshape(rows, chunk).T).astype(np.intp) * STATES
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for j in range(min(SETTLED, chunk)):
        maps = to[base[j][:, None] + maps]
    # By now nearly every map is constant: whatever the state before, one state after. Those need one column.
    open_ = np.flatnonzero((maps != maps[:, :1]).any(1))
    one, some = maps[:, 0], maps[open_]
    for j in range(SETTLED, chunk):
        one = to[base[j] + one]
        if len(open_):
            some = to[base[j][open_][:, None] + some]
    maps = np.repeat(one[:, None], STATES, 1)
    maps[open_] = some
    start = np.zeros(rows, np.uint8)
    start[1:] = scan(maps)[:-1, START]
    begins = np.empty((chunk, rows), bool)
    for j in range(chunk):
        at = base[j] + start
        begins[j], start = cut[at], to[at]
    return np.flatnonzero(begins.T.ravel()[:n])


def pretokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pretokens of the texts, in order, and how many each text has."""
    if not texts:
        return [], np.zeros(0, np.int64)
    joined = "\0".join(texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    code[ends] = 0x110000
    at = cuts(code)
    last = np.searchsorted(at, ends)  # each text's end is a piece of its own
    text = np.ones(len(at), bool)
    text[last] = False
    starts, stops = at[text].tolist(), np.append(at[1:], len(code))[text].tolist()
    return [joined[a:b] for a, b in zip(starts, stops, strict=True)], np.diff(last, prepend=-1) - 1


class TokenCounter:
    """Token counts of pretokens under the merges of a tokenizer's file; `most` bounds what it remembers."""

    def __init__(self, path: str, most: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or model.get("unk_token"):
            raise ValueError("a byte-level BPE file is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte_of = {c: b for b, c in byte_letters().items()}
        to_bytes = lambda s: bytes(byte_of[c] for c in s)
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(merges)}
        self.prefixes = {t[:i] for t in self.ids for i in range(1, len(t) + 1)}
        self.most, self.fits = most, {}
        self._forget()

    def _forget(self) -> None:
        root = (b"", ((b"", 0),))
        self.states, self.number, self.go, self.known = [root], {root: 0}, {}, {}

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of bytes, by applying merges in the order of their ranks."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(pairwise(parts), key=lambda p: self.rank.get(p, 1 << 40))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _follows(self, a: bytes, b: bytes) -> bool:
        """Whether token b can stand after token a: the two, joined, are cut into them again."""
        if not a:
            return True
        if (a, b) not in self.fits:
            if len(self.fits) > self.most:
                self.fits.clear()
            self.fits[a, b] = self.merge(a + b) == [a, b]
        return self.fits[a, b]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition: the next state and the change of the token count."""
        tail, last = self.states[state]  # last[i]: of the text without its last len(tail) - i bytes
        tail += bytes([byte])
        for i in range(len(last)):
            token = tail[i:]
            if token in self.ids and self._whole(token) and self._follows(last[i][0], token):
                delta = last[i][1] + 1
                break
        else:
            raise ValueError("the vocabulary lacks single bytes")
        last = (*last, (token, delta))
        while tail and tail not in self.prefixes:
            tail, last = tail[1:], last[1:]
        key = (tail, tuple((t, n - delta) for t, n in last))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key], delta

    @lru_cache(1 << 17)  # noqa: B019
    def _whole(self, token: bytes) -> bool:
        """Whether the merges make this token of its own bytes."""
        return self.merge(token) == [token]

    def run(self, data: bytes, state: int = 0) -> tuple[int, int]:
        """From a state: the state after the bytes, and the change of the count."""
        count = 0
        go = self.go
        for b in data:
            key = state << 8 | b
            step = go.get(key)
            if step is None:
                step = go[key] = self._compile(state, b)
            state = step[0]
            count += step[1]
        return state, count

    def long(self, data: bytes, chunk: int = CHUNK, warm: int = WARM) -> int:
        """The count of a long pretoken, by maps of its chunks. What is compiled for it is kept apart, and bounded: states in
        maps are held by what they are, not by number, and so outlive the transitions that led to them."""
        machine = copy.copy(self)
        machine._forget()
        root = machine.states[0]
        parts = [data[i : i + chunk] for i in range(0, len(data), chunk)]
        made: dict[bytes, dict] = {}  # equal chunks share a map
        maps = [made.setdefault(p, {}) for p in parts]

        def through(i: int, before: tuple) -> tuple[tuple, int]:
            """What chunk i does to a state; run if its map doesn't say."""
            if before not in maps[i]:
                if len(machine.go) > self.most // 4:
                    machine._forget()
                if before not in machine.number:
                    machine.number[before] = len(machine.states)
                    machine.states.append(before)
                after, n = machine.run(parts[i], machine.number[before])
                maps[i][before] = machine.states[after], n
            return maps[i][before]

        # Each chunk from the state that a few bytes before it lead to, whatever stands before those.
        guesses = [root]
        for i in range(1, len(parts)):
            guesses.append(machine.states[machine.run(parts[i - 1][-warm:])[0]])
            through(i, guesses[i])
        # Level by level: runs of chunks as maps; a map that lacks the state before it is asked for it from below.
        levels = [maps]

        def asked(level: int, i: int, before: tuple) -> tuple[tuple, int]:
            if level == 0:
                return through(i, before)
            known = levels[level][i]
            if before not in known:
                state, n = asked(level - 1, 2 * i, before)
                if 2 * i + 1 < len(levels[level - 1]):
                    state, m = asked(level - 1, 2 * i + 1, state)
                    n += m
                known[before] = state, n
            return known[before]

        while len(levels[-1]) > 1:
            levels.append([{} for _ in range(-(-len(levels[-1]) // 2))])
            for i in range(len(levels[-1])):
                asked(len(levels) - 1, i, guesses[i << (len(levels) - 1)])
        total = asked(len(levels) - 1, 0, root)[1]
        machine._forget()
        return total

    def counts(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > self.most or len(self.go) > 4 * self.most:
            self._forget()
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    p = pieces[i]
                    n = known.get(p)
                    if n is None:
                        data = p.encode()
                        n = self.run(data)[1] if len(data) <= CHUNK else self.long(data)
                        if len(data) <= REMEMBERED:
                            known[p] = n
                    out[i] = n
        return np.array(out, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of whole texts; the strings of special tokens are those tokens, one each."""
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            for s in self.special:
                if s in t:
                    extra[i] += t.count(s)
            if extra[i]:
                cut = [t]
                for s in self.special:
                    cut = [y for x in cut for y in x.split(s)]
                parts += cut
                owner += [i] * len(cut)
            else:
                parts.append(t)
                owner.append(i)
        pieces, many = pretokens(parts)
        ends = np.concatenate([[0], np.cumsum(self.counts(pieces))])
        upto = np.cumsum(many)
        by_part = ends[upto] - ends[upto - many]
        np.add.at(extra, np.array(owner, np.int64), by_part)
        return extra


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
