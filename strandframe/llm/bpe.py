"""Byte-level BPE by a lazily determinised finite-state transducer.

What it rests on: a sequence of tokens is the BPE encoding of its bytes exactly if each token is the encoding of its
own bytes and each adjacent pair that of its bytes, for merges act on what is beside them and never cross the bounds
that remain. So every prefix of a text has one last token, and a state needs only the places in the bytes read at
which a token that goes on may start, with the tokens that lead there. Tokens that lead to all of them are emitted:
the lookahead is bounded by the longest token. Every state and step is made when a text first needs it, and kept.

Which tokens may follow one is decided by its right spine alone (the token, its right half, that one's right half ...),
and only by those parts of the spine that some merge could take on to the right before the spine's own next merge does.
Tokens that agree in these are one class. A state names the class of the token before its first place, never that
token, and no class where it rules out nothing of what can still come: so states recur from word to word.

Decoding streams: bytes of tokens pass an incremental UTF-8 state machine that holds back at most three bytes.

Defined results: null and empty texts have no tokens; repeated rows are encoded each by itself; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_texts

#: Bounds of what a worker process keeps: whole pieces, steps of the transducer, and classes of a bit for each token.
MAX_PIECES = 200_000
MAX_STEPS = 300_000
MAX_CLASSES = 12_000
BLOCK_PIECES = 1 << 16
#: Above every rank.
NEVER = 1 << 60
#: Bits of a packed step that number the state; those above number what is emitted.
STATE_BITS = 24
#: The class of what rules out nothing: of the beginning of a piece, and of tokens that no merge takes on.
FREE = 0


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """The tokens of a merge list as a trie, their halves, and which of them may follow which.

    Tokens are numbered in the order of their bytes, so that those below a node of the trie are a run of numbers.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = sorted(ranks)
        self.number = {token: i for i, token in enumerate(self.tokens)}
        self.rank = [ranks[t] for t in self.tokens]
        n = len(self.tokens)
        # child[node << 8 | byte]; the tokens below a node are numbered from first to last - 1, its own the first of them
        self.child: dict[int, int] = {}
        self.first, self.last, self.own = [0], [n], [-1]
        for i, token in enumerate(self.tokens):
            node = 0
            for byte in token:
                step = node << 8 | byte
                if step not in self.child:
                    self.child[step] = len(self.first)
                    self.first.append(i)
                    self.last.append(i)
                    self.own.append(-1)
                node = self.child[step]
                self.last[node] = i + 1
            self.own[node] = i
        self._halve(ranks)
        self.partners: dict[int, tuple[np.ndarray, ...]] = {}
        self.forget()

    def forget(self) -> None:
        """Drops the classes. States name them, so these must go too."""
        self.class_of: dict[int, int] = {}
        self.classes: dict[tuple, int] = {(): FREE}
        #: By class, a bit for each token that may follow.
        self.allowed = [self.whole]

    def _halve(self, ranks: dict[bytes, int]) -> None:
        """The two tokens whose merge, the last of its own encoding, makes each token; none for a byte, or for a token
        that its bytes don't merge into. The adjacent pair of least rank merges, the leftmost first."""
        n = len(self.tokens)
        self.left, self.right = [-1] * n, [-1] * n
        whole = bytearray(n)
        for i, token in enumerate(self.tokens):
            parts = [token[k : k + 1] for k in range(len(token))]
            merges = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            while len(parts) > 2:
                rank = min(merges)
                if rank == NEVER:
                    break
                k = merges.index(rank)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del merges[k]
                if k:
                    merges[k - 1] = ranks.get(parts[k - 1] + parts[k], NEVER)
                if k < len(merges):
                    merges[k] = ranks.get(parts[k] + parts[k + 1], NEVER)
            if len(parts) == 2:
                self.left[i], self.right[i] = self.number[parts[0]], self.number[parts[1]]
            whole[i] = len(parts) <= 2
        self.whole = int.from_bytes(np.packbits(np.frombuffer(whole, np.uint8), bitorder="little").tobytes(), "little")
        # the tree in which a token stands below its left half, its children by rank, laid out in preorder
        born = [-1 if self.left[i] < 0 else self.rank[i] for i in range(n)]  # bytes are there from the start
        below: list[list[int]] = [[] for _ in range(n)]
        for i in sorted(range(n), key=self.rank.__getitem__):
            if self.left[i] >= 0:
                below[self.left[i]].append(i)
        self.below, self.born = below, born
        self.begin, self.end = np.zeros(n, np.int32), np.zeros(n, np.int32)
        at = 0
        for root in (i for i in range(n) if self.left[i] < 0):
            stack = [(root, iter(below[root]))]
            self.begin[root] = at
            at += 1
            while stack:
                node, rest = stack[-1]
                child = next(rest, None)
                if child is None:
                    self.end[node] = at
                    stack.pop()
                else:
                    self.begin[child] = at
                    at += 1
                    stack.append((child, iter(below[child])))

    def _partners(self, a: int) -> tuple[np.ndarray, ...]:
        """Of each x that merges with a on its left: up to which limit of a it does, its place in the preorder, and the
        run of tokens that hold x at their left edge until that merge has come: ascending by the limit.

        The merge of rank m takes a and x if both are there at once and neither is taken by another merge before. So x
        must be born before a is taken, and a before x is; children of x of a rank below m take it before.
        """
        if a not in self.partners:
            token, rows = self.tokens[a], []
            node = 0
            for byte in token:
                node = self.child[node << 8 | byte]
            for i in range(self.first[node], self.last[node]):
                x = self.number.get(self.tokens[i][len(token) :])
                if x is None or not self.whole >> x & 1:
                    continue
                least, children = max(self.rank[i], self.born[a]), self.below[x]
                k = next((self.begin[c] for c in children if self.rank[c] >= least), self.end[x])
                rows.append((max(self.rank[i], self.born[x]), self.begin[x], k, self.end[x]))
            rows.sort()
            self.partners[a] = tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
        return self.partners[a]

    def class_after(self, token: int) -> int:
        """The class of tokens that may be followed by the same ones."""
        found = self.class_of.get(token)
        if found is None:
            spine, a, limit = [], token, NEVER
            while a >= 0:
                k = int(np.searchsorted(self._partners(a)[0], limit))
                if k:
                    spine.append((a, k))
                a, limit = self.right[a], self.rank[a]
            key = tuple(spine)
            found = self.classes.get(key)
            if found is None:
                found = self.classes[key] = len(self.allowed)
                self.allowed.append(self._allow(spine))
            self.class_of[token] = found
        return found

    def _allow(self, spine: list[tuple[int, int]]) -> int:
        edges = np.zeros(len(self.tokens) + 1, np.int32)
        for a, k in spine:
            _, own, begin, end = self._partners(a)
            np.add.at(edges, own[:k], 1)
            np.add.at(edges, own[:k] + 1, -1)
            np.add.at(edges, begin[:k], 1)
            np.add.at(edges, end[:k], -1)
        kept = np.cumsum(edges[:-1])[self.begin] == 0
        return self.whole & int.from_bytes(np.packbits(kept, bitorder="little").tobytes(), "little")

    def follows(self, kind: int, token: int) -> bool:
        return bool(self.allowed[kind] >> token & 1)

    def beyond(self, kind: int, node: int) -> tuple[bool, bool]:
        """Whether some token beyond this node may follow the class, and whether all may that are encodings at all."""
        low, high = self.first[node] + (self.own[node] >= 0), self.last[node]
        if low >= high:
            return False, True
        bits = (1 << high - low) - 1
        all_ = self.whole >> low & bits
        found = self.allowed[kind] >> low & bits
        return bool(found), found == all_


class Transducer:
    """A state: the class of what stands before its first place; the tokens that lead to live places, as (end, start,
    token); and the live places with the trie nodes of what was read since. The last live place is the end of what was
    read, at which a token may always start."""

    def __init__(self, ranks: dict[bytes, int]):
        self.words = Vocabulary(ranks)
        self.ids = np.array(self.words.rank, np.int64).tolist()
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.flushed: list[tuple[int, ...]] = []
        #: steps[state << 8 | byte]: the state it leads to and, above STATE_BITS, the number of what it emits.
        self.steps: dict[int, int] = {}
        self.emitted: dict[tuple[int, ...], int] = {(): 0}
        self.output: list[tuple[int, ...]] = [()]
        self._state((FREE, (), ((0, 0),)))

    @property
    def n_steps(self) -> int:
        return len(self.steps)

    def _state(self, state: tuple) -> int:
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
            at = {end: (start, token) for end, start, token in state[1]}
            place, out = state[2][-1][0], []
            while place:
                place, token = at[place]
                out.append(self.ids[token])
            self.flushed.append(tuple(reversed(out)))
        return number

    def _step(self, number: int, byte: int) -> int:
        words = self.words
        before, edges, live = self.states[number]
        at = {end: (start, token) for end, start, token in edges}
        end = live[-1][0] + 1
        alive = []
        for place, node in live:
            child = words.child.get(node << 8 | byte)
            if child is None:
                continue
            kind = words.class_after(at[place][1]) if place else before
            token = words.own[child]
            if token >= 0 and words.follows(kind, token):
                at[end] = (place, token)
            some, every = words.beyond(kind, child)
            if some:
                alive.append((place, child))
                if not place and every:
                    before = FREE  # of what can still come here nothing is ruled out
        alive.append((end, 0))
        # only what leads to live places stays
        needed: dict[int, tuple[int, int]] = {}
        for place, _ in alive:
            while place and place not in needed:
                needed[place] = at[place]
                place = at[place][0]
        # emit while one token leads to all of them
        out: list[int] = []
        origin = 0
        while alive[0][0] != origin:
            firsts = [e for e, (start, _) in needed.items() if start == origin]
            if len(firsts) != 1:
                before = FREE  # the origin is no live place: what stands before it decides no more
                break
            token = needed.pop(firsts[0])[1]
            out.append(self.ids[token])
            before = words.class_after(token)
            origin = firsts[0]
        state = (
            before,
            tuple(sorted((e - origin, s - origin, t) for e, (s, t) in needed.items())),
            tuple((p - origin, n) for p, n in alive),
        )
        emitted = tuple(out)
        told = self.emitted.get(emitted)
        if told is None:
            told = self.emitted[emitted] = len(self.output)
            self.output.append(emitted)
        step = self.steps[number << 8 | byte] = told << STATE_BITS | self._state(state)
        return step

    def encode(self, piece: bytes) -> list[int]:
        if len(self.words.allowed) > MAX_CLASSES:
            self.words.forget()
            self.reset()
        out: list[int] = []
        state, steps, output = 0, self.steps.get, self.output
        for byte in piece:
            step = steps(state << 8 | byte)
            if step is None:
                if len(self.steps) >= MAX_STEPS:  # begin anew with the state that is reached
                    reached = self.states[state]
                    self.reset()
                    state, steps, output = self._state(reached), self.steps.get, self.output
                step = self._step(state, byte)
            state = step & (1 << STATE_BITS) - 1
            if step >> STATE_BITS:
                out += output[step >> STATE_BITS]
        out += self.flushed[state]
        return out


_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


class _Pieces(dict):
    """Packed ids of pieces seen lately; others pass the transducer."""

    def __init__(self, ranks: dict[bytes, int], transducer: Transducer):
        self.ranks, self.transducer = ranks, transducer

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.transducer.encode(data)
        packed = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Utf8Machine:
    """Decodes a stream of bytes; an unfinished character at the end of a block waits for the next."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.held + data
        keep = 0 if final else self._unfinished(data)
        self.held = data[len(data) - keep :]
        return (data[: len(data) - keep]).decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that begin a character which needs more."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC2:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF5 else 0
                if need <= back:
                    return 0
                if back > 1:  # the byte after the first has bounds of its own
                    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                    if not low <= data[-back + 1] <= high:
                        return 0
                return back
            if byte < 0x80:
                return 0
        return 0


class ByteBpe:
    def __init__(self, ranks_path: str, pattern: str):
        import regex

        ranks = load_ranks(ranks_path)
        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(ranks, Transducer(ranks))
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def blocks(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, by block of pieces."""
        get = self.pieces.__getitem__
        if len(text) <= 1 << 18:
            yield b"".join(map(get, self.pattern.findall(text)))
            return
        matches = self.pattern.finditer(text)
        while block := [m[0] for m in islice(matches, BLOCK_PIECES)]:
            yield b"".join(map(get, block))

    def decode(self, blocks: Iterator[bytes]) -> Iterator[tuple[bytes, str]]:
        """Bytes and text by block, the text through the state machine."""
        machine, token = Utf8Machine(), self.token.__getitem__
        for block in blocks:
            data = b"".join(map(token, np.frombuffer(block, "<u4").tolist()))
            yield data, machine.feed(data)
        yield b"", machine.feed(b"", final=True)


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, hashes of the ids and of the bytes decoded from them, whether decoding gave the text, and
    the ids themselves if wanted. ranks_path is read on the executors."""

    def row(doc_id: object, text: bytes | None, bpe: ByteBpe) -> tuple:
        n, ids_hash, bytes_hash, ids, back, whole = 0, hashlib.sha256(), hashlib.sha256(), [], 0, True
        given = text.decode() if text else ""

        def told() -> Iterator[bytes]:
            nonlocal n
            for block in bpe.blocks(given):
                n += len(block) // 4
                ids_hash.update(block)
                if with_ids:
                    ids.append(block)
                yield block

        for data, decoded in bpe.decode(told()):
            bytes_hash.update(data)
            whole = whole and given.startswith(decoded, back)
            back += len(decoded)
        out = (doc_id, n, ids_hash.hexdigest(), bytes_hash.hexdigest(), whole and back == len(given))
        return (*out, np.frombuffer(b"".join(ids), "<i4")) if with_ids else out

    kind = docs.schema["doc_id"].dataType.simpleString().replace("bigint", "long")
    return map_texts(
        docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id", "text"], row,
        f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + (", ids array<int>" if with_ids else ""),
        lambda: codec(ranks_path, pattern),
    )
