"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Pre-tokenisation never runs a regular expression. Each code point becomes a symbol of a small
alphabet (its class, with one character of look-ahead folded in), each symbol is a transition
function over seven states, and the states before all characters come from a scan with the
associative composition of these functions. The functions reachable by composition form a small
monoid, so that a composition is one lookup in a byte table. The resulting slices go through a
cache of merged pieces; offsets are kept, so that any token range maps back to its text.

Null and empty texts have zero ids. Texts that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphlode.plans.session import spread

#: Characters encoded at once; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 20
#: Pieces remembered by a Python worker before its cache starts again.
CACHE_PIECES = 400_000

# classes of code points
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
# symbols: the class, told apart by what follows
S_LETTER, S_NUMBER, S_OTHER, S_JOIN, S_LAST, S_MID, S_QUOTE, S_TAIL, S_END = range(9)
SYMBOLS = 9
# states: what kind of piece is open after a character
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_JOIN, IN_BLANKS, IN_SHORT = range(7)
STATES = 7


def default_vocabulary() -> str:
    """The rank file of byte_bpe_50k; GRAPHLODE_VOCABULARY or the parameter of the operators overrides it."""
    return os.environ.get("GRAPHLODE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    r"""Class of each code point: \p{L}, \p{N}, \s and the rest (about 1.1 MB, built once a process)."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    shift = np.array([*range(0xD800), *range(0xE000, 0x110000)], np.int64)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[shift[m.start() : m.end()]] = kind
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a new piece begins before the character.

    S_QUOTE is an apostrophe that begins a contraction if a piece begins there, S_TAIL and S_END are the
    letters of that contraction: within it if it is open, else ordinary letters.
    """
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER, S_TAIL: IN_LETTERS, S_END: IN_LETTERS}
    if state == IN_SHORT and symbol in (S_TAIL, S_END):
        return (IN_SHORT if symbol == S_TAIL else NONE), False
    if symbol in run:
        return run[symbol], state not in (run[symbol], AFTER_JOIN)
    if symbol == S_QUOTE:
        return (IN_OTHER, False) if state in (IN_OTHER, AFTER_JOIN) else (IN_SHORT, True)
    if symbol == S_JOIN:
        return AFTER_JOIN, True
    if symbol == S_LAST:
        return NONE, True
    return IN_BLANKS, state != IN_BLANKS


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, composition table, state after each element from NONE, begins[state, symbol]).

    An element is a function over the states; element 0 is the identity and the reset at a text's
    start is the constant function NONE, which absorbs everything before it.
    """
    identity = tuple(range(STATES))
    gens = [tuple(_step(q, s)[0] for q in range(STATES)) for s in range(SYMBOLS)]
    gens += [tuple(_step(NONE, s)[0] for _ in range(STATES)) for s in range(SYMBOLS)]  # the first character of a text
    elements, index, todo = [identity], {identity: 0}, [identity]
    for f in todo:
        for g in gens:
            h = tuple(g[q] for q in f)
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
                todo.append(h)
    for g in gens:  # a generator is a composition with the identity, so it is there
        assert g in index
    n = len(elements)
    assert n <= 256, n
    table = np.empty((n, n), np.uint8)
    for i, f in enumerate(elements):
        for j, g in enumerate(elements):
            table[i, j] = index[tuple(g[q] for q in f)]
    begins = np.array([[_step(q, s)[1] for s in range(SYMBOLS)] for q in range(STATES)])
    return np.array([index[g] for g in gens], np.uint8), table, np.array([e[NONE] for e in elements], np.uint8), begins


def _symbols(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of each character; first marks the first character of each text."""
    kind = code_point_classes()[codes]
    n = len(codes)
    last = np.ones(n, bool)  # nothing follows within the text
    last[:-1] = first[1:]
    follows = np.full(n, BLANK, np.uint8)
    follows[:-1] = kind[1:]
    follows[last] = BLANK  # the end of a text counts as blank: look-ahead for a non-blank fails
    out = kind.astype(np.uint8)  # LETTER and NUMBER are their own symbols
    out[kind == OTHER] = S_OTHER
    blank = kind == BLANK
    ends = blank & (follows != BLANK)
    out[blank] = S_MID
    out[ends] = np.where(codes[ends] == 32, S_JOIN, S_LAST)
    quote = np.flatnonzero(codes == 39)
    if len(quote):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        ok1 = ~last[quote]
        a = np.where(ok1, padded[quote + 1], 0)
        ok2 = ok1 & ~last[np.minimum(quote + 1, n - 1)]
        b = np.where(ok2, padded[quote + 2], 0)
        short = np.isin(a, [ord(c) for c in "sdmt"])
        long = ((a == ord("l")) & (b == ord("l"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("r")) & (b == ord("e")))
        long &= ~short
        out[quote[short | long]] = S_QUOTE
        out[quote[short] + 1] = S_END
        out[quote[long] + 1] = S_TAIL
        out[quote[long] + 2] = S_END
    return out


def boundaries(codes: np.ndarray, first: np.ndarray, block: int = 256) -> np.ndarray:
    """Positions at which a piece begins. codes: code points of the texts put together."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    element, table, after, begins = automaton()
    symbol = _symbols(codes, first)
    elem = element[symbol + SYMBOLS * first.astype(np.uint8)]
    rows = -(-n // block)
    grid = np.zeros(rows * block, np.uint8)
    grid[:n] = elem
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)  # column i holds the i-th character of each block
    size = len(table)
    flat = table.ravel()
    inner = np.empty_like(grid)  # composition of a block's characters before each one
    acc = np.zeros(rows, np.uint8)
    for i in range(block):
        inner[i] = acc
        acc = flat[acc.astype(np.int32) * size + grid[i]]
    carry = np.zeros(rows, np.uint8)  # composition of all blocks before each one, by doubling
    carry[1:] = acc[:-1]
    step = 1
    while step < rows:
        nxt = carry.copy()
        nxt[step:] = flat[carry[:-step].astype(np.int32) * size + carry[step:]]
        carry = nxt
        step *= 2
    start_state = after[carry]  # state before each block
    # state before each character: a block's inner composition applied to the block's first state
    apply = _apply_table()
    state = apply[inner, start_state[None, :]].T.reshape(-1)[:n]
    state = np.where(first, NONE, state)
    return np.flatnonzero(begins[state, symbol] | first)


@lru_cache(1)
def _apply_table() -> np.ndarray:
    """apply[element, state] = state after the element; the constant element of each state picks it out."""
    element, table, after, _ = automaton()
    out = np.zeros((len(table), STATES), np.uint8)
    seen = np.zeros(STATES, bool)
    todo = [0]
    visited = {0}
    for f in todo:  # elements reached from NONE: table[f, e] taken at NONE is e applied to f's state
        if not seen[after[f]]:
            seen[after[f]] = True
            out[:, after[f]] = after[table[f, :]]
        for g in element:
            h = int(table[f, g])
            if h not in visited:
                visited.add(h)
                todo.append(h)
    return out


class Pieces(dict):
    """Piece -> its number; ids of piece i are flat[offset[i]:offset[i] + length[i]]."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.merge = tiktoken.Encoding("graphlode", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat: list[int] = []
        self.lengths: list[int] = []
        self.done = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def __missing__(self, piece: str) -> int:
        ids = self.merge(piece.encode("utf-8", "replace"))
        self[piece] = at = len(self.lengths)
        self.lengths.append(len(ids))
        self.flat.extend(ids)
        return at

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """flat ids, length and offset of each piece."""
        flat, length, offset = self.done
        if len(length) < len(self.lengths):
            flat = np.concatenate([flat, np.array(self.flat[len(flat) :], np.int32)])
            length = np.concatenate([length, np.array(self.lengths[len(length) :], np.int64)])
            offset = np.cumsum(length) - length
            self.done = (flat, length, offset)
        return self.done


@lru_cache(2)
def pieces_of(vocabulary: str) -> Pieces:
    return Pieces(vocabulary)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK_CHARS characters together."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > CHUNK_CHARS:
            yield begin, i
            begin, size = i, 0
        size += n
    yield begin, len(texts)


def split_texts(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """(texts put together, where each piece begins, number of the text of each piece)."""
    lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
    joined = "".join(t for t in texts if t)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    first = np.zeros(len(codes), bool)
    first[starts[lengths > 0]] = True
    begins = boundaries(codes, first)
    full = np.flatnonzero(lengths > 0)
    return joined, begins, full[np.searchsorted(starts[full], begins, side="right") - 1] if len(begins) else np.zeros(0, np.int64)


def encode_texts(texts: list[str | None], vocabulary: str, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(number of tokens of each text, the ids of all texts one after the other or None)."""
    cache = pieces_of(vocabulary)
    counts, out = np.zeros(len(texts), np.int64), []
    for a, b in _chunks(texts):
        joined, begins, owner = split_texts(texts[a:b])
        if not len(begins):
            continue
        if len(cache) > CACHE_PIECES:
            cache.reset()
        cuts = begins.tolist()
        number = np.fromiter(map(cache.__getitem__, [joined[i:j] for i, j in zip(cuts, [*cuts[1:], len(joined)])]), np.int64, len(cuts))
        flat, length, offset = cache.arrays()
        n = length[number]
        counts[a:b] += np.bincount(owner, n, b - a).astype(np.int64)
        if ids:
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(offset[number] - (ends - n), n)
            out.append(flat[at])
    return counts, (np.concatenate(out) if out else np.zeros(0, np.int32)) if ids else None


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, ids): the token ids of each text. One pass over the rows, no shuffle.

    Null and empty texts give an empty list; repeated rows stay; extra columns are not read.
    """
    path = vocabulary or default_vocabulary()
    source = spread(df.select(id_col, text_col))
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                counts, ids = encode_texts(part.column(1).to_pylist(), path)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], [id_col, "ids"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, out: str = "n_tokens") -> DataFrame:
    """(id_col, out): the number of tokens of each text; null and empty texts have 0."""
    path = vocabulary or default_vocabulary()
    source = spread(df.select(id_col, text_col))
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                counts, _ = encode_texts(part.column(1).to_pylist(), path, ids=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], [id_col, out])

    return source.mapInArrow(run, f"`{id_col}` {kind}, `{out}` bigint")


def decode_ids(ids: list[int], vocabulary: str | None = None) -> str:
    """The text of token ids (the round trip of encode)."""
    return b"".join(_bytes_of(vocabulary or default_vocabulary())[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def _bytes_of(vocabulary: str) -> dict[int, bytes]:
    with open(vocabulary, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
