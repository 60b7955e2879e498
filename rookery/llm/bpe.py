"""Byte-level BPE as a lazily determinised transducer.

The merges are compiled into a transducer that reads bytes and writes token ids. Its underlying
machine guesses where each token starts; a guess survives while its bytes spell a path in the trie of tokens,
and it may close as token t after token p only if no merge of the vocabulary would have joined bytes across
the border of p and t earlier. Exactly one guess closes at each byte, so every prefix has one encoding, and a state of the determinised machine is
the ordered set of open guesses, each with the tokens that it would write but that are not yet common to all.
Tokens common to all open guesses are written at once: the lookahead is bounded by the longest token. States and
their transitions are made when a text first needs them, and thrown away together when there are too many.

Decoding maps ids to bytes and runs them through an incremental UTF-8 decoder, so that a character split
between tokens or chunks comes out whole.

Null text is empty text, which has no ids. Ids, lengths and texts of any size are handled; repeated rows give repeated results.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import bounded_batches, kept, text_of

#: Bounds of what a worker keeps until a task of another operator comes: states of the transducer, and encoded pieces in each of two
#: generations. Pieces longer than PIECE_CHARS are encoded anew each time, so that the pieces' bytes are bounded with their number.
MAX_STATES = 200_000
MAX_PIECES = 150_000
PIECE_CHARS = 64
#: Pieces of a longer text are taken one by one, so that they are never all in memory.
LONG_CHARS = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        # trie as a list of {byte: node}; the token that ends at a node, if any
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                if byte not in self.trie[at]:
                    self.trie[at][byte] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(None)
                at = self.trie[at][byte]
            self.ends[at] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.borders: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        # a state is a number: its open guesses (trie node, token before, tokens not yet written), and the tokens that a text's end accepts
        self.states: dict[tuple, int] = {}
        self.open: list[tuple] = []
        self.closed: list[tuple] = []
        # state * 256 + byte to the next state, or to (tokens written, next state) where some are
        self.moves: dict[int, int | tuple] = {}
        self.start = self._state(((0, None, ()),))

    def _state(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.open)
            self.open.append(key)
            self.closed.append(key[-1][2])
        return found

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, and for a token that merges never reach."""
        if token not in self.halves:
            parts = [self.ranks.get(bytes([x])) for x in self.tokens[token]]
            while len(parts) > 2:
                ways = [(self.ranks.get(self.tokens[a] + self.tokens[b], token), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                rank, i = min(ways)
                if rank >= token:
                    break
                parts[i : i + 2] = [rank]
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.split(token) is not None

    def border_holds(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together ends in just these two.

        Back in time from the finished tokens, the piece left of the border and the piece right of it are taken apart, the younger
        one first; had any two that stood side by side a merge due before either grew into its parent, the border would have gone.
        Of equal ranks the leftmost merges first, so a tie goes against the border only on the right.
        """
        at = left << 32 | right
        found = self.borders.get(at)
        if found is None:
            if len(self.borders) > self.max_states:
                self.borders.clear()
            a, b, a_until, b_until, found = left, right, None, None, True
            while True:
                due = self.ranks.get(self.tokens[a] + self.tokens[b])
                if due is not None and (a_until is None or due < a_until) and (b_until is None or due <= b_until):
                    found = False
                    break
                a_old, b_old = len(self.tokens[a]) > 1, len(self.tokens[b]) > 1
                if not (a_old or b_old):
                    break
                if a_old and (not b_old or a > b):
                    a, a_until = self.split(a)[1], a
                else:
                    b, b_until = self.split(b)[0], b
            self.borders[at] = found
        return found

    def step(self, state: int, byte: int) -> int | tuple:
        """Where the transition leads and what it writes; made once, then kept."""
        opened, closed, shared = [], None, 1 << 30
        trie, ends, borders = self.trie, self.ends, self.borders
        for node, before, unwritten in self.open[state]:
            to = trie[node].get(byte)
            if to is None:
                continue
            if closed is None:
                token = ends[to]
                if token is not None and self.reachable(token):
                    holds = before is None or borders.get(before << 32 | token)
                    if holds or (holds is None and self.border_holds(before, token)):
                        closed = (0, token, (*unwritten, token))
            if trie[to]:
                opened.append((to, before, unwritten))
                shared = min(shared, len(unwritten))
        opened.append(closed)
        # tokens common to all guesses are written now
        shared = min(shared, len(closed[2]))
        first = closed[2][:shared]
        while shared and any(x[2][:shared] != first for x in opened):
            shared -= 1
            first = first[:shared]
        key = tuple([(node, before, unwritten[shared:]) for node, before, unwritten in opened] if shared else opened)
        if len(self.open) >= self.max_states and key not in self.states:
            self.clear()
            return (first, self._state(key))  # the state that this came from is gone
        to = self._state(key)
        found = self.moves[state << 8 | byte] = (first, to) if first else to
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        out, state = [], self.start
        moves = self.moves.get
        for byte in piece:
            to = moves(state << 8 | byte)
            if to is None:
                to = self.step(state, byte)
                moves = self.moves.get
            if type(to) is int:
                state = to
            else:
                wrote, state = to
                out += wrote
        return (*out, *self.closed[state])


class Pieces(dict):
    """Encodings of pieces of text: those of the last two generations are kept."""

    def __init__(self, transducer: Transducer, most: int = MAX_PIECES):
        self.transducer, self.most, self.old = transducer, most, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
            if len(piece) > PIECE_CHARS:
                return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces, self.pattern = Pieces(Transducer(ranks)), regex.compile(pattern)

    def __call__(self, text: str) -> list[int]:
        found = self.pattern.findall(text) if len(text) <= LONG_CHARS else (m[0] for m in self.pattern.finditer(text))
        return list(chain.from_iterable(map(self.pieces.__getitem__, found)))


class Decoder:
    """Ids to text, chunk by chunk; what a chunk leaves unfinished waits for the next one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = {rank: token for token, rank in ranks.items()}

    def stream(self, chunks: Iterable[list[int]]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in chunks:
            yield machine.decode(b"".join(map(self.bytes.__getitem__, ids)))
        yield machine.decode(b"", final=True)

    def __call__(self, ids: list[int], chunk: int = 4_096) -> str:
        return "".join(self.stream(ids[i : i + chunk] for i in range(0, len(ids), chunk)))


def coders(vocabulary, pattern: str) -> tuple[Encoder, Decoder]:
    """The coders of a broadcast vocabulary, made once in each worker."""
    key = ("bpe", vocabulary._jid if hasattr(vocabulary, "_jid") else id(vocabulary), pattern)
    return kept(key, lambda: (Encoder(vocabulary.value, pattern), Decoder(vocabulary.value)))


def _mapped(docs: DataFrame, columns: list, make, schema: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(*columns).mapInArrow(make, schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every document."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        encoder, _ = coders(vocabulary, pattern)
        for batch in batches:
            ids = [encoder(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return _mapped(docs, [F.col(id_col), text_of(text_col).alias("text")], run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids decode to empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        _, decoder = coders(vocabulary, "")
        return ids.map(lambda x: "" if x is None else decoder(list(x)))

    return encoded.select(id_col, text(F.col(ids_col)).alias("text"))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        encoder, decoder = coders(vocabulary, pattern)
        name = [str(i) for i in range(max(vocabulary.value.values()) + 1)]
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                ids = encoder(value.as_py())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(name.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoder(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return _mapped(docs, [F.col(id_col), text_of(text_col).alias("text")], run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def production_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *production_vocabulary())


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
