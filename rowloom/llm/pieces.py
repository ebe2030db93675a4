"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes one symbol per character; an agenda of adjacent pairs that form a piece is worked off by score, the
leftmost first among equals, until none is left. Characters without a piece become bytes. No piece holds a mark of
white space after another character, so the agenda of a text falls apart into those of its chunks (marks and the
characters up to the next mark or line end). Short chunks of a batch are worked off together: in each round every chunk
takes the head of its own agenda. Long chunks use a heap. New chunks of a batch are checked against the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import prepare

MARK = "▁"
#: Chunks of more characters than this use a heap of their own.
LONG = 64
#: Distinct chunks that a worker keeps.
KEPT = 400_000
NEVER = np.int64(1) << 62
OUTPUTS = {"token_ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string", "n_corrected": "long"}


class Vocabulary:
    """The tables of a model file: characters, merges with ranks (by score, best first), bytes and decoded forms."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        normal = {sp.id_to_piece(i): i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in normal):
            raise ValueError("a piece spans chunks; this encoder needs marks at the start of pieces only")
        self.symbols = dict(normal)
        for piece in normal:
            for c in piece:
                self.symbols.setdefault(c, self.size + len(self.symbols))
        self.character = np.full(0x110000, -1, np.int64)
        for s, i in self.symbols.items():
            if len(s) == 1:
                self.character[ord(s)] = i
        scores = sorted({sp.get_score(i) for i in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.merges = {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = self.symbols.get(piece[:k]), self.symbols.get(piece[k:])
                if a is not None and b is not None:
                    self.merges[a << 20 | b] = (rank[sp.get_score(i)], i)
        self._hash()
        bytes_of = {sp.id_to_piece(i): i for i in range(self.size) if sp.is_byte(i)}
        self.bytes = [bytes_of.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)]
        self.end = sp.eos_id()
        self.marked = {i for p, i in normal.items() if p[0] == MARK}
        self.forms = []
        for i in range(self.size):
            p = sp.id_to_piece(i)
            self.forms.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode())
        self.names = [str(i) for i in range(self.size)]

    def _hash(self, bits: int = 18) -> None:
        """The merges as an open hash table with linear probing: pair -> rank << 40 | piece."""
        while len(self.merges) << 2 > 1 << bits:
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int64)
        keys = np.array(list(self.merges), np.int64)
        for pair, slot in zip(keys.tolist(), self._slot(keys).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & self.mask
            rank, piece = self.merges[pair]
            self.slots[slot], self.values[slot] = pair, rank << 40 | piece

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 40 | piece of each pair, NEVER where it doesn't merge."""
        key = np.where((a | b) < 0, -2, a << 20 | b)
        slot = self._slot(key)
        found = self.values[slot]
        at = self.slots[slot]
        open_ = np.flatnonzero(at != key)
        found[open_] = NEVER
        open_ = open_[at[open_] >= 0]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at = self.slots[slot[open_]]
            hit = at == key[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (at >= 0)]
        return found

    def fallback(self, symbol: int, character: int) -> list[int]:
        return [symbol] if 0 <= symbol < self.size else [self.bytes[b] for b in chr(character).encode("utf-8", "replace")]

    def encode_chunk(self, chunk: str) -> list[int]:
        """One chunk by a heap of (rank, left position); entries whose symbols have changed are skipped."""
        symbol = self.character[[ord(c) for c in chunk]].tolist()
        left, right = list(range(-1, len(chunk) - 1)), [*range(1, len(chunk)), -1]
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and symbol[i] >= 0 and symbol[j] >= 0 and (m := self.merges.get(symbol[i] << 20 | symbol[j])):
                heapq.heappush(agenda, (m[0], i, j, symbol[i] << 20 | symbol[j], m[1]))

        for i in range(len(chunk) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, pair, made = heapq.heappop(agenda)
            if right[i] != j or symbol[i] << 20 | symbol[j] != pair:
                continue
            symbol[i], symbol[j], right[i] = made, -2, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for s, c in zip(symbol, chunk) if s != -2 for x in self.fallback(s, ord(c))]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of chunks one after the other, and how many each has.

        All agendas advance together. A round is one merge in every chunk of ``width`` symbols that has any left, so
        rounds go from the longest width down, and what is left of a width joins the chunks of the next. Symbols lie in
        rows by position, one column a chunk; the head of an agenda is the least of rank << 40 | position << 20 | piece.
        """
        sizes = np.array([len(c) for c in chunks], np.int64)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbols = self.character[points]
        symbols = np.where(symbols < 0, -points - 2, symbols)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        bounds = np.searchsorted(sizes[order], np.arange(int(sizes.max(initial=0)) + 2))
        owner, grid, agenda = np.zeros(0, np.int64), np.zeros((len(bounds), 0), np.int64), np.zeros((len(bounds), 0), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for width in range(len(bounds) - 2, 0, -1):
            new = order[bounds[width] : bounds[width + 1]]
            fresh = symbols[starts[new] + np.arange(width)[:, None]]
            pairs = self.lookup(fresh[:-1].ravel(), fresh[1:].ravel()).reshape(width - 1, len(new))
            owner, grid, agenda = np.append(owner, new), np.concatenate((grid[:width], fresh), axis=1), np.concatenate((agenda[: width - 1], pairs), axis=1)
            best = np.full(len(owner), NEVER)
            for p in range(width - 1):
                np.minimum(best, agenda[p] + (p << 20), out=best)
            live = best < NEVER
            done.append((owner[~live], grid[:, ~live]))
            owner, grid, agenda, best = owner[live], grid[:, live], agenda[:, live], best[live]
            if width == 1 or not len(owner):
                continue
            at, columns = best >> 20 & 0xFFFFF, np.arange(len(owner))
            grid[at, columns] = best & 0xFFFFF
            for p in range(1, width - 1):
                after = at < p
                np.copyto(grid[p], grid[p + 1], where=after)
                if p < width - 2:
                    np.copyto(agenda[p], agenda[p + 1], where=after)
            for k in (at - 1, at):
                inner = np.flatnonzero((k >= 0) & (k < width - 2))
                r = k[inner]
                agenda[r, inner] = self.lookup(grid[r, inner], grid[r + 1, inner])
        counts = np.zeros(len(chunks), np.int64)
        for own, rows in done:
            counts[own] = len(rows)
        offsets = np.cumsum(counts) - counts
        flat = np.empty(counts.sum(), np.int64)
        for own, rows in done:
            flat[offsets[own] + np.arange(len(rows))[:, None]] = rows
        odd = np.flatnonzero((flat < 0) | (flat >= self.size))
        if len(odd):
            characters = {i: ord(c) for c, i in self.symbols.items() if i >= self.size}
            parts = [np.array(self.fallback(s, -s - 2 if s < 0 else characters[s])) for s in flat[odd].tolist()]
            width_of = np.ones(len(flat), np.int64)
            width_of[odd] = [len(p) for p in parts]
            plain = np.ones(len(flat), bool)
            plain[odd] = False
            first = np.repeat(plain, width_of)
            ids = np.empty(len(first), np.int64)
            ids[first], ids[~first] = flat[plain], np.concatenate(parts)
            counts = np.bincount(np.repeat(np.repeat(np.arange(len(chunks)), counts), width_of), minlength=len(chunks))
            flat = ids
        return flat, counts

    def expected(self, chunks: list[str]) -> list[list[int]]:
        """What the library makes of chunks. It puts a mark before a text; a line end before a chunk keeps that apart."""
        plain = [("" if c[0] == MARK else "\n") + c[c[0] == MARK :].replace(MARK, " ") for c in chunks]
        found = self.library.encode(plain, num_threads=1)
        return [f if c[0] == MARK and len(c) > 1 else [self.symbols[MARK]] if c == MARK else f[2:] for c, f in zip(chunks, found)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the library's decode gives it: marks are spaces, and the first piece's mark goes."""
        joined = b"".join(map(self.forms.__getitem__, ids))
        try:
            text = joined.decode("utf-8")
        except UnicodeDecodeError:  # bytes that are no text: the library has its own rule
            return self.library.decode(list(ids))
        first = next((i for i in ids if self.forms[i]), None)
        return text[1:] if first in self.marked else text


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts with a bounded table of the chunks met so far."""

    CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def __init__(self, vocab: Vocabulary, check: bool = True):
        self.vocab, self.check, self.corrected = vocab, check, 0
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.starts, self.sizes, self.wrong = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self, chunks: list[str]) -> None:
        if not chunks:
            return
        short = [c for c in chunks if len(c) <= LONG]
        flat, sizes = self.vocab.encode_chunks(short)
        if len(short) < len(chunks):
            it = iter(np.split(flat, np.cumsum(sizes)[:-1]) if short else ())
            each = [next(it) if len(c) <= LONG else np.array(self.vocab.encode_chunk(c)) for c in chunks]
            flat, sizes = np.concatenate(each), np.array([len(e) for e in each])
        wrong = np.zeros(len(chunks), bool)
        if self.check:
            theirs = self.vocab.expected(chunks)
            lengths = np.fromiter(map(len, theirs), np.int64, len(theirs))
            listed = np.fromiter(chain.from_iterable(theirs), np.int64, lengths.sum())
            if not np.array_equal(lengths, sizes) or not np.array_equal(listed, flat):
                ours = np.split(flat, np.cumsum(sizes)[:-1])
                wrong = np.array([t != o.tolist() for t, o in zip(theirs, ours)])
                flat, sizes = listed, lengths
        base = len(self.ids)
        self.ids = np.concatenate((self.ids, flat.astype(np.int32)))
        self.starts = np.concatenate((self.starts, base + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.wrong = np.concatenate((self.wrong, wrong))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
        """Ids of each text with the end id, and how many chunks the library corrected."""
        if len(self.codes) > KEPT:
            self._reset()
        known, new, coded = self.codes, [], []
        for text in texts:
            chunks = self.CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []
            try:
                codes = list(map(known.__getitem__, chunks))
            except KeyError:
                codes = []
                for c in chunks:
                    k = known.get(c)
                    if k is None:
                        k = known[c] = len(known)
                        new.append(c)
                    codes.append(k)
            coded.append(np.array(codes, np.int64))
        self._learn(new)
        end = np.array([self.vocab.end], np.int32)
        for codes in coded:
            sizes = self.sizes[codes]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[codes] - ends + sizes, sizes)
            yield np.concatenate((self.ids[at], end)), int(self.wrong[codes].sum())


def tokenize(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("token_ids", "n_tokens"), check: bool = True) -> DataFrame:
    """The columns ``keep`` of every document with some of: token_ids (with the end id), n_tokens, ids_sha256
    (lowercase hex of the decimal ids joined by spaces), decoded, decoded_sha256, n_corrected.

    ``model`` is the path of the model file, the same on all executors. A null text counts as empty: the end id alone,
    decoded to the empty text. Every row gives a row, repeated ones too; an empty table gives none. Of clashing names in
    ``keep`` and ``outputs`` the output wins. ``check`` compares every new chunk of a batch with the library and counts
    in n_corrected those where the library's ids had to replace this encoder's (none are known).
    """
    prepare(docs.sparkSession)
    kept = [c for c in keep if c not in outputs]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{o} {OUTPUTS[o]}" for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        encoder, name = Encoder(vocab, check), vocab.names.__getitem__
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                found: dict[str, list] = {o: [] for o in outputs}
                texts = [(x.as_py() or b"").decode("utf-8", "replace") for x in batch.column(len(kept))]
                for ids, corrected in encoder.encode(texts):
                    listed = ids.tolist()
                    decoded = vocab.decode(listed) if "decoded" in found or "decoded_sha256" in found else None
                    for o in outputs:
                        if o == "token_ids":
                            found[o].append(ids)
                        elif o == "n_tokens":
                            found[o].append(len(listed))
                        elif o == "ids_sha256":
                            found[o].append(hashlib.sha256(" ".join(map(name, listed)).encode()).hexdigest())
                        elif o == "n_corrected":
                            found[o].append(corrected)
                        else:
                            found[o].append(decoded if o == "decoded" else hashlib.sha256(decoded.encode()).hexdigest())
                arrays = [pa.array(v, pa.list_(pa.int32()) if o == "token_ids" else pa.string() if OUTPUTS[o] == "string" else pa.int64()) for o, v in found.items()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *arrays], [*kept, *outputs])

    return docs.select(*kept, F.col(text).cast("binary").alias("__text")).mapInArrow(run, schema)
