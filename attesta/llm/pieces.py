"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words (runs of spaces with what follows up to the next space) are independent, as no piece holds a space mark behind another character; so are the parts of
a word between two characters that no piece holds side by side (most letters of texts without spaces). Each distinct word is encoded once and kept. All new
words of a chunk lie in flat numpy arrays, one symbol a character. A round looks up the ranks of all adjacent pairs that changed, takes the segmented minimum by
word, merges the pairs of that rank from the left at once, and compacts the arrays; words in which no pair is left drop out. Merging all occurrences at
once equals the one-by-one order only if no pair of the new piece is as good as the one merged; where the vocabulary breaks this (known for each piece
beforehand), a round merges just the leftmost.

In parts beyond LONG symbols a round takes the minimum not of the part but of the REACH symbols to either side of each pair, REACH being the longest piece: a
pair that no better one (or equal one to its left) is that near to can't be touched by anything that comes before it in the one-by-one order, as the piece
that touched it would be longer than the longest. So a long part takes about as many rounds as pieces are long, not as many as it has merges.
Characters without a piece become their UTF-8 bytes' pieces.

Plan: no shuffle; the model (some MB, a constant) is broadcast. What a task keeps is bounded by KEPT words of at most KEPT_LENGTH characters, and words are
encoded in blocks of about BLOCK symbols; texts are cut into words of about that many characters at once.

Cases: null and empty text have no ids and decode to "". Any other text has the dummy prefix space, which decoding removes. Texts of any length are encoded
whole. Repeated rows are encoded each. Columns of the input stay, but for ids and decoded, which are replaced. Models that aren't BPE with identity
normalisation, a dummy prefix, kept white space and byte fallback are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import chunks, spans, text_table, tune, with_fields

#: Distinct words that a task keeps and characters of such a word; symbols beyond which rounds go by reach; symbols, and bytes of text, worked on at once.
KEPT, KEPT_LENGTH, LONG, BLOCK, CHUNK = 400_000, 64, 64, 1 << 19, 2 << 20
MARK = "▁"
_NONE = np.int32(2**31 - 1)
_WORD = re.compile(" +[^ ]*")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _varint(raw: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[i]
        i += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, i
        shift += 7


def _fields(raw: bytes):
    """(number, value) of a protocol-buffer message."""
    i = 0
    while i < len(raw):
        tag, i = _varint(raw, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(raw, i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else _varint(raw, i)
            v, i = raw[i : i + n], i + n
        yield tag >> 3, v


class Pieces:
    """The vocabulary and its pair table."""

    def __init__(self, model: bytes):
        self.piece, score, self.kind = [], [], []
        trainer: dict = {}
        normal: dict = {}
        for n, v in _fields(model):
            if n == 1:
                p = dict(_fields(v))
                self.piece.append(p.get(1, b"").decode("utf-8"))
                score.append(float(np.frombuffer(p.get(2, b"\0\0\0\0"), np.float32)[0]))
                self.kind.append(p.get(3, NORMAL))
            elif n == 2:
                trainer = dict(_fields(v))
            elif n == 3:
                normal = dict(_fields(v))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("the model isn't BPE with byte fallback and leading space marks")
        if normal.get(2, b"") or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or set(self.kind) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model's normalisation or piece types aren't supported")
        own = {p: i for i, p in enumerate(self.piece) if self.kind[i] == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in own):
            raise ValueError("the model has pieces across words")
        self.size = len(self.piece)
        self.byte = np.zeros(256, np.int32)
        for i, p in enumerate(self.piece):
            if self.kind[i] == BYTE:
                self.byte[int(p[3:5], 16)] = i
        order = {s: r for r, s in enumerate(sorted({score[i] for i in own.values()}, reverse=True))}
        self.rank = np.full(self.size, _NONE, np.int32)
        for i in own.values():
            self.rank[i] = order[score[i]]
        self.reach = max((len(p) for p in own), default=1)
        inside = {ord(x) << 21 | ord(y) for p in own for x, y in zip(p, p[1:], strict=False)}
        self.beside = np.array(sorted(inside) or [0], np.int64)  # pairs of characters that some piece holds side by side
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in own.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        pairs = [(own[p[:k]], own[p[k:]], i) for p, i in own.items() for k in range(1, len(p)) if p[:k] in own and p[k:] in own]
        left, right, self_made = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        best = np.full(self.size, _NONE, np.int64)  # of the pairs that a piece can enter
        for side in (left, right):
            np.minimum.at(best, side, self.rank[self_made])
        self.safe = best > self.rank
        self.bits = max(12, int(np.ceil(np.log2(4 * len(left) + 1))))
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys, values = left * self.size + right, self_made.astype(np.int32)
        slot = self._slot(keys)
        while len(keys):  # linear probing
            free = self.keys[slot] < 0
            _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            one = one[free[one]]
            self.keys[slot[one]], self.made[slot[one]] = keys[one], values[one]
            left_over = np.ones(len(keys), bool)
            left_over[one] = False
            keys, values, slot = keys[left_over], values[left_over], slot[left_over]
            slot = np.where(self.keys[slot] >= 0, slot + 1 & (1 << self.bits) - 1, slot)
        text = [b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(self.piece, self.kind, strict=True)]
        self.text, self.text_len = np.frombuffer(b"".join(text), np.uint8), np.array([len(t) for t in text], np.int64)
        self.text_at = np.cumsum(self.text_len) - self.text_len
        self.marked = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(self.piece, self.kind, strict=True)])
        self.silent = np.array([k == CONTROL for k in self.kind])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1. Symbols from size on are characters without a piece."""
        out = np.full(len(left), -1, np.int32)
        at = np.flatnonzero((left < self.size) & (right < self.size))
        keys = left[at].astype(np.int64) * self.size + right[at]
        slot = self._slot(keys)
        while len(at):
            found = self.keys[slot]
            hit = found == keys
            out[at[hit]] = self.made[slot[hit]]
            go = ~hit & (found >= 0)
            at, keys, slot = at[go], keys[go], slot[go] + 1 & (1 << self.bits) - 1
        return out

    def _rank_of(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.rank[made], _NONE)

    def _near(self, rank: np.ndarray) -> np.ndarray:
        """Pairs that are best, or equal and leftmost, among those up to reach symbols away."""
        n, r = len(rank), self.reach

        def least(x: np.ndarray, width: int) -> np.ndarray:
            size = 1
            while 2 * size <= width:
                x, size = np.minimum(x[:-size], x[size:]), 2 * size
            return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x

        wide = np.full(n + 2 * r, _NONE, np.int32)
        wide[r : r + n] = rank
        m = least(wide, r)  # m[i]: of wide[i : i + r]
        return (rank < m[:n]) & (rank <= m[r + 1 : r + 1 + n])

    def encode_words(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids by word) of distinct words, in which spaces stand for space marks."""
        ids, n, a, size = [], [], 0, 0
        for b, w in enumerate(found):
            size += len(w)
            if size >= BLOCK or b == len(found) - 1:
                x, y = self._encode(found[a : b + 1])
                ids.append(x)
                n.append(y)
                a, size = b + 1, 0
        return (np.concatenate(ids), np.concatenate(n)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(found).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(w) for w in found], np.int64)
        sym = self.of_char[code]
        sym = np.where(sym >= 0, sym, self.size + code.astype(np.int32))
        owner = np.repeat(np.arange(len(found)), size)
        # parts: words, cut where two characters are in no piece side by side
        begins = np.diff(owner, prepend=-1) != 0
        if len(code) > 1:
            pair = code[:-1].astype(np.int64) << 21 | code[1:]
            begins[1:] |= self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] != pair
        part = np.cumsum(begins) - 1
        size = np.bincount(part)
        of = owner[begins]
        out_part, out_sym = [], []
        long = size > LONG
        for which, rounds in ((~long, self._rounds), (long, self._rounds_by_reach)):
            if which.any():
                own = which[part]
                for x, y in rounds(sym[own], part[own]):
                    out_part.append(x)
                    out_sym.append(y)
        part = np.concatenate(out_part) if out_part else np.zeros(0, np.int64)
        sym = np.concatenate(out_sym) if out_sym else np.zeros(0, np.int32)
        order = np.argsort(part, kind="stable")
        word, sym = of[part[order]] if len(order) else part, sym[order]
        if len(sym) and sym.max() >= self.size:  # byte fallback
            raw = sym >= self.size
            char = sym[raw] - self.size
            width = np.ones(len(sym), np.int64)
            width[raw] = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
            out = np.repeat(sym, width)
            data = np.frombuffer(char.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            out[np.repeat(raw, width)] = self.byte[data]
            word, sym = np.repeat(word, width), out
        return sym.astype(np.int32), np.bincount(word, minlength=len(found))

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        made = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            made[:-1] = self.pair(sym[:-1], sym[1:])
            made[:-1][word[1:] != word[:-1]] = -1
        return made

    def _merge(self, at: np.ndarray, sym: np.ndarray, word: np.ndarray, made: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pairs that begin at at become what they make; what follows from it."""
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep)[at] - 1
        sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
        touch = np.unique(np.concatenate((moved, moved[moved > 0] - 1)))
        fresh = np.full(len(touch), -1, np.int32)
        inner = touch + 1 < len(sym)
        inner[inner] &= word[touch[inner]] == word[touch[inner] + 1]
        fresh[inner] = self.pair(sym[touch[inner]], sym[touch[inner] + 1])
        made[touch] = fresh
        rank[touch] = self._rank_of(fresh)
        return sym, word, made, rank

    def _rounds_by_reach(self, sym: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        made = self._pairs(sym, word)
        rank = self._rank_of(made)
        while len(at := np.flatnonzero(self._near(rank))):
            sym, word, made, rank = self._merge(at, sym, word, made, rank)
        yield word, sym

    def _rounds(self, sym: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, symbol) of words in which nothing is left to merge, as they come to it."""
        made = self._pairs(sym, word)
        rank = self._rank_of(made)
        while len(sym):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            if (least == _NONE).any():
                over = np.repeat(least == _NONE, count)
                yield word[over], sym[over]
                sym, word, made, rank = sym[~over], word[~over], made[~over], rank[~over]
                count, least = count[least != _NONE], least[least != _NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, count))
            # of neighbours that overlap, every second from the left
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            leftmost = np.diff(word[at], prepend=-1) != 0
            at = at[(nth % 2 == 0) & (leftmost | self.safe[made[at]])]
            # where the leftmost of a word isn't safe, nothing else of that word is merged in this round
            lead = np.flatnonzero(np.diff(word[at], prepend=-1))
            alone = np.repeat(~self.safe[made[at[lead]]], np.diff(np.append(lead, len(at))))
            alone[lead] = False
            at = at[~alone]
            sym, word, made, rank = self._merge(at, sym, word, made, rank)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """UTF-8 of each sequence ids[first[k]:first[k + 1]], as the library decodes it."""
        lengths = self.text_len[ids]
        data = self.text[spans(self.text_at[ids], lengths)].tobytes()
        ends = np.concatenate(([0], np.cumsum(lengths)))
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            while a < b and self.silent[ids[a]]:
                a += 1
            raw = data[ends[a] + (a < b and int(self.marked[ids[a]])) : ends[b]]
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError:
                raw = _repaired(raw)
            out.append(raw)
        return out


def _repaired(raw: bytes) -> bytes:
    """Each byte that is part of no character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                raw[i : i + n].decode("utf-8")
            except UnicodeDecodeError:
                continue
            out.append(raw[i : i + n])
            i += n
            break
        else:
            out.append(b"\xef\xbf\xbd")
            i += 1
    return b"".join(out)


class Encoder:
    """Encodes texts, keeping distinct words."""

    def __init__(self, pieces: Pieces, kept: int = KEPT):
        self.pieces, self.kept = pieces, kept
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.at, self.n, self.used, self.words = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0, 0

    def _keep(self, ids: np.ndarray, n: np.ndarray) -> None:
        """Put words at the end of arrays that double when they are full."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.words + len(n) > len(self.n):
            self.at, self.n = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.n))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[self.words : self.words + len(n)] = self.used + np.cumsum(n) - n
        self.n[self.words : self.words + len(n)] = n
        self.used, self.words = self.used + len(ids), self.words + len(n)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        out, count, held, size = [], np.zeros(len(texts) + 1, np.int64), [], 0

        def flush():
            ids, n = self._encode([w for _, w in held])
            ends = np.concatenate(([0], np.cumsum(n)))
            at = 0
            for t, w in held:
                count[t + 1] += ends[at + len(w)] - ends[at]
                at += len(w)
            out.append(ids)
            held.clear()

        for t, text in enumerate(texts):
            for part in _parts(text):
                held.append((t, part[1]))
                size += part[0]
                if size >= BLOCK:
                    flush()
                    size = 0
        flush()
        return np.concatenate(out), np.cumsum(count)

    def _encode(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids by word) of lists of words, each without its first space."""
        flat = [w for s in split for w in s]
        if self.words > self.kept:
            self._clear()
        new = list(set(flat).difference(self.slot))
        brief, wide = [w for w in new if len(w) <= KEPT_LENGTH], [w for w in new if len(w) > KEPT_LENGTH]
        self.slot.update(zip(brief, range(self.words, self.words + len(brief)), strict=True))
        self._keep(*self.pieces.encode_words([" " + w for w in brief]))
        if not wide:
            slots = np.fromiter(map(self.slot.__getitem__, flat), np.int64, len(flat))
            n = self.n[slots]
            return self.ids[spans(self.at[slots], n)], n
        # long words aren't kept: they lie behind what is kept for this once
        used, words, own = self.used, self.words, dict(zip(wide, range(self.words, self.words + len(wide)), strict=True))
        self._keep(*self.pieces.encode_words([" " + w for w in wide]))
        slots = np.fromiter((own[w] if len(w) > KEPT_LENGTH else self.slot[w] for w in flat), np.int64, len(flat))
        n = self.n[slots]
        out = self.ids[spans(self.at[slots], n)], n
        self.used, self.words = used, words
        return out


def _parts(text: str | None) -> Iterator[tuple[int, list[str]]]:
    """(size, words without their first space) of a text, in parts of about BLOCK characters that end with a word."""
    if not text:
        return
    if MARK in text:
        text = text.replace(MARK, " ")
    if len(text) <= BLOCK:
        yield len(text), text.split(" ") if text[0] != " " and "  " not in text and text[-1] != " " else [w[1:] for w in _WORD.findall(" " + text)]
        return
    text, held, size = " " + text, [], 0
    for m in _WORD.finditer(text):
        held.append(m.group()[1:])
        size += len(held[-1]) + 1
        if size >= BLOCK:
            yield size, held
            held, size = [], 0
    if held:
        yield size, held


def encode(docs: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """docs with ids (array<int>) and, if asked for, decoded (the text that the ids decode to). model: path of the model file, read by the driver."""
    spark = docs.sparkSession
    tune(spark)
    with open(model, "rb") as f:
        held = spark.sparkContext.broadcast(Pieces(f.read()))
    own = [c for c in docs.columns if c.lower() not in {"ids", "decoded"}]
    more = (("decoded", "string"),) if decoded else ()

    def run(batches):
        encoder = Encoder(held.value)
        for b in chunks(batches, CHUNK):
            ids, first = encoder.encode(b.column(b.schema.get_field_index("text")).to_pylist())
            arrays = [*[b.column(b.schema.get_field_index(c)) for c in own], pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))]
            if decoded:
                arrays.append(pa.array(held.value.decode(ids, first), pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*own, "ids", *[n for n, _ in more]])

    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, with_fields(docs, ("ids", "array<int>"), *more, drop=("decoded",)))


def decode(df: DataFrame, model: str) -> DataFrame:
    """df, which has ids (array<int>), with decoded. Null ids decode to "", as no ids do."""
    spark = df.sparkSession
    tune(spark)
    with open(model, "rb") as f:
        held = spark.sparkContext.broadcast(Pieces(f.read()))
    own = [c for c in df.columns if c.lower() != "decoded"]

    def run(batches):
        for b in chunks(batches, CHUNK):
            column = b.column(b.schema.get_field_index("ids"))
            n = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
            first = np.concatenate(([0], np.cumsum(n)))
            out = held.value.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in own], pa.array(out, pa.binary()).cast(pa.string())], [*own, "decoded"])

    return df.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, with_fields(df, ("decoded", "string")))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(encoded: DataFrame, *columns: str) -> DataFrame:
    """The given columns, n_tokens and the hashes of ids and decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(*columns, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, model_path(), decoded=True), "doc_id")
