"""Byte-level BPE by backtracking over Aho-Corasick longest matches, and decoding by offset table.

A run of tokens is what merging by rank gives if, and only if, every two neighbours are: no merge of
lower rank than their own crosses the boundary between them. So the encoder takes the longest token
at each position, asks the pair table whether it may follow the last one, falls back to the longest
token that is a prefix of it, and steps back where none may follow; positions that led nowhere are
not entered again, which makes it linear. Longest tokens at all positions of a piece come from one
pass of an automaton of the reversed tokens over the reversed piece.

Texts are cut into pieces at white space first, and pieces that came before are looked up. The
vocabulary is read by the driver and travels with the task; decoding gathers bytes of one blob of
all tokens through a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import bound_batches, documents_of

#: Fixed by the tokenizer: how a byte-level pre-tokenizer splits.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of Unicode.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Runs without white space, with one blank before them if there is one; PATTERN never crosses them.
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
#: Pieces that one worker remembers: two generations of so many.
REMEMBERED = 150_000
#: Pairs of tokens in the table of pairs; when it is full it starts anew.
PAIRS = 100_000


@cache
def _byte_of() -> dict[str, int]:
    """Byte of each printable stand-in: printable Latin-1 stands for itself, the rest follows from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens in the order of their ranks (bytes first), the pairs they merge, and their ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        byte_of = _byte_of()
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.tokens: list[bytes] = [bytes((b,)) for b in range(256)]
        self.ids: list[int] = [0] * 256
        for char, b in byte_of.items():
            self.ids[b] = ids[char]
        at = {t: i for i, t in enumerate(self.tokens)}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(256)]
        for left, right in (m.split(" ") if isinstance(m, str) else m for m in merges):
            at.setdefault(token := raw(left + right), len(self.tokens))
            self.halves.append((at[raw(left)], at[raw(right)]))
            self.tokens.append(token)
            self.ids.append(ids[left + right])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        tokens = vocabulary.tokens
        self.names = [str(i) for i in vocabulary.ids]
        self.halves = vocabulary.halves
        self.lengths = [len(t) for t in tokens]
        self.merged = {pair: i for i, pair in enumerate(vocabulary.halves) if i >= 256}
        at = {t: i for i, t in reversed([*enumerate(tokens)])}
        self.shorter = [next((at[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in at), -1) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for t, i in at.items():
            self.automaton.add_word(t[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.special = vocabulary.special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        whole = dict(zip(vocabulary.ids, tokens, strict=True)) | {i: s.encode() for s, i in self.special.items()}
        sizes = np.array([len(whole.get(i, b"")) for i in range(max(whole) + 1)], dtype=np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.blob = np.frombuffer(b"".join(whole.get(i, b"") for i in range(len(sizes))), dtype=np.uint8)
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary of two tokens before they are whole.

        The tokens are taken apart, the later made first, along the boundary; ``bound`` is the rank
        from which on a merge across it would come too late.
        """
        bound = len(self.lengths)
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            if left > right:
                bound, left = left, self.halves[left][1]
                if left == bound:
                    bound, right = right + 1, self.halves[right][0]
                    if right + 1 == bound:
                        return True
            else:
                bound, right = right + 1, self.halves[right][0]
                if right + 1 == bound:
                    bound, left = left, self.halves[left][1]
                    if left == bound:
                        return True

    def longest(self, piece: bytes) -> list[int]:
        """The longest token that starts at each position: of the tokens that end at one place of the
        reversed piece, the automaton gives the longest first."""
        last, before = len(piece) - 1, -1
        out = [-1] * len(piece)
        for end, token in self.automaton.iter(piece[::-1].decode("latin-1")):
            if end != before:
                out[last - end] = token
                before = end
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Tokens (by rank) of one piece, as merging by rank gives them."""
        n, lengths, longest = len(piece), self.lengths, self.longest(piece)
        if lengths[longest[0]] == n:
            return [longest[0]]
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        pairs, known = self.pairs, self.pairs.get
        open_, out = bytearray(b"\x01") * (n + 1), []
        pos, token = 0, longest[0]
        while pos < n:
            while True:
                end = pos + lengths[token]
                if open_[end]:
                    if not out:
                        fits = True
                    elif (fits := known(pair := out[-1] << 20 | token)) is None:
                        fits = pairs[pair] = self.may_follow(out[-1], token)
                    if fits:
                        out.append(token)
                        pos = end
                        token = longest[pos] if pos < n else -1
                        break
                if (token := self.shorter[token]) < 0:
                    open_[pos] = 0
                    token = out.pop()
                    pos -= lengths[token]
                    token = self.shorter[token]
                    while token < 0:
                        open_[pos] = 0
                        token = out.pop()
                        pos -= lengths[token]
                        token = self.shorter[token]
        return out

    def chunk(self, text: str) -> str:
        """Ids of a run, in decimal."""
        pieces = self.pattern.findall(text)
        if len(pieces) > 1:
            # A piece of its own is what a run of only that piece is: it may be remembered.
            return ",".join([self.young.get(p) or self.remember(p) for p in pieces])
        return ",".join([self.names[t] for t in self.merge(text.encode())])

    def remember(self, text: str) -> str:
        if (got := self.old.get(text)) is None:
            got = self.chunk(text)
        if len(text) <= 64:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[text] = got
        return got

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a text, and the same in decimal with commas between them."""
        parts: list[str] = []
        get, remember = self.young.get, self.remember
        for i, segment in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                parts.append(str(self.special[segment]))
                continue
            for chunk in _CHUNK.findall(segment):
                if (got := get(chunk)) is None:
                    got = remember(chunk)
                    get = self.young.get
                parts.append(got)
        listed = ",".join(parts)
        return np.fromstring(listed, dtype=np.int32, sep=","), listed

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of ids, by offsets into the blob of all tokens."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


_CODECS: dict[str, Codec] = {}


def codec(vocabulary: Vocabulary, name: str) -> Codec:
    """The worker's codec of a vocabulary; later tasks of the same worker find its pieces remembered."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(vocabulary)
    return _CODECS[name]


def _coder(path: str, keep_ids: bool):
    vocabulary = Vocabulary(path)
    kind = "n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + ",ids:array<int>" * keep_ids
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]

    @F.arrow_udf(f"struct<{kind}>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = codec(vocabulary, path)
        for batch in batches:
            counts, digests, decoded, ids_of = [], [], [], []
            for scalar in batch:
                ids, listed = coder.encode(scalar.as_py() or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(listed.encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if keep_ids:
                    ids_of.append(ids)
            columns = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = fields
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids_of])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids_of]))))
                names = [*fields, pa.field("ids", pa.list_(pa.int32()))]
            yield pa.StructArray.from_arrays(columns, fields=names)
        # The worker may stay for other work: it keeps one generation.
        coder.old = {}

    return coded


def encode_documents(documents: DataFrame, path: str, *, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Add ``tokens`` (n_tokens, digests of the ids and of what they decode to, and the ids) to every row.

    Ids are those of the tokenizers library without added special tokens, truncation and padding;
    special tokens that stand in a text get their ids. A null text is encoded as the empty text,
    which has no tokens. Repeated rows are encoded one by one; other columns stay, but a column
    ``tokens`` is replaced. An empty table stays empty.
    """
    bound_batches(documents)
    return documents.withColumn("tokens", _coder(path, keep_ids)(F.col(text)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_documents(documents_of(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return found.select("doc_id", "tokens.n_tokens", "tokens.ids_sha256", "tokens.decoded_sha256")
