"""BPE encoding and decoding with a public tokenizer file.

Texts of plain Latin script without long unsplit spans go through a rank-merging engine with the same vocabulary. Others
are cut only where no pre-token can reach across and the ids of the pieces are cached; a long unsplit piece is encoded as a tree: halves are encoded in parallel, then a window that grows around each join
is re-encoded until its first and last tokens agree with both sides. A token sequence is the encoding of its text
exactly when every adjacent pair is, so agreement on both seams makes the joined sequence exact.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import pyarrow as pa

from pyspark.sql import DataFrame

from rankflow.llm.common import fresh_name, prepare

#: Entries of a worker's cache; it is emptied when full, so its memory is bounded.
CACHE_ENTRIES = 400_000
#: Pieces longer than this many characters are not cached.
LONG_PIECE = 256
#: Pre-tokens longer than twice this many bytes are encoded as a tree of leaves of this size.
LEAF = 2048
#: Tokens of each side in the first window around a join.
WINDOW = 8
#: Pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SOFT_CUT = re.compile(r"(?= \S)")
#: Characters whose class and composition no Unicode version changes: for them two libraries agree.
_PLAIN = re.compile("[\x21-\x7e\u00a1-\u024f]*")
_PLAIN_TEXT = re.compile("[\x20-\x7e\n\u00a1-\u024f]*")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


def load(path: str):
    """The tokenizer of ``path`` without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def join_encodings(left: list[int], right: list[int], tokenize, text_of, window: int = WINDOW) -> list[int]:
    """The encoding of the two texts joined: re-encode a growing window until both its ends agree with the sides."""
    k = window
    while True:
        head, tail = left[-k:], right[:k]
        middle = tokenize("".join(map(text_of, chain(head, tail))))
        whole_left, whole_right = k >= len(left), k >= len(right)
        if (whole_left or middle[:1] == head[:1]) and (whole_right or middle[-1:] == tail[-1:]):
            return left[: len(left) - len(head)] + middle + right[len(tail) :]
        k *= 2


def tree_encode(text: str, tokenize, text_of, leaf: int = LEAF, pool=None) -> list[int]:
    """Encode one unsplit ``text`` (in the tokenizer's byte alphabet) as a balanced tree of joins."""
    parts = [text[i : i + leaf] for i in range(0, len(text), leaf)]
    run = pool.map if pool else map
    nodes = list(run(tokenize, parts))
    while len(nodes) > 1:
        pairs = [(nodes[i], nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
        odd = nodes[-1:] if len(nodes) % 2 else []
        nodes = list(run(lambda p: join_encodings(*p, tokenize, text_of), pairs)) + odd
    return nodes[0] if nodes else []


class ByteEncoder:
    """Encoder and decoder for a byte-level BPE file; equal to the library's ``encode`` and ``decode``."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES, leaf: int = LEAF):
        import tiktoken

        self.tokenizer, self.leaf, self.cache_entries = load(path), leaf, cache_entries
        self.first: dict[str, tuple[int, ...]] = {}
        self.later: dict[str, tuple[int, ...]] = {}
        size = self.tokenizer.get_vocab_size()
        self.words = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.rendered = [str(i) for i in range(size)]
        alphabet = _byte_alphabet()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.raw = [added[i].encode() if i in added else bytes(alphabet[c] for c in w) for i, w in enumerate(self.words)]
        self.ids = self.tokenizer.get_vocab()
        self.core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={r: i for i, r in enumerate(self.raw) if i not in added}, special_tokens={})._core_bpe
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(added.values(), key=len, reverse=True)) + ")") if added else None

    def _tokenize(self, text: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def _long(self, text: str) -> list[int]:
        """A piece without a cut: short pre-tokens as they are, long ones as trees."""
        found: list[int] = []
        with ThreadPoolExecutor(2) as pool:
            for k, part in enumerate(self.special.split(text) if self.special else [text]):
                if k % 2:
                    found.append(self.ids[part])
                elif part:
                    for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                        found += self._tokenize(word) if len(word) <= 2 * self.leaf else tree_encode(word, self._tokenize, self.words.__getitem__, self.leaf, pool)
        return found

    def _fill(self, cache: dict, pieces: set, prefix: str) -> None:
        missing = [p for p in pieces.difference(cache) if len(p) <= LONG_PIECE]
        if missing:
            if len(cache) + len(missing) > self.cache_entries:
                cache.clear()
                missing = [p for p in pieces if len(p) <= LONG_PIECE]
            encoded = self.tokenizer.encode_batch_fast([prefix + p for p in missing] if prefix else missing, add_special_tokens=False)
            cache.update(zip(missing, (tuple(e.ids) for e in encoded)))
        for p in pieces:
            if len(p) > LONG_PIECE:
                cache[p] = tuple(self._long(prefix + p))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if len(max(text.split(" "), key=len)) <= 2 * self.leaf and _PLAIN_TEXT.fullmatch(text) and not (self.special and self.special.search(text)):
            return self.core.encode_ordinary(text)
        if _ODD_SPACE.search(text):
            pieces = _SOFT_CUT.split(text)
            unique = set(pieces)
            self._fill(self.first, unique, "")
            found = list(chain.from_iterable(map(self.first.__getitem__, pieces)))
            self._forget(self.first, unique)
            return found
        first, *rest = text.split(" ")
        unique = set(rest)
        self._fill(self.first, {first}, "")
        self._fill(self.later, unique, " ")
        found = list(self.first[first])
        found.extend(chain.from_iterable(map(self.later.__getitem__, rest)))
        self._forget(self.first, {first})
        self._forget(self.later, unique)
        return found

    @staticmethod
    def _forget(cache: dict, pieces: set) -> None:
        for p in pieces:
            if len(p) > LONG_PIECE:
                del cache[p]

    def decode_bytes(self, ids) -> bytes:
        """UTF-8 of the decoded text; ids that do not form UTF-8 go through the library for its replacements."""
        found = b"".join(map(self.raw.__getitem__, ids))
        try:
            found.decode()
        except UnicodeDecodeError:
            return self.tokenizer.decode(list(ids), skip_special_tokens=False).encode()
        return found


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update((chr(256 + n), b) for n, b in enumerate(b for b in range(256) if b not in plain))
    return table


def _plain_words() -> re.Pattern:
    """Pre-token pattern of word BPE with its character classes spelled out, for plain Latin script in lower case."""
    plain = {c for k in (*range(0x20, 0x7F), *range(0xA1, 0x250)) for c in chr(k).lower()}
    letters, digits = (re.escape("".join(sorted(c for c in plain if unicodedata.category(c)[0] == kind))) for kind in "LN")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+")


class WordEncoder:
    """Encoder for a BPE file that drops white space and ends words; the ids of its parts are cached.

    Words of plain Latin script are split here and merged by ranks (a byte 0xFF, which UTF-8 never has, stands for the
    word's end); all others go through the library.
    """

    END = b"\xff"

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import json

        import tiktoken

        self.tokenizer, self.cache_entries = load(path), cache_entries
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        model = json.loads(self.tokenizer.to_str())["model"]
        suffix, alphabet = model["end_of_word_suffix"], _byte_alphabet()
        raw = lambda t: bytes(alphabet[c] for c in t.removesuffix(suffix)) + self.END * t.endswith(suffix)
        ranks, self.to_id = {bytes([b]): b for b in range(256)}, {}
        for c, b in alphabet.items():
            ranks[bytes([b]) + self.END] = 256 + b
            self.to_id[b], self.to_id[256 + b] = model["vocab"].get(c), model["vocab"].get(c + suffix)
        for k, pair in enumerate(model["merges"], 512):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            if ranks.setdefault(raw(left + right), k) == k:
                self.to_id[k] = model["vocab"][left + right]
        self.core = tiktoken.Encoding("ends", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = _plain_words()

    def _merge(self, part: str) -> tuple[int, ...]:
        return tuple(map(self.to_id.__getitem__, self.core.encode_single_piece(part.encode() + self.END)))

    def _word(self, word: bytes) -> tuple[int, ...]:
        text = word.decode()
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return tuple(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return tuple(chain.from_iterable(map(self._merge, self.split.findall(text.lower()))))

    def encode(self, text: str):
        """An iterable of the text's ids; equal to the library's ``encode`` without special tokens."""
        if _PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            return self._cached(self.split.findall(text.lower()), self.parts, self._merge)
        return self._cached(text.encode().split(), self.words, self._word)

    def _cached(self, pieces: list, cache: dict, one):
        unique = set(pieces)
        missing = unique.difference(cache)
        if missing:
            if len(cache) + len(missing) > self.cache_entries:
                cache.clear()
                missing = unique
            cache.update((p, one(p)) for p in missing)
        return chain.from_iterable(map(cache.__getitem__, pieces))


_ENCODERS: dict = {}


def encoder(kind, path: str):
    """The worker's encoder for ``path``; kept between tasks."""
    key = (kind, path)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(path)
    return _ENCODERS[key]


def encode_decode(documents: DataFrame, tokenizer_path: str, text_col: str = "text", keep=("doc_id",), digests_only: bool = False) -> DataFrame:
    """Encode and decode every whole text; one row per input row.

    Returns the columns ``keep``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, unless ``digests_only``, ``ids``
    and ``decoded``. A null text counts as empty (no tokens); repeated rows give repeated results; ``keep`` may hold
    nulls; columns not in ``keep`` are ignored, so names that clash do no harm; an empty table gives an empty result.
    """
    prepare(documents.sparkSession)
    out_names = {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}
    text = fresh_name([*keep, *out_names], "text")
    kept = documents.select(*keep, documents[text_col].alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop(text).schema) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids array<int>, decoded string")

    def run(batches):
        bpe = encoder(ByteEncoder, tokenizer_path)
        for batch in batches:
            counts, digests, decoded_digests, all_ids, all_texts = [], [], [], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                ids = bpe.encode(value.as_py() or "")
                decoded = bpe.decode_bytes(ids)
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(bpe.rendered.__getitem__, ids)).encode()).hexdigest())
                decoded_digests.append(hashlib.sha256(decoded).hexdigest())
                if not digests_only:
                    all_ids.append(ids)
                    all_texts.append(decoded.decode())
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != text]
            names = [n for n in batch.schema.names if n != text]
            columns += [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded_digests, pa.string())]
            names += ["n_tokens", "ids_sha256", "decoded_sha256"]
            if not digests_only:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, schema)
